"""Repair of text from scanned pages: furniture, divided words, misread characters.

Three averaged perceptrons decide, each between doing nothing and its operations;
with no weights nothing is ever changed:

* ``furniture``: whether a line is a running header or a page number. Features
  are the line's place on the page (from the top and the end of the text, from
  blank lines, from the furniture before it), its recurrence (how many lines of
  the document carry the title, whether numbers count on), how it breaks the
  flow of the sentences around it, and its wording (likeness to the title, form
  of the number). Trained on the lines that wording alone makes certain.
* ``joining``: whether a word at the end of a line goes on in the next running
  line (line-join). Features are the mark, the cases, and whether the lexicon
  knows the joined or the hyphenated form. Trained where the lexicon is clear.
* ``editing``: the character editor. For every word form it weighs keep against
  edits (replace, insert and delete of one or two characters, two edits at
  most), by the characters around the edit and by the lexicon: how much more
  frequent the result is than the form, and whether either is a name. Trained
  on pairs mined from the lexicon: rare forms, and the frequent forms they are
  most likely misread from. Which edits exist is mined too, with a support test.

The lexicon (documents that hold a form, by language, and those that list it
among their names) is a distributed table over the whole corpus. Forms are
judged once each, not once per occurrence: candidates of each distinct form meet
the lexicon by a join, and the forms that change (``fixes``) meet the words of
the documents by another. Only what is bounded reaches every task: weights, and
the forms that stand in a share ``least`` of a language's documents (as a
document holds a bounded number of words, so many forms at most), which serve
to label training data and to leave good words at home. Fitting uses at most
``most_training`` forms, divisions and lines, picked by hash.

Mentions of a list name one person, so they are judged against each other, by
perceptrons over the same features trained on the lists themselves.

Defined results for odd input: null and empty texts and lists give no defects;
null titles give no headers; null mentions keep their position; repeated rows
give the same defects once (``distinct``); extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from math import log2

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from ..operators.skew import split_join
from ..session import kept

#: The marks that divide a word at the end of a line.
MARKS = "-=¬­‐"
WORD = regex.compile(r"(?:[\p{L}\p{M}]|\d(?=[\p{L}'’])|(?<=\p{L})\d)+['’]?")
PLAIN_WORD = re.compile(r"[^\W_]+['’]?")
COMBINING = re.compile("[̀-ͯ҃-҇⃐-⃿︠-︯]")
DIVIDED = re.compile(r"([^\W_]+)([" + MARKS + r"])\s*$")
STARTS = re.compile(r"\s*([^\W_]+['’]?)")
INNER = re.compile(r"(?<=[^\W_])([" + MARKS + r"])(\s*)(?=[^\W_])|(?<=[^\W_])(­)(\s*)$")
NUMBER = re.compile(r"\s*(?:[—–-]\s*)?(?:\[\s*)?(?:[pPsS]\.\s?)?([0-9OolI]{1,4})(?:\s*\])?(?:\s*[—–-])?\.?\s*")
DATE = re.compile(r"[\dOolIſSB]{4}-[\dOolISB]{1,2}-[\dOolISB]{1,2}|\bN[°ºor]\.?\s*[\dOolISB]+|(?<![^\W_])\d{1,4}(?![^\W_])")
INNER_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
JOINT = re.compile(r"(?<=[^\W_])[" + MARKS + r"]\s*\n\s*(?=[^\W\d_])")
RUNNING, BLANK, HEADER, PAGE = "", "blank", "running_header", "page_number"
STAT_DDL = "kind string, lang string, word string, df bigint, named bigint, apart bigint, a string, mark string, b string"
FIX_DDL = "lang string, word string, meant string, at int"


def words_of(text: str) -> list[str]:
    """The word forms of a text in order: letters, with digits only next to letters."""
    if COMBINING.search(text):
        return WORD.findall(text)
    out = []
    for w in PLAIN_WORD.findall(text):
        if w.isalpha() or w[:-1].isalpha():
            out.append(w)
        elif not w.isdigit():
            out += WORD.findall(w)
    return out


def spans_of(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, form) of the words of a stretch."""
    if COMBINING.search(text):
        for m in WORD.finditer(text, start, end):
            yield m.start(), m.end(), m[0]
        return
    for m in PLAIN_WORD.finditer(text, start, end):
        w = m[0]
        if w.isalpha() or w[:-1].isalpha():
            yield m.start(), m.end(), w
        elif not w.isdigit():
            for x in WORD.finditer(w):
                yield m.start() + x.start(), m.start() + x.end(), x[0]


def plain(text: str) -> str:
    return "".join(filter(str.isalnum, text)).casefold()


# ---- furniture


@functools.lru_cache(1 << 16)
def likeness_to(title: str, got: str) -> float:
    """How alike a line and a title are; 0 where a bound by their letters shows that it is less than 0.6."""
    match = SequenceMatcher(None, got, title, autojunk=False)
    return match.ratio() if match.quick_ratio() >= 0.6 else 0.0


def suspects(lines: list[str], title: str | None) -> dict[int, tuple[float, str]]:
    """line -> (likeness to the title, digits and form of the number) of the lines that may be furniture at all."""
    want = plain(title or "")
    least, most = len(want) * 0.75 - 6, len(want) * 1.25 + 12
    out = {}
    for i, line in enumerate(lines):
        if len(line) - line.count(" ") > most + 24:  # besides its letters a header has a date and a number at most
            continue
        letters = sum(map(str.isalpha, line))
        if letters <= 4 and (m := NUMBER.fullmatch(line)) and any(map(str.isdigit, m[1])):
            s = line.strip()
            form = "dash" if s[0] in "—–-" else "bracket" if s[0] == "[" else "page" if s[0] in "pPsS" else "dot" if s[-1] == "." else "bare"
            out[i] = (0.0, f"{len(m[1])}{form}")
        elif want and least <= letters <= most and letters:
            got = plain(DATE.sub(" ", line))
            if abs(len(got) - len(want)) <= max(2, len(want) // 4) and (alike := likeness_to(want, got)) >= 0.6:
                out[i] = (alike, "")
    return out


def line_kinds(lines: list[str], title: str | None, alike: float = 0.75) -> list[str]:
    """What each line is by its wording alone: running text, blank, running header or page number (no model needed)."""
    out = [RUNNING if line.strip() else BLANK for line in lines]
    for i, (likeness, form) in suspects(lines, title).items():
        if form:
            out[i] = RUNNING if form in ("4bare", "4dot") else PAGE  # a bare year is text
        elif likeness >= alike:
            out[i] = HEADER
    return out


def line_features(lines: list[str], found: dict[int, tuple[float, str]]) -> dict[int, list[str]]:
    """The features of every suspect line."""
    blank = [not line.strip() for line in lines]
    titled = sum(1 for likeness, form in found.values() if not form and likeness >= 0.7)
    numbers = {i: int(d) for i, (_, form) in found.items() if form and (d := "".join(filter(str.isdigit, lines[i])))}
    out, last = {}, None
    for i, (likeness, form) in found.items():
        back = next((k for k in range(1, 4) if i - k < 0 or blank[i - k]), 4)
        ahead = next((k for k in range(1, 4) if i + k >= len(lines) or blank[i + k]), 4)
        before = next((lines[j] for j in range(i - 1, -1, -1) if not blank[j] and j not in found), "")
        after = next((lines[j] for j in range(i + 1, len(lines)) if not blank[j] and j not in found), "")
        s = lines[i].strip()
        f = ["b", f"t{min(i, 2)}", f"e{min(len(lines) - 1 - i, 2)}", f"k{back}", f"h{ahead}", f"kh{min(back, 2)}{min(ahead, 2)}", f"p{i - 1 in found}", f"n{i + 1 in found}", f"d{min((i - last) // 4, 5) if last is not None else 'x'}"]
        f += [f"f{before.rstrip()[-1:] in '.!?»“”:' if before else 'x'}{after.lstrip()[:1].islower()}", f"u{s.isupper()}", f"i{min(len(lines[i]) - len(lines[i].lstrip()), 3)}"]
        if form:
            near = any(j != i and 0 < (v - numbers.get(i, -9)) * (1 if j > i else -1) <= 3 for j, v in numbers.items())
            f += [f"N{form}", f"M{form[1:]}", f"L{form[0]}", f"q{near}"]
        else:
            f += [f"s{q}" for q in (0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95) if likeness >= q] + [f"r{min(titled, 3)}"]
        out[i] = f
        last = i
    return out


def furniture_kind(features: list[str]) -> str:
    """What a suspect line is if it is furniture: what has the form of a number can't be a title."""
    return PAGE if any(f.startswith("N") for f in features) else HEADER


def line_label(line: str, likeness: float, form: str) -> str | None:
    """What wording alone makes certain; None for the rest."""
    if form:
        return PAGE if form[1:] in ("dash", "bracket", "page") or form[1:] == "bare" and form[0] in "123" and len(line) - len(line.lstrip()) > 4 else RUNNING if form in ("4bare", "4dot") else None
    return HEADER if likeness >= 0.85 else RUNNING if likeness < 0.65 else None


def divisions(lines: list[str], kinds: list[str]) -> list[tuple[int, int, str, str, str]]:
    """(line, line it goes on in, first part, mark, second part) of every word that may be divided."""
    running = [i for i, k in enumerate(kinds) if k == RUNNING]
    out = []
    for i, j in zip(running, running[1:]):
        if lines[i].rstrip()[-1:] in MARKS and (m := DIVIDED.search(lines[i])) and (s := STARTS.match(lines[j])):
            out.append((i, j, m[1], m[2], s[1]))
    return out


# ---- the perceptron


class Ranker:
    """An averaged perceptron (with a margin) that picks one of several options, each a list of features; ties go to the first."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.total: dict[str, float] = defaultdict(float)
        self.stamp: dict[str, int] = defaultdict(int)
        self.step = 0

    def score(self, features: list[str]) -> float:
        get = self.weight.get
        return sum([get(f, 0.0) for f in features])

    def best(self, options: list[list[str]]) -> int:
        scores = [self.score(o) for o in options]
        return scores.index(max(scores))

    def learn(self, options: list[list[str]], truth: int, margin: float = 1.0) -> None:
        self.step += 1
        scores = [self.score(o) for o in options]
        got = max((i for i in range(len(options)) if i != truth), key=lambda i: scores[i])
        if scores[truth] - scores[got] >= margin:
            return
        for features, d in ((options[truth], 1.0), (options[got], -1.0)):
            for f in features:
                w = self.weight.get(f, 0.0)
                self.total[f] += (self.step - self.stamp[f]) * w
                self.stamp[f] = self.step
                self.weight[f] = w + d

    def average(self) -> None:
        step = max(self.step, 1)
        self.weight = {f: v for f, w in self.weight.items() if (v := (self.total[f] + (self.step - self.stamp[f]) * w) / step)}
        self.total, self.stamp = {}, {}

    def fit(self, examples: list[tuple[list[list[str]], int]], rounds: int) -> None:
        for _ in range(rounds):
            for options, truth in examples:
                self.learn(options, truth)
        self.average()


def labelled(labels: tuple[str, ...], features: list[str]) -> list[list[str]]:
    """Options of a choice between labels over shared features; the first has none of its own."""
    return [[], *[[f"{x}|{f}" for f in features] for x in labels]]


# ---- the editor


def rewrite(noisy: str, clean: str) -> tuple[int, str, str] | None:
    """(position, read, meant) if the two words differ in one place by at most two characters each."""
    a = 0
    while a < min(len(noisy), len(clean)) and noisy[a] == clean[a]:
        a += 1
    b = 0
    while b < min(len(noisy), len(clean)) - a and noisy[-1 - b] == clean[-1 - b]:
        b += 1
    read, meant = noisy[a : len(noisy) - b], clean[a : len(clean) - b]
    if not read and a and meant:  # an insertion is a replacement of the character before it
        a, read, meant = a - 1, noisy[a - 1], noisy[a - 1] + meant
    return (a, read, meant) if 1 <= len(read) <= 2 and len(meant) <= 2 and read != meant else None


def edit_kind(read: str, meant: str) -> str:
    return "D" if not meant else "I" if len(meant) > len(read) and meant[0] == read[0] else "R"


def edit_features(word: str, at: int, read: str, meant: str) -> list[str]:
    p = f"^{word}$"
    left, right, op, kind = p[at], p[at + 1 + len(read)], f"{read}>{meant}", edit_kind(read, meant)
    return [kind, op, f"{left}{op}", f"{op}{right}", f"{left}{op}{right}", f"{kind}{'^' if at == 0 else '$' if right == '$' else '-'}", f"{op}{len(word) > 4}"]


def few(n: int) -> int:
    """A count's size; from 16 on, counts are alike."""
    return min(int(log2(n)), 4) if n > 0 else -1


def keep_features(word: str, df: int, named: int) -> list[str]:
    mixed = any(map(str.isdigit, word))
    return ["K", f"K{few(df)}", f"Kn{named * 5 >= df}", f"Kd{mixed}", f"Kl{min(len(word), 6)}"]


def evidence(df: int, named: int, x_df: int, x_named: int, edits: int) -> list[str]:
    ratio = max(-2, min(8, int(log2(x_df / df)))) if x_df and df else -9
    return [f"e{few(x_df)}", *[f"x{r}" for r in range(-1, 9) if ratio >= r], f"xn{x_named * 5 >= x_df}", f"nn{named * 5 >= df}{x_named * 5 >= x_df}", f"two{edits}", f"two{edits}x{min(ratio, 5)}"]


class Editor:
    """The trained perceptrons, with the bounded part of the lexicon."""

    def __init__(self, rows: list[tuple[str, str, int, int, int]], size: dict[str, int], sample: list[tuple[str, str, int, int]], ends: list[tuple], lines: list[tuple], lists: list[list[str]], ratio: int = 8, rounds: int = 5):
        self.size, self.ratio = size, ratio
        self.df: dict[str, dict[str, tuple[int, int]]] = defaultdict(dict)  # documents that hold and that name a form
        self.whole: dict[str, dict[str, int]] = defaultdict(dict)  # those that hold it undivided
        for lang, word, df, named, apart in rows:
            self.df[lang][word] = (df, named)
            if df > apart:
                self.whole[lang][word] = df - apart
        self.furniture, self.joining, self.editing = Ranker(), Ranker(), Ranker()
        self.name_joining, self.name_editing = Ranker(), Ranker()
        self.furniture.fit([(labelled((furniture_kind(f),), f), int(label != RUNNING)) for f, label in lines], rounds)
        self._train_editing(self._mine(sample), sample, rounds)
        self._train_joining(ends, rounds)
        self._train_names(lists, rounds)

    # ---- training
    def _mine(self, sample: list[tuple]) -> list[tuple[str, str, int, int, int, str, str]]:
        """(lang, word, df, named, position, read, meant) of rare forms of which one frequent form is the likely source."""
        found = []
        for lang in {r[0] for r in sample}:
            index: dict[str, list[str]] = defaultdict(list)
            for v, (df, named) in self.df[lang].items():
                if df >= 2 * self.ratio and named * 5 < df and len(v) > 1 and not v.isdigit() and not v.endswith(("'", "’")):
                    for i in range(len(v) + 1):
                        for k in (0, 1, 2):
                            if i + k <= len(v):
                                index[f"{v[:i]}\x00{v[i + k:]}"].append(v)
            for _, w, df, named in (r for r in sample if r[0] == lang):
                if named * 5 >= df or len(w) < 4:
                    continue
                options: dict[str, tuple] = {}
                for i in range(len(w)):
                    for k in (1, 2):
                        for v in index.get(f"{w[:i]}\x00{w[i + k:]}", ()):
                            if v != w and v not in options and self.df[lang][v][0] >= self.ratio * df and (r := rewrite(w, v)):
                                options[v] = r
                if len(options) == 1:
                    found.append((lang, w, df, named, *next(iter(options.values()))))
        #: an edit is a misreading if many forms, all of them rare, show it: endings and spellings that vary are frequent themselves
        seen: dict[tuple[str, str], list[float]] = defaultdict(list)
        for lang, w, df, _, at, read, meant in found:
            seen[(read, meant)].append(self.df[lang][w[:at] + meant + w[at + len(read) :]][0] / df)
        least = max(2, len(found) // 400)

        def real(read: str, meant: str) -> bool:
            times = seen[(read, meant)]
            alone = edit_kind(read, meant) != "R"
            return len(times) >= least * (2 if alone else 1) and (not alone or sum(x >= 4 * self.ratio for x in times) >= 0.9 * len(times))

        return [x for x in found if real(x[5], x[6])]

    def _train_editing(self, pairs: list[tuple], sample: list[tuple], rounds: int) -> None:
        self.starts: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for read, meant in sorted({(read, meant) for *_, read, meant in pairs}):
            self.starts[read[0]].append((read, meant))
        examples = []
        truth = {(lang, w): w[:at] + meant + w[at + len(read) :] for lang, w, _, _, at, read, meant in pairs}
        good = sorted((hash_(w), lang, w, df, named) for lang, words in self.df.items() for w, (df, named) in words.items() if df >= 2 * self.ratio)
        clean = []
        for _, lang, w, df, named in good:  # frequent forms that no far more frequent one explains
            if len(clean) < max(400, 2 * len(pairs)) and all(self.df[lang].get(x, (0, 0))[0] < self.ratio * df for x, *_ in self.candidates(w, 0)):
                clean.append((lang, w, df, named))
        names = [r for r in sample if r[3] * 5 >= r[2]]
        for lang, w, df, named in sorted([x[:4] for x in pairs] + clean + names, key=lambda r: (hash_(r[1]), r[0])):
            options, results = [keep_features(w, df, named)], [w]
            for x, at, features, n in self.candidates(w, 0):
                if x in self.df[lang]:
                    options.append(features + evidence(df, named, *self.df[lang][x], n))
                    results.append(x)
            want = truth.get((lang, w), w)
            if want in results and len(options) > 1:
                examples.append((options, results.index(want)))
        self.editing.fit(examples, rounds)

    def _join_features(self, lang: str, a: str, mark: str, b: str) -> list[str]:
        held = self.whole.get(lang, {})
        joined, hyphen = held.get(a + b, 0), held.get(f"{a}-{b}", 0)
        known = "n" if not joined and not hyphen else "j" if joined >= hyphen else "h"
        case = "A" if b[0].isupper() else "9" if b[0].isdigit() else "a"
        capitals = "C" if len(a) > 1 and a.isupper() else "c"
        return ["b", f"k{known}", f"m{mark}", f"c{case}{capitals}", f"mc{mark == '-'}{case}{capitals}", f"kc{known}{case}", f"mk{mark == '-'}{known}", f"l{min(len(a), 3)}"]

    def _train_joining(self, ends: list[tuple], rounds: int) -> None:
        """Divided words are labelled by the lexicon: only one of joined and hyphenated form known, or by two whole words of which the second is a name or title."""
        examples = []
        for lang, a, mark, b in ends:
            held = self.whole.get(lang, {})
            joined, hyphen = held.get(a + b, 0), held.get(f"{a}-{b}", 0)
            if joined > 2 * hyphen:
                examples.append((labelled(("JOIN",), self._join_features(lang, a, mark, b)), 1))
            elif hyphen > 2 * joined or b[0].isupper() and not a.isupper():
                examples.append((labelled(("JOIN",), self._join_features(lang, a, mark, b)), 0))
        self.joining.fit(examples, rounds)

    def _train_names(self, lists: list[list[str]], rounds: int) -> None:
        """Lists label themselves: a form that a more frequent one explains is misread, a joined form that stands elsewhere in the list was divided."""
        joins, edits = [], []
        for names in lists:
            held = Counter(w for name in names for w in set(words_of(name)))
            for name in names:
                for m, a, b in inner_marks(name):
                    features = self._inner_features(m, a, b, held)
                    if held[a + b]:
                        joins.append((labelled(("JOIN",), features), 1))
                    elif not m[2] and m[1] == "-" or b[:1].isupper():
                        joins.append((labelled(("JOIN",), features), 0))
            for w in sorted(held):
                if len(w) < 3:
                    continue
                options, results = self._name_options(w, held)
                mixed = any(map(str.isdigit, w))
                better = [i for i, x in enumerate(results) if i and held[x] and (held[x] > held[w] or mixed)]
                if better:
                    edits.append((options, max(better, key=lambda i: (held[results[i]], -len(options[i])))))
                elif mixed and len(results) > 1:
                    edits.append((options, max(range(1, len(results)), key=lambda i: self.editing.score(options[i]))))
                elif len(results) > 1:
                    edits.append((options, 0))
        self.name_joining.fit(joins, rounds)
        self.name_editing.fit(edits, rounds)

    # ---- use
    def kinds(self, lines: list[str], title: str | None) -> list[str]:
        out = [RUNNING if line.strip() else BLANK for line in lines]
        if found := suspects(lines, title):
            for i, f in line_features(lines, found).items():
                kind = furniture_kind(f)
                out[i] = kind if self.furniture.best(labelled((kind,), f)) else RUNNING
        return out

    def joins(self, lang: str, a: str, mark: str, b: str) -> bool:
        return self.joining.best(labelled(("JOIN",), self._join_features(lang, a, mark, b))) == 1

    def candidates(self, word: str, doubles: int = 8) -> list[tuple[str, int, list[str], int]]:
        """(result, position, features, edits) of what the learned edits make of a word; two edits are tried of the likeliest ones only."""
        single = []
        for i, ch in enumerate(word):
            for read, meant in self.starts.get(ch, ()):
                if word.startswith(read, i) and len(word) > 2:
                    single.append((i, read, meant, edit_features(word, i, read, meant)))
        out = [(word[:i] + meant + word[i + len(read) :], i, f, 1) for i, read, meant, f in single]
        if doubles and len(word) > 4 and len(single) > 1:
            top = sorted(single, key=lambda e: (-self.editing.score(e[3]), e[0], e[2]))[:doubles]
            for k, first in enumerate(top):
                for second in top[k + 1 :]:
                    (p, r, m, f), (q, r2, m2, f2) = sorted((first, second))
                    if q >= p + len(r):
                        out.append((word[:p] + m + word[p + len(r) : q] + m2 + word[q + len(r2) :], p, f + f2, 2))
        return out

    def correct(self, lang: str, word: str, df: int = 1, named: int = 0) -> tuple[str, int] | None:
        """(what was meant, position of the first misread character) by the bounded lexicon alone, or None if the word is read well."""
        known = self.df.get(lang, {})
        options, results = [keep_features(word, df, named)], [None]
        for x, at, features, n in self.candidates(word):
            if x in known:
                options.append(features + evidence(df, named, *known[x], n))
                results.append((x, at))
        return results[self.editing.best(options)]

    def _inner_features(self, m: re.Match, a: str, b: str, held: Counter) -> list[str]:
        gap = "n" if "\n" in (m[2] or "") else "s" if m[2] else "0"
        case = "A" if b[:1].isupper() else "9" if b[:1].isdigit() else "a" if b else "$"
        return ["b", f"g{gap}", f"m{m[1]}", f"c{case}", f"gc{gap}{case}", f"mg{m[1] == '-'}{gap}{case}", f"k{bool(held[a + b])}"]

    def _name_options(self, word: str, held: Counter) -> tuple[list[list[str]], list[str]]:
        mixed = any(map(str.isdigit, word)) and any(map(str.isalpha, word))
        options, results = [["K", f"Kd{mixed}", f"Kc{min(held[word], 3)}"]], [word]
        for x, at, features, n in self.candidates(word):
            digits = sum(map(str.isdigit, x))
            if held[x] or mixed and n == 1 and digits < sum(map(str.isdigit, word)):
                options.append([*features, f"h{min(held[x], 3)}", f"hh{(held[x] > held[word]) - (held[x] < held[word])}", f"hd{mixed}{digits > 0}{held[x] > 0}", f"two{n}"])
                results.append(x)
        return options, results

    def mentions(self, names: list) -> tuple[list[tuple[int, str]], list]:
        """(defects by position, the repaired mentions) of one list."""
        out, joined = [], []
        held = Counter(w for name in names if name for w in set(words_of(name)))
        for i, name in enumerate(names):
            if name and any(ch in MARKS for ch in name):
                pieces, last = [], 0
                for m, a, b in inner_marks(name):
                    if self.name_joining.best(labelled(("JOIN",), self._inner_features(m, a, b, held))) == 1:
                        pieces.append(name[last : m.start()])
                        last = m.end()
                if pieces:
                    out.append((i, "broken_word"))
                    name = "".join(pieces) + name[last:]
            joined.append(name)
        fixed = list(joined)
        if out:
            held = Counter(w for name in joined if name for w in set(words_of(name)))
        if len(held) > 1 or any(any(map(str.isdigit, w)) for w in held):
            change = {}
            for w in held:
                if len(w) > 2 and (any(map(str.isdigit, w)) or any(reachable(w, v) for v in held)):
                    options, results = self._name_options(w, held)
                    if len(options) > 1 and (k := self.name_editing.best(options)):
                        change[w] = results[k]
            for i, name in enumerate(joined):
                for w in set(words_of(name)) & change.keys() if name and change else ():
                    out.append((i, "misread"))
                    fixed[i] = fixed[i].replace(w, change[w])
        return sorted(set(out)), fixed


def reachable(word: str, other: str) -> bool:
    """Whether two edits of at most two letters may turn one word into the other: a bound by length and letters."""
    return word != other and abs(len(word) - len(other)) <= 2 and len(set(word) & set(other)) >= len(set(word)) - 4


def inner_marks(name: str) -> list[tuple[re.Match, str, str]]:
    """(match, word before, word after) of every mark within a mention that may divide a word."""
    out = []
    for m in re.finditer(r"(?<=[^\W_])([" + MARKS + r"])(\s*)(?=[^\W_]|$)", name):
        if m.end() < len(name) or m[1] == "­":
            a, b = re.search(r"[^\W_]+$", name[: m.start()]), re.match(r"[^\W_]+['’]?", name[m.end() :])
            out.append((m, a[0], b[0] if b else ""))
    return out


def hash_(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 % (1 << 32)
    return h


# ---- the corpus


def _picked(df: DataFrame, text: str, lang: str, title: str, **more: str) -> DataFrame:
    cols = [F.col(text).alias("x"), F.coalesce(F.col(lang), F.lit("")).alias("l"), F.col(title).cast("string").alias("h")]
    return df.select(*cols, *[F.col(c).alias(k) for k, c in more.items()])


def statistics(df: DataFrame, text: str, lang: str, title: str, mentions: str) -> DataFrame:
    """``mentions`` is a column of lists of mentions, one list per person or place. One pass over the corpus: word forms (kind w), divided words (d) and numbers of documents (s), counted in part per task and then whole."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, named, apart = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
        ends, size = Counter(), Counter()

        def rows() -> pd.DataFrame:
            out = [("w", lang, w, n, named[lang][w], apart[lang][w], "", "", "") for lang, words in count.items() for w, n in words.items()]
            out += [("d", lang, "", n, 0, 0, a, mark, b) for (lang, a, mark, b), n in ends.items()]
            out += [("s", lang, "", n, 0, 0, "", "", "") for lang, n in size.items()]
            for c in (count, named, apart, ends, size):
                c.clear()
            return pd.DataFrame(out, columns=[x.split()[0] for x in STAT_DDL.split(", ")])

        for batch in batches:
            for x, language, names in zip(batch["x"], batch["l"], batch["m"]):
                size[language] += 1
                lines = x.split("\n")
                divided: Counter = Counter()
                for a, b in zip(lines, lines[1:]):
                    if a.rstrip()[-1:] in MARKS and (m := DIVIDED.search(a)) and (s := STARTS.match(b)):
                        ends[(language, m[1], m[2], s[1])] += 1
                        if s[1][0].islower():
                            divided[m[1] + s[1]] += 1
                joined = JOINT.sub(lambda m: "" if x[m.end()].islower() else m[0], x) if divided else x
                forms = words_of(joined)
                words = set(forms)
                if "-" in joined:
                    words.update(INNER_WORD.findall(joined))
                own = set(words_of(names)) if names else set()
                count[language].update(words)
                named[language].update(words & own)
                apart[language].update(w for w, n in divided.items() if forms.count(w) <= n)
            if sum(map(len, count.values())) > 500_000:
                yield rows()
        yield rows()

    keys = ["kind", "lang", "word", "a", "mark", "b"]
    named_here = F.concat_ws("\n", F.flatten(F.filter(mentions, lambda names: names.isNotNull())))  # as one text: lists of lists are slow to pass
    rows = _picked(df.withColumn("_names", named_here), text, lang, title, m="_names").drop("h")
    return rows.where(F.length("x") > 0).mapInPandas(work, STAT_DDL).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("df", "named", "apart")])


class Corpus:
    """The editor trained for a corpus, and the forms it changes there."""

    def __init__(self, editor: Editor, fixes: DataFrame, common: dict[str, frozenset[str]]):
        self.editor, self.fixes, self.common = editor, fixes, common


def _share(n: int, most: int) -> int:
    """The part of all 62-bit hashes that picks about ``most`` of ``n`` rows."""
    return int(min(1.0, most / max(n, 1)) * (2**62 - 1))


def train(df: DataFrame, text: str, lang: str, title: str, mentions: str, least: float = 0.0005, most_training: int = 40_000) -> Corpus:
    """The editor of a corpus and the table of its fixes.

    ``least`` bounds what every task holds (see the module), not what is found;
    ``most_training`` bounds the rare forms, the divided words and (at an
    eighth of it) the documents whose lines are used to fit.
    """
    stats = kept(statistics(df, text, lang, title, mentions))
    size = {r.lang: r.df for r in stats.where("kind = 's'").select("lang", "df").collect()}
    forms = stats.where("kind = 'w'").select("lang", "word", "df", "named", "apart")
    totals = {r[0]: r[1] for r in stats.groupBy("kind").count().collect()}
    floor = F.coalesce(*[F.when(F.col("lang") == k, F.lit(max(1.0, least * n))) for k, n in size.items()], F.lit(1.0)) if size else F.lit(1.0)
    rows = [tuple(r) for r in forms.where(F.col("df") >= floor).collect()]
    hashed = F.xxhash64("lang", "word").bitwiseAND(F.lit(2**62 - 1))
    sample = sorted(tuple(r)[:4] for r in forms.where((F.length("word") > 3) & (hashed <= _share(totals.get("w", 0), most_training))).collect())
    hashed = F.xxhash64("lang", "a", "b").bitwiseAND(F.lit(2**62 - 1))
    ends = sorted(tuple(r) for r in stats.where("kind = 'd'").where(hashed <= _share(totals.get("d", 0), most_training)).select("lang", "a", "mark", "b").collect())

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, lists = [], []
            for x, heading, names in zip(batch["x"], batch["h"], batch["m"]):
                lines = x.split("\n")
                found = suspects(lines, heading)
                out += [(f, label, []) for i, f in line_features(lines, found).items() if (label := line_label(lines[i], *found[i])) is not None]
                lists += [(None, None, list(own)) for own in names if own is not None and len(own) > 1] if names is not None else []
            yield pd.DataFrame(out + lists, columns=["f", "label", "names"])

    hashed = F.xxhash64("x").bitwiseAND(F.lit(2**62 - 1))
    lines = _picked(df, text, lang, title, m=mentions).where((F.length("x") > 0) & (hashed <= _share(sum(size.values()), most_training // 8))).mapInPandas(examples, "f array<string>, label string, names array<string>").collect()
    editor = Editor(rows, size, sample, ends, sorted((list(r.f), r.label) for r in lines if r.label is not None), sorted([x for x in r.names if x] for r in lines if r.label is None))
    fixes = kept(judged(forms, editor))
    changed = {(r.lang, r.word) for r in fixes.join(forms, ["lang", "word"]).where(F.col("df") >= floor).select("lang", "word").collect()}
    common: dict[str, set[str]] = defaultdict(set)
    for language, word, *_ in rows:
        if (language, word) not in changed:
            common[language].add(word)
    return Corpus(editor, fixes, {k: frozenset(v) for k, v in common.items()})


def judged(forms: DataFrame, editor: Editor) -> DataFrame:
    """lang, word, meant, at of the forms that the editor changes: each distinct form's candidates meet the lexicon, the best score decides."""
    shared = forms.sparkSession.sparkContext.broadcast(editor)

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for language, w, df, named in zip(batch["lang"], batch["word"], batch["df"].tolist(), batch["named"].tolist()):
                found = shared.value.candidates(w)
                if found:
                    keep = shared.value.editing.score(keep_features(w, df, named))
                    out += [(language, w, df, named, x, at, n, shared.value.editing.score(f) - keep) for x, at, f, n in found]
            yield pd.DataFrame(out, columns=["lang", "word", "df", "named", "x", "at", "n", "lead"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = shared.value.editing.score
            got = [s + score(evidence(a, b, c, d, n)) for s, a, b, c, d, n in zip(batch["lead"].tolist(), batch["df"].tolist(), batch["named"].tolist(), batch["x_df"].tolist(), batch["x_named"].tolist(), batch["n"].tolist())]
            yield batch.assign(score=got)[["lang", "word", "x", "at", "score"]]

    proposed = forms.drop("apart").mapInPandas(propose, "lang string, word string, df bigint, named bigint, x string, at int, n int, lead double")
    held = forms.select("lang", F.col("word").alias("x"), F.col("df").alias("x_df"), F.col("named").alias("x_named"))
    scored = proposed.join(held.hint("merge"), ["lang", "x"]).mapInPandas(decide, "lang string, word string, x string, at int, score double").where("score > 1e-9")
    best = F.max_by(F.struct("x", "at"), F.struct("score", F.col("x"))).alias("r")
    return scored.groupBy("lang", "word").agg(best).select("lang", "word", F.col("r.x").alias("meant"), F.col("r.at").alias("at"))


def look(text: str, lang: str, title: str | None, editor: Editor, common: frozenset[str]) -> tuple[list[str], list[str], list[tuple], list[tuple[int, str, int, int]]]:
    """lines, their kinds, the joined divisions, and (line, form, letters on this line, line it goes on in) of each form that isn't commonly right."""
    lines = text.split("\n")
    kinds = editor.kinds(lines, title)
    parts = [d for d in divisions(lines, kinds) if editor.joins(lang, d[2], d[3], d[4])]
    odd, starts, ends = [], {}, {}
    for i, j, a, _, b in parts:
        starts[j], ends[i] = STARTS.match(lines[j]).end(), len(lines[i].rstrip()) - len(a) - 1
        if (w := a + b) not in common:
            odd.append((i, w, len(a), j))
    rare = {w for w in words_of(text) if w not in common}
    for i, kind in enumerate(kinds) if rare else ():
        if kind == RUNNING and any(w in lines[i] for w in rare):
            line = lines[i][starts.get(i, 0) : max(ends.get(i, len(lines[i])), starts.get(i, 0))]
            odd += [(i, w, len(w), i) for w in words_of(line) if w not in common]
    return lines, kinds, parts, odd


def repair(text: str, lang: str, title: str | None, editor: Editor, fixes: dict[str, str]) -> str:
    """The text in continuous paragraphs, without furniture, words joined and put right."""
    lines, kinds, parts, _ = look(text, lang, title, editor, frozenset())
    starts, ends, tails = {}, {}, {}
    for i, j, a, _, b in parts:
        starts[j], ends[i] = STARTS.match(lines[j]).end(), len(lines[i].rstrip()) - len(a) - 1
        tails[i] = fixes.get(a + b, a + b)
    done = {}
    for i, kind in enumerate(kinds):
        if kind == RUNNING:
            start = starts.get(i, 0)
            end, last, pieces = max(ends.get(i, len(lines[i])), start), start, []
            if fixes:
                for p, q, w in spans_of(lines[i], start, end):
                    if w in fixes:
                        pieces += [lines[i][last:p], fixes[w]]
                        last = q
            done[i] = "".join(pieces) + lines[i][last:end] + tails.get(i, "")
    paragraphs, current, gap, furniture, last = [], [], False, False, ""
    for i, kind in enumerate(kinds):
        if kind == BLANK:
            gap = True
        elif kind != RUNNING:
            furniture = True
        else:
            indented = lines[i][:1].isspace() and not gap
            ended = gap and (not furniture or last[-1:] in ".!?»“\"" and lines[i].lstrip()[:1].isupper())
            if current and (indented or ended):
                paragraphs.append(" ".join(current))
                current = []
            gap = furniture = False
            last = done[i]
            if last.strip():
                current.append(last.strip())
    return "\n\n".join([*paragraphs, " ".join(current)] if current else paragraphs)


def defects(df: DataFrame, key: str, text: str, lang: str, title: str, corpus: Corpus) -> DataFrame:
    """record_key, pos, defect of the lines of scanned texts."""
    shared = df.sparkSession.sparkContext.broadcast((corpus.editor, corpus.common))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        editor, common = shared.value
        for batch in batches:
            out = []
            for k, x, language, heading in zip(batch["k"], batch["x"], batch["l"], batch["h"]):
                _, kinds, parts, odd = look(x, language, heading, editor, common.get(language, frozenset()))
                out += [(k, i, kind, language, None, 0, i) for i, kind in enumerate(kinds) if kind in (HEADER, PAGE)]
                out += [(k, i, "broken_word", language, None, 0, i) for i, *_ in parts]
                out += [(k, i, "misread", language, w, n, j) for i, w, n, j in set(odd)]
            yield pd.DataFrame(out, columns=["record_key", "pos", "defect", "lang", "word", "own", "next"])

    picked = _picked(df, text, lang, title, k=key).where(F.length("x") > 0)
    rows = kept(picked.mapInPandas(work, "record_key string, pos bigint, defect string, lang string, word string, own int, next bigint"))
    misread = split_join(rows.where("word is not null"), corpus.fixes, ["lang", "word"], right_hot={})
    misread = misread.select("record_key", F.when(F.col("at") < F.col("own"), F.col("pos")).otherwise(F.col("next")).alias("pos"), "defect")
    return rows.where("word is null").select("record_key", "pos", "defect").unionByName(misread)


def repaired(df: DataFrame, key: str, text: str, lang: str, title: str, corpus: Corpus) -> DataFrame:
    """key, clean_text: continuous paragraphs without furniture, divided and misread words. Keys needn't be unique."""
    shared = df.sparkSession.sparkContext.broadcast((corpus.editor, corpus.common))

    def odd(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        editor, common = shared.value
        for batch in batches:
            out = []
            for r, x, language, heading in zip(batch["r"], batch["x"], batch["l"], batch["h"]):
                out += [(r, language, w) for w in {w for _, w, *_ in look(x, language, heading, editor, common.get(language, frozenset()))[3]}]
            yield pd.DataFrame(out, columns=["r", "lang", "word"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        editor = shared.value[0]
        for batch in batches:
            texts = [repair(x, language, heading, editor, dict(f) if f is not None else {}) if x else x for x, language, heading, f in zip(batch["x"], batch["l"], batch["h"], batch["fixes"])]
            yield pd.DataFrame({"k": batch["k"], "clean_text": texts})

    picked = _picked(df, text, lang, title, k=key).withColumn("r", F.xxhash64("k", "x", "l", "h"))
    found = split_join(kept(picked.where(F.length("x") > 0).mapInPandas(odd, "r bigint, lang string, word string").distinct()), corpus.fixes, ["lang", "word"], right_hot={})
    maps = found.groupBy("r").agg(F.map_from_entries(F.collect_set(F.struct("word", "meant"))).alias("fixes"))
    return picked.join(maps.hint("merge"), "r", "left").mapInPandas(work, "k string, clean_text string").withColumnRenamed("k", key)


def mention_defects(df: DataFrame, key: str, mentions: str, corpus: Corpus) -> DataFrame:
    """record_key, pos, defect of the mentions of every row."""
    shared = df.sparkSession.sparkContext.broadcast(corpus.editor)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, i, d) for k, names in zip(batch["k"], batch["m"]) for i, d in shared.value.mentions(list(names))[0]]
            yield pd.DataFrame(out, columns=["record_key", "pos", "defect"])

    picked = df.select(F.col(key).alias("k"), F.col(mentions).alias("m")).where(F.size("m") > 0)
    return picked.mapInPandas(work, "record_key string, pos bigint, defect string")


def repaired_mentions(df: DataFrame, key: str, mentions: str, corpus: Corpus) -> DataFrame:
    """key, clean_mentions: every row's mentions without divided and misread words; null lists and entries stay null."""
    shared = df.sparkSession.sparkContext.broadcast(corpus.editor)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = [None if names is None else shared.value.mentions(list(names))[1] for names in batch["m"]]
            yield pd.DataFrame({"k": batch["k"], "clean_mentions": lists})

    picked = df.select(F.col(key).alias("k"), F.col(mentions).alias("m"))
    return picked.mapInPandas(work, "k string, clean_mentions array<string>").withColumnRenamed("k", key)


def continuous_words(text: str, title: str | None) -> list[str]:
    """The words of a scanned text, furniture, line breaks and word divisions left aside (no model needed)."""
    lines = text.split("\n")
    kinds = line_kinds(lines, title)
    body = "\n".join(x for x, k in zip(lines, kinds) if k == RUNNING)
    body = JOINT.sub("", body).casefold()
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", body) if COMBINING.search(body) else re.findall(r"[^\W_]+", body)
