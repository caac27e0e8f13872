"""Sentence boundaries across languages and scripts by a finite transducer.

The boundary rules are compiled into one table: a Mealy machine over *events*
(final marks, openers and closers of quotations and brackets, empty lines),
whose states say whether a sentence has begun and in which quotation or
bracket the reader stands. A lexer of array operations turns the characters
of a whole batch of documents into events; what a mark's neighbours say (the
word before it, the kind of character after it) is folded into the event.

The event stream of a batch is cut into chunks of equal length, wherever
documents begin and end. Each chunk is first run as a *state-transition
function* (all states at once), the functions are composed by a parallel
prefix scan, and then every chunk is run again from its now known state to
emit boundaries. The longest document thus costs no more steps than a short one.

Defined results for odd input: null, empty and all-blank texts give no
sentences; unbalanced quotations end at the next empty line; repeated rows
each get their sentences; extra columns are ignored; positions are code points.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import fold

#: Abbreviations after which a name or another word follows, by language ("" for any).
TITLES = {
    "": "mr mrs ms dr prof st mme mlle sr sra srta mgr",
    "en": "messrs capt rev col gen lieut lt sgt hon gov pres esq jun sen rt",
    "fr": "mm cap me ste vve abbé ing",
    "de": "hr fr frl hptm geb vgl bzw dgl inkl bes hrn hl gebr verw",
    "es": "excmo excma ilmo dña dn srs sres pbro",
    "it": "sig sigg dott avv on ing geom cav comm rag arch",
    "ru": "им проф гр ул д-р акад св инж",
    "el": "κ δρ καθ κκ αγ",
    "hi": "प्रो डॉ श्री रु कु",
}
#: Units and the like; they end a sentence only if the next word starts one.
UNITS = {
    "": "a.m p.m fr frs",
    "en": "dols ft inst ult prox lbs doz cwt",
    "fr": "env h c.-à-d",
    "de": "t uhr mk",
    "es": "ptas pts",
    "it": "lit",
    "ru": "г руб коп гг т.е",
    "el": "δρχ π.χ",
}
#: Abbreviations that stand before a number.
BEFORE_NUMBER = "no nr n° nos p pp s v vol art ca c cap num núm tel fig bd t nro №  стр с σελ αρ"
#: Names of the months that follow an ordinal in German.
MONTHS = "januar jänner februar märz april mai juni juli august september oktober november dezember"

# kinds of characters
OTHER, LOWER, UPPER, CASELESS, KANA, DIGIT, SPACE, NEWLINE, DOT, BANG, WIDE, SEMI, OPEN_Q, CLOSE_Q, STRAIGHT, DUAL, OPEN_B, CLOSE_B, CONT, DASH, COLON, APOS, END = range(23)
LETTERS = (LOWER, UPPER, CASELESS, KANA)

# what follows a mark
N_CONT, N_START, N_CASELESS, N_KANA, N_CAPS = range(5)
# events
E_PARA, E_STRONG, E_WEAK, E_OPEN_Q, E_OPEN_QC, E_OPEN_B, E_CLOSE, E_PAD = 0, 1, 2, 3, 4, 5, 6, 11
N_EVENTS = 12  # E_CLOSE + (what follows): 6..10
CHUNK = 64


def _states() -> dict[tuple, int]:
    """(outer, inner depth, inner mark): outer is '' outside; inner mark: a final mark was the last thing inside."""
    out = {("start",): 0, ("body",): 1}
    for outer in ("QS", "QM", "QC", "BS", "BM"):
        for depth in range(3):
            for final in (False, True):
                out[(outer, depth, final)] = len(out)
    return out


@functools.cache
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emits a boundary), both [state, event * 2 + content stands before it]."""
    states = _states()
    move = np.zeros((len(states), N_EVENTS * 2), dtype=np.uint8)
    emit = np.zeros_like(move, dtype=bool)
    for state, i in states.items():
        for event in range(N_EVENTS):
            for content in (0, 1):
                to, out = _step(state, event, content)
                move[i, event * 2 + content], emit[i, event * 2 + content] = states[to], out
    return move, emit


def _step(state: tuple, event: int, content: int) -> tuple[tuple, bool]:
    """The boundary rules, for one state and event."""
    if event == E_PAD:
        return state, False
    if event == E_PARA:
        return ("start",), False
    if len(state) == 1:
        begun = state[0] == "body" or content
        if event == E_STRONG:
            return ("start",), True
        if event in (E_OPEN_Q, E_OPEN_QC):
            return ("QC" if begun and event == E_OPEN_QC else "QM" if begun else "QS", 0, False), False
        if event == E_OPEN_B:
            return ("BM" if begun else "BS", 0, False), False
        return ("body",), False  # weak marks; closers that nothing opened
    outer, depth, final = state
    if content:
        final = False
    if event in (E_STRONG, E_WEAK):
        return (outer, depth, True), False
    if event in (E_OPEN_Q, E_OPEN_QC, E_OPEN_B):
        return (outer, min(depth + 1, 2), False), False
    if depth:
        return (outer, depth - 1, final), False
    follows = event - E_CLOSE
    ends = final and outer != "BM" and (follows == N_START or outer == "QC" and follows in (N_CASELESS, N_CAPS) or outer == "QM" and follows == N_CAPS)
    return (("start",), True) if ends else (("body",), False)


@functools.cache
def kinds() -> np.ndarray:
    """The kind of each (folded) code point."""
    out = np.full(fold.N, CASELESS, dtype=np.uint8)
    for o in range(0x3400):
        ch = chr(o)
        cat = unicodedata.category(ch)
        if cat in ("Lu", "Lt"):
            out[o] = UPPER
        elif cat == "Ll":
            out[o] = LOWER
        elif cat[0] in "LM":
            out[o] = CASELESS
        elif cat == "Nd":
            out[o] = DIGIT
        elif ch.isspace() and not 0x1C <= o <= 0x1F:
            out[o] = SPACE
        elif cat == "Pd":
            out[o] = DASH
        else:
            out[o] = OTHER
    out[0x3041:0x3097] = KANA
    out[0xFF00:0xFFF0] = OTHER
    for chars, kind in (("\n", NEWLINE), (".", DOT), ("!?…", BANG), ("。।॥！？｡։؟۔", WIDE), (";;", SEMI), ("«„「『‚‹", OPEN_Q), ("»”」』›", CLOSE_Q), ('"', STRAIGHT), ("“", DUAL), ("([{（【", OPEN_B), (")]}）】", CLOSE_B), (",、，", CONT), (":：", COLON), ("'’‘", APOS), ("¿¡", UPPER)):
        for ch in chars:
            out[ord(ch)] = kind
    out[0] = END
    return out


def _word_hashes(words: str) -> np.ndarray:
    return np.unique([_hash(w) for w in words.split()])


def _hash(word: str) -> np.uint64:
    h = 0
    for k, ch in enumerate(reversed(word)):
        h = (h + (ord(ch) + 1) * pow(1099511628211, k + 1, 1 << 64)) % (1 << 64)
    return np.uint64(h)


@functools.cache
def _lists() -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray, np.ndarray]:
    def by_language(lists: dict[str, str]) -> dict[str, np.ndarray]:
        out = {k: _word_hashes(fold.skeleton(lists.get("", "") + " " + v)) for k, v in lists.items()}
        return out | {"?": _word_hashes(fold.skeleton(" ".join(lists.values())))}

    return by_language(TITLES), by_language(UNITS), _word_hashes(fold.skeleton(BEFORE_NUMBER)), _word_hashes(fold.skeleton(MONTHS))


#: A text without language is judged by stretches of so many characters.
STRETCH = 4000


@functools.cache
def _lower() -> np.ndarray:
    out = np.arange(fold.N, dtype=np.uint32)
    for o in range(0x3400):
        low = chr(o).lower()
        out[o] = ord(low) if len(low) == 1 else o
    return out


def _guess(text: str) -> str:
    """The language of a stretch of text without one: German by its commonest words, else any."""
    t = f" {text.lower()} "
    return "de" if t.count(" der ") + t.count(" die ") + t.count(" und ") >= 2 else "?"


def split(texts: list[str], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, start, end) of every sentence of the texts."""
    sep = "\x00"
    if any(sep in x for x in texts):
        texts = [x.replace(sep, "\x01") for x in texts]
    points = fold.codes(sep + sep.join(texts) + sep)
    table, _ = fold.tables()
    folded = table[points]
    ends_at = np.flatnonzero(points == 0)
    folded[ends_at] = 0x110000 - 1
    keep = np.flatnonzero(folded != fold.IGNORED)
    c = folded[keep]
    original = points[keep]
    c[c == 0x110000 - 1] = 0
    kind = kinds()[c]
    n = len(c)
    idx = np.arange(n)
    doc = np.cumsum(c == 0) - 1
    #: languages by document
    thai, greek = (np.bincount(doc, (original >= a) & (original < b), minlength=len(texts) + 1) for a, b in ((0xE00, 0xE80), (0x370, 0x400)))
    letters = np.bincount(doc, np.isin(kind, LETTERS), minlength=len(texts) + 1)
    names = [(x or "").strip().lower()[:2] for x in langs] + [""]
    lang = np.array([w if w in TITLES or w in UNITS else "" for w in names], dtype=object)
    guessed: dict[int, np.ndarray] = {}  # of long texts, by stretch
    for i, w in enumerate(names[:-1]):
        if not w:
            stretches = [_guess(texts[i][max(0, a - STRETCH // 2) : a + STRETCH * 3 // 2] if a else texts[i][:STRETCH]) for a in range(0, max(len(texts[i]), 1), STRETCH)]
            lang[i] = stretches[0]
            if len(set(stretches)) > 1:
                guessed[i] = np.array(stretches, dtype=object)
    is_thai = ((thai * 2 > letters) & (letters > 0))[doc]
    is_greek = ((greek * 2 > letters) & (letters > 0))[doc]

    def ahead(mask: np.ndarray) -> np.ndarray:
        """For each position, the next one at or after it where mask holds (n if none)."""
        return np.minimum.accumulate(np.where(mask, idx, n)[::-1])[::-1]

    blank = (kind == SPACE) | (kind == NEWLINE)
    solid_next = np.append(ahead(~blank), [n, n])
    solid_prev = np.maximum.accumulate(np.where(~blank, idx, -1))
    kind2 = np.append(kind, [END, END, END])
    c2 = np.append(c, [0, 0, 0])
    #: an empty line between two solid characters
    lines = np.append(np.cumsum(kind == NEWLINE), 0)
    prev_solid = np.concatenate([[-1], solid_prev[:-1]])
    prev_kind = np.where(prev_solid >= 0, kind2[prev_solid], END)
    gap_lines = np.where(prev_solid >= 0, lines[idx] - lines[prev_solid] - (kind == NEWLINE), 0)
    para = ~blank & ((gap_lines >= 2) | (kind == END) | (prev_kind == END))

    # ---- marks
    semi = (kind == SEMI) & is_greek
    mark = (kind == DOT) | (kind == BANG) | (kind == WIDE) | semi
    run_end = mark & ~np.append(mark[1:], False)
    at = np.flatnonzero(run_end)
    single = ~mark[at - 1]
    dots = (kind[at] == DOT) & single
    ellipsis = ((kind[at] == DOT) & ~single & (kind[at - 1] == DOT)) | (c[at] == ord("…"))
    nxt = solid_next[at + 1]
    nk = kind2[nxt]
    gap_para = np.append(para, [True, True])[nxt]
    glued = nxt == at + 1
    caps = _caps(kind2, nxt, at)
    begins = (nk == UPPER) | (nk == DIGIT) | (nk == OPEN_Q) | (nk == STRAIGHT) | (nk == DUAL) | (nk == OPEN_B) | (nk == CASELESS) | (nk == KANA) | (nk == END) | (nk == OTHER) | gap_para
    closes = (nk == CLOSE_Q) | (nk == CLOSE_B) | (glued & ((nk == STRAIGHT) | (nk == DUAL)))
    begins |= (nk == DASH) & ~glued & (kind[at] != BANG)
    wide = kind[at] == WIDE
    strong = begins | closes | wide
    strong &= ~((kind[at] == BANG) & (nk == LOWER))
    #: a dot after a word
    pos = at[dots]
    h, length, has_dot = _word_before(c, kind, pos)
    title, unit = np.zeros(len(pos), bool), np.zeros(len(pos), bool)
    titles, units, numbers, months = _lists()
    codes_ = lang[doc[pos]]
    for i, stretches in guessed.items():
        m = np.flatnonzero(doc[pos] == i)
        codes_[m] = stretches[(keep[pos[m]] - ends_at[i] - 1) // STRETCH]
    for name in set(codes_):
        m = codes_ == name
        title[m] = np.isin(h[m], titles.get(name, titles[""]))
        unit[m] = np.isin(h[m], units.get(name, units[""]))
    after, after_kind = nxt[dots], nk[dots]
    before_digit = kind[pos - 1] == DIGIT
    digits = _digits_before(kind, pos)
    number = before_digit & (kind2[pos + 1] == DIGIT)
    initial = (length == 1) & (kind[pos - 1] != DIGIT) & ~np.isin(kind[pos - 1], (CASELESS, KANA))
    listed = np.isin(h, numbers) & (after_kind == DIGIT)
    ordinal = before_digit & (digits <= 2) & (codes_ == "de") & ((after_kind == DIGIT) | (after_kind == UPPER)) & ~gap_para[dots]
    ordinal |= before_digit & (digits <= 2) & (after_kind == UPPER) & np.isin(_word_after(c2, kind2, after), months)
    in_caps = caps[dots]
    abbreviated = title | initial | listed | (unit & (in_caps | (after_kind == OPEN_B))) | has_dot
    abbreviated &= ~gap_para[dots]
    in_word = glued[dots] & ((after_kind == LOWER) | (after_kind == DASH) | (after_kind == APOS) | (after_kind == COLON) | (after_kind == CONT))
    weak = number | ordinal | abbreviated | in_word
    weak |= (lang[doc[pos]] == "hi") & np.isin(kind[pos - 1], (CASELESS,)) & ~gap_para[dots]
    weak |= is_thai[pos]
    strong[dots] &= ~weak
    #: ellipsis that the sentence runs on from
    loose = ellipsis & (np.isin(kind[np.maximum(at - 3, 0)], (SPACE, NEWLINE)) | (kind[np.maximum(at - 1, 0)] == SPACE))
    strong &= ~(ellipsis & ((nk == LOWER) | (loose & caps)) & ~gap_para)
    is_strong = np.zeros(n, bool)
    is_strong[at[strong]] = True
    is_weak = run_end & ~is_strong
    if (thai_space := blank & is_thai).any():
        #: in Thai a space ends a sentence unless it stands next to a numeral; a line break doesn't
        first = thai_space & ~np.concatenate([[False], blank[:-1]])
        p = np.flatnonzero(first)
        q = np.append(ahead(~blank), n)[p]
        breaks = lines[np.minimum(q, n - 1)] - lines[np.maximum(p - 1, 0)]
        ok = (kind2[q] != DIGIT) & (kind[p - 1] != DIGIT) & (breaks == 0) & (kind2[q] != END) & (kind[p - 1] != END)
        is_strong[p[ok] - 1] = True
        is_weak[p[ok] - 1] = False

    # ---- quotations and brackets
    opens_q, closes_q = kind == OPEN_Q, kind == CLOSE_Q
    dual = np.flatnonzero(kind == DUAL)
    if len(dual):
        #: “ closes where „ or “ stands open in the paragraph, else opens
        low = np.cumsum(c == ord("„"))
        used = np.cumsum(kind == DUAL)
        block = np.cumsum(para)
        base_low, base_dual = _per_block(block, low, c == ord("„")), _per_block(block, used, kind == DUAL)
        german = (low[dual] - base_low[dual]) > (used[dual] - 1 - base_dual[dual])
        opens_q[dual[~german]] = True
        closes_q[dual[german]] = True
    straight = np.flatnonzero(kind == STRAIGHT)
    if len(straight):
        block = np.cumsum(para)
        count = np.cumsum(kind == STRAIGHT)
        odd = (count[straight] - _per_block(block, count, kind == STRAIGHT)[straight]) % 2 == 1
        opens_q[straight[odd]] = True
        closes_q[straight[~odd]] = True
    opens_b, closes_b = kind == OPEN_B, kind == CLOSE_B
    intro = opens_q & (prev_kind == COLON)

    event = np.full(n, E_PAD, dtype=np.uint8)
    event[is_weak], event[is_strong] = E_WEAK, E_STRONG
    event[opens_q], event[intro], event[opens_b] = E_OPEN_Q, E_OPEN_QC, E_OPEN_B
    close = np.flatnonzero(closes_q | closes_b)
    if len(close):
        #: what follows a run of closers
        nx = solid_next[close + 1]
        k = kind2[nx]
        follow = np.full(len(close), N_CONT, np.uint8)
        follow[np.isin(k, (DIGIT, OPEN_Q, STRAIGHT, DUAL, OPEN_B, END, UPPER)) | np.append(para, [True, True])[nx]] = N_START
        follow[k == CASELESS] = N_CASELESS
        follow[k == KANA] = N_KANA
        follow[(k == UPPER) & _caps(kind2, nx, close) & ~np.append(para, [True, True])[nx]] = N_CAPS
        event[close] = E_CLOSE + follow
    starts = para & (event == E_PAD)
    event[starts] = E_PARA
    where = np.flatnonzero(event != E_PAD)
    #: a paragraph that starts with an opener or mark needs both events
    both = np.flatnonzero(para & ~starts)
    content = np.append(0, np.cumsum(~blank & (event == E_PAD) & ~mark | starts & (kind != END)))
    order = np.argsort(np.concatenate([where * 2 + 1, both * 2]), kind="stable")
    places = np.concatenate([where, both])[order]
    names_ = np.concatenate([event[where], np.full(len(both), E_PARA, np.uint8)])[order]
    seen = content[places]
    before = np.diff(np.append(0, seen)) > 0
    out = run(names_.astype(np.int64) * 2 + before)
    cut = np.zeros(n + 1, bool)
    cut[places[out] + 1] = True
    #: closers that nothing opened belong to the sentence that ends before them
    cut[np.flatnonzero(para)] = True
    bounds = np.flatnonzero(cut)
    a, b = bounds[:-1], bounds[1:]
    a = solid_next[a]
    b = solid_prev[b - 1] + 1
    ok = (a < b) & (kind2[np.minimum(a, n)] != END)
    a, b = a[ok], b[ok]
    number_ = doc[a]
    base = keep[np.flatnonzero(c == 0)[number_]] + 1
    return number_, keep[a] - base, keep[b - 1] + 1 - base


def _caps(kind2: np.ndarray, nxt: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words on both sides are in capitals (two or more letters ahead), so case tells nothing."""
    n = len(kind2) - 3
    nxt = np.minimum(nxt, n)
    ahead = (kind2[nxt] == UPPER) & (kind2[nxt + 1] == UPPER)
    back = np.zeros(len(at), bool)
    for k in range(1, 8):
        p = np.maximum(at - k, 0)
        q = np.maximum(at - k - 1, 0)
        back |= (kind2[p] == UPPER) & (kind2[q] == UPPER)
    lower_back = np.zeros(len(at), bool)
    for k in range(1, 8):
        lower_back |= kind2[np.maximum(at - k, 0)] == LOWER
    return ahead & back & ~lower_back


def _per_block(block: np.ndarray, running: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """The running count as it stood before the block of each position began."""
    first = np.flatnonzero(np.diff(np.append(-1, block)))
    before = running[first] - (own[first] if own is not None else 0)
    return before[np.searchsorted(first, np.arange(len(block)), side="right") - 1]


MULTIPLIERS = np.array([pow(1099511628211, k + 1, 1 << 64) for k in range(10)], dtype=np.uint64)


def _word_before(c: np.ndarray, kind: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, letters, holds a dot itself) of the word of up to 8 characters that ends before each position."""
    h = np.zeros(len(pos), np.uint64)
    length = np.zeros(len(pos), np.int64)
    alive = np.ones(len(pos), bool)
    dotted = np.zeros(len(pos), bool)
    lower = _lower()
    for k in range(9):
        p = np.maximum(pos - 1 - k, 0)
        kk = kind[p]
        letter = (kk == LOWER) | (kk == UPPER) | (kk == CASELESS) | (kk == KANA) | (c[p] == ord("°"))
        inner = (kk == DOT) & (k > 0) & alive
        alive &= letter | inner
        h = np.where(alive, h + (lower[c[p]].astype(np.uint64) + np.uint64(1)) * MULTIPLIERS[k], h)
        length += alive
        dotted |= inner & alive
    return h, length, dotted & (length <= 5)


def _word_after(c2: np.ndarray, kind2: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the word of up to 9 letters that starts at each position."""
    n = len(c2) - 1
    lower = _lower()
    end = at.copy()
    alive = np.ones(len(at), bool)
    for _ in range(10):
        alive &= np.isin(kind2[np.minimum(end, n)], (LOWER, UPPER))
        end = end + alive
    h = np.zeros(len(at), np.uint64)
    for k in range(10):
        p = end - 1 - k
        ok = p >= at
        h = np.where(ok, h + (lower[c2[np.clip(p, 0, n)]].astype(np.uint64) + np.uint64(1)) * MULTIPLIERS[min(k, 9)], h)
    return h


def _digits_before(kind: np.ndarray, pos: np.ndarray) -> np.ndarray:
    out = np.zeros(len(pos), np.int64)
    alive = np.ones(len(pos), bool)
    for k in range(4):
        alive &= kind[np.maximum(pos - 1 - k, 0)] == DIGIT
        out += alive
    return out


def run(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Which events emit a boundary, the stream being read from the start state.

    1. every chunk as a function from states to states, all chunks at once;
    2. an inclusive prefix scan that composes the functions;
    3. every chunk again, from the state that the scan gives it.
    """
    move, emit = transducer()
    m = -(-len(symbols) // chunk)
    grid = np.full(m * chunk, E_PAD * 2, np.int64)
    grid[: len(symbols)] = symbols
    grid = grid.reshape(m, chunk)
    flat = move.ravel()
    width = move.shape[1]
    f = np.tile(np.arange(len(move), dtype=np.int64), (m, 1))
    for t in range(chunk):
        f = flat[f * width + grid[:, t, None]].astype(np.int64)
    d = 1
    while d < m:
        f[d:] = f[d:][np.arange(m - d)[:, None], f[:-d]]
        d *= 2
    state = np.append(0, f[:-1, 0])
    out = np.zeros((m, chunk), bool)
    flat_out = emit.ravel()
    for t in range(chunk):
        at = state * width + grid[:, t]
        out[:, t] = flat_out[at]
        state = flat[at].astype(np.int64)
    return out.ravel()[: len(symbols)]


def sentences(df: DataFrame, key: str, text: str, lang: str | None = None, chars_at_once: int = 500_000) -> DataFrame:
    """One row per sentence: the key (cast to string only if it isn't an integer), start_char, end_char (exclusive).

    Without shuffle: documents are read as they lie, whole; batches are cut by
    characters so that memory stays flat whatever the lengths.
    """
    kind = dict(df.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["t"].str.len().to_numpy()
            groups = np.cumsum(lengths) // chars_at_once
            for _, part in batch.groupby(groups):
                number, a, b = split(part["t"].tolist(), part["l"].tolist())
                yield pd.DataFrame({"k": part["k"].to_numpy()[number], "start_char": a, "end_char": b})

    picked = df.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("l")).where(F.length("t") > 0)
    return picked.mapInPandas(work, f"k {kind}, start_char bigint, end_char bigint").withColumnRenamed("k", key)
