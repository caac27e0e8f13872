"""One consistent form for texts that look alike but differ in their characters.

1. Every token of the corpus is counted (partial counts per batch, then by
   token). A token is *plain* if it is composed, has no ignorable, wide or
   otherwise foreign form and keeps to one script; all others are *odd*.
2. Tokens are spread by the hash of their skeleton. Each part of the
   vocabulary becomes a trie over the spellings of its plain tokens, and a
   weighted edit automaton walks it with every odd token: putting one
   look-alike for another or skipping an ignorable costs nothing, anything
   else costs one, and only walks of cost 0 are kept. Of the spellings
   reached, the most frequent is canonical (ties: the smallest).
3. Odd tokens that match nothing are normalised by the table of ``fold``;
   so are tokens made of look-alike letters alone, whose script no letter tells.
4. Texts without odd tokens are their own canonical form, but for spaces.

A token's canonical form depends on its skeleton only, so canonical texts are
equal exactly where the texts look the same.

Defined results for odd input: null texts stay null and empty ones empty;
texts of white space only keep their lines and the number of their spaces;
repeated documents are each normalised; extra columns are kept, but for one of
the result's name.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import split_join
from ..session import cut, kept
from . import fold

LATIN, GREEK_ALIKE, CYRILLIC_ALIKE, GREEK_OWN, CYRILLIC_OWN, FOREIGN = 1, 2, 4, 8, 16, 32
PLAIN = frozenset({0, LATIN, GREEK_OWN, GREEK_OWN | GREEK_ALIKE, CYRILLIC_OWN, CYRILLIC_OWN | CYRILLIC_ALIKE})
ALIKE_ONLY = frozenset({GREEK_ALIKE, CYRILLIC_ALIKE})
BREAKS = re.compile(r"(\s+)")
TOKEN_DDL = "token string, skeleton string, plain boolean, n bigint"


@functools.cache
def marks() -> np.ndarray:
    """Bits that tell what a character says about its token."""
    table, longer = fold.tables()
    out = np.zeros(fold.N, dtype=np.uint8)
    preferred: dict[tuple[str, int], int] = {}
    for o in range(0x41, 0x3400):
        ch = chr(o)
        name = unicodedata.name(ch, "")
        script = "L" if name.startswith("LATIN") else "G" if name.startswith("GREEK") else "C" if name.startswith(("CYRILLIC", "ARMENIAN", "COPTIC")) else ""
        to = int(table[o])
        foreign = o in longer or to != o and not script or to != o and script == "L" or unicodedata.normalize("NFC", ch) != ch
        if foreign and not ch.isspace():
            out[o] = FOREIGN
        elif script == "L" and ch.isalpha():
            out[o] = LATIN
        elif script in ("G", "C"):
            first = preferred.setdefault((script, to), o)
            alike, own = (GREEK_ALIKE, GREEK_OWN) if script == "G" else (CYRILLIC_ALIKE, CYRILLIC_OWN)
            out[o] = FOREIGN if first != o else alike if to != o else own
    for a, b in ((0xF900, 0x10000), (0x1D400, 0x1D800), (0x2F800, 0x2FA20)):
        out[a:b] = np.where(table[a:b] != np.arange(a, b), FOREIGN, 0)
    out[[o for o in longer]] = FOREIGN
    for a, b in ((0x300, 0x370), (0x483, 0x488), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0x3099, 0x309B)):
        out[a:b] = FOREIGN
    out[(table == fold.IGNORED) & (np.arange(fold.N) > 0)] = FOREIGN
    return out


def bits(texts: list[str]) -> np.ndarray:
    """The union of the characters' bits, for each (non-empty) text."""
    if not texts:
        return np.zeros(0, np.uint8)
    starts = np.cumsum([0] + [len(x) for x in texts[:-1]])
    return np.bitwise_or.reduceat(marks()[fold.codes("".join(texts))], starts)


def tokens(batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct tokens, how often, bits)."""
    count: Counter = Counter()
    for text in batch:
        count.update(text.split())
    words = list(count)
    return words, np.fromiter(count.values(), np.int64, len(words)), bits(words)


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """token, skeleton, plain, n over the whole corpus; tokens of look-alikes only are left to the table."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, n, b = tokens(batch["t"].tolist())
            plain = np.isin(b, list(PLAIN))
            keep = np.flatnonzero((b != 0) & ~np.isin(b, list(ALIKE_ONLY)))
            words = [words[i] for i in keep]
            skeleton = fold.skeletons(words)
            if not words:
                continue
            yield pd.DataFrame({"token": words, "skeleton": skeleton, "plain": plain[keep], "n": n[keep]})

    rows = df.select(F.col(text).alias("t")).where(F.length("t") > 0).mapInPandas(work, TOKEN_DDL)
    return rows.groupBy("token", "skeleton", "plain").agg(F.sum("n").alias("n"))


class Trie:
    """Spellings with their frequency; ``walk`` is the weighted edit automaton."""

    def __init__(self, spellings: list[tuple[str, int]]):
        self.root: dict = {}
        for word, n in spellings:
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node[""] = (n, word)

    def walk(self, word: str, most: int = 0) -> list[tuple[int, int, str]]:
        """(cost, -frequency, spelling) of every spelling within ``most`` edits, cheapest and most frequent first."""
        table, longer = fold.tables()
        letters: list[str] = []
        for ch in unicodedata.normalize("NFC", word):
            letters += longer.get(ord(ch), ch)
        alike = [chr(table[ord(x)]) if table[ord(x)] else "" for x in letters]
        composed = unicodedata.normalize("NFC", "".join(alike))
        if len(composed) != len("".join(alike)):  # marks that only compose once look-alikes are replaced
            letters = alike = list(composed)
        found: dict[str, tuple[int, int, str]] = {}
        best: dict[tuple[int, int], int] = {}
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, cost = stack.pop()
            if best.get((id(node), at), most + 1) <= cost:
                continue
            best[(id(node), at)] = cost
            if at == len(letters) and "" in node:
                n, spelling = node[""]
                if spelling not in found or found[spelling][0] > cost:
                    found[spelling] = (cost, -n, spelling)
            if at < len(letters):
                skip = cost + (alike[at] != "")
                if skip <= most:
                    stack.append((node, at + 1, skip))
            for ch, below in node.items():
                if ch == "":
                    continue
                if at < len(letters):
                    step = cost + (ch != letters[at] and chr(table[ord(ch)]) != alike[at])
                    if step <= most:
                        stack.append((below, at + 1, step))
                if cost < most:
                    stack.append((below, at, cost + 1))
        return sorted(found.values())


def spellings(df: DataFrame, text: str) -> DataFrame:
    """odd token -> canonical spelling, for every odd token of the corpus."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trie = Trie([(r["token"], int(r["n"])) for group in batch["plain"] for r in group])
            out = []
            for group, skeleton in zip(batch["odd"], batch["skeleton"]):
                for token in group:
                    reached = trie.walk(token)
                    out.append((token, reached[0][2] if reached else skeleton))
            if out:
                yield pd.DataFrame(out, columns=["token", "canonical"])

    counted = token_counts(df, text)
    plain = F.collect_list(F.when(F.col("plain"), F.struct("token", "n")))
    odd = F.collect_list(F.when(~F.col("plain"), F.col("token")))
    #: spellings of one skeleton are as few as its letters have forms; a batch of skeletons shares one trie
    grouped = counted.groupBy("skeleton").agg(plain.alias("plain"), odd.alias("odd")).where(F.size("odd") > 0)
    return grouped.mapInPandas(work, "token string, canonical string")


def _rewrite(text: str, spelled: dict[str, str]) -> str:
    parts = BREAKS.split(text)
    words = parts[::2]
    which = [i for i, w in enumerate(words) if w]
    for i, b in zip(which, bits([words[i] for i in which]).tolist()):
        if b in ALIKE_ONLY:
            words[i] = fold.skeleton(words[i])
        elif b not in PLAIN:
            words[i] = spelled.get(words[i]) or fold.skeleton(words[i])
    parts[::2] = words
    parts[1::2] = [x if x.isascii() else fold.skeleton(x) for x in parts[1::2]]
    return "".join(parts)


def canonical(df: DataFrame, key: str, text: str, out: str = "canonical_text") -> DataFrame:
    """``df`` with its canonical text. Keys needn't be unique.

    Only documents with odd tokens are joined with the spellings: each row is
    exploded to its distinct odd tokens, which meet their spelling by token.
    """
    df = df.drop(out, "_row", "_text", "_spelled")  # a column of the result's name gives way to it
    slim = df.select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("_row"), F.col(text).alias("t"))

    def odd(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, found = [], []
            raw = bits(batch["t"].tolist()) if len(batch) else []
            for row, x, b in zip(batch["_row"], batch["t"], raw):
                if int(b) in PLAIN and int(b) not in ALIKE_ONLY:
                    continue
                words = list(dict.fromkeys(x.split()))
                for w, wb in zip(words, bits(words).tolist()):
                    if wb not in PLAIN and wb not in ALIKE_ONLY:
                        rows.append(row)
                        found.append(w)
            if rows:
                yield pd.DataFrame({"_row": np.array(rows, np.int64), "token": found})

    needed = kept(slim.where(F.length("t") > 0).mapInPandas(odd, "_row bigint, token string").distinct())
    maps = split_join(needed, spellings(df, text), ["token"], right_hot={}).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("token", "canonical"))).alias("_spelled"))

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, flags = batch["_text"].tolist(), np.zeros(len(batch), np.uint8)
            which = [i for i, x in enumerate(texts) if x]
            flags[which] = bits([texts[i] for i in which])
            spelled = batch.pop("_spelled")
            for i in which:
                if not texts[i].isascii() and (int(flags[i]) not in (0, LATIN) or not texts[i].isprintable() or any(x in texts[i] for x in fold_spaces())):
                    texts[i] = _rewrite(texts[i], dict(spelled.iloc[i]) if spelled.iloc[i] is not None else {})
            batch[out] = texts
            yield batch.drop(columns="_text")

    joined = df.select("*", F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("_row"), F.col(text).alias("_text")).join(maps, "_row", "left").drop("_row")
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` string"
    return joined.mapInPandas(rewrite, schema)


@functools.cache
def fold_spaces() -> str:
    """The spaces that become ordinary ones."""
    table, _ = fold.tables()
    return "".join(chr(o) for o in np.flatnonzero(table == 0x20) if o != 0x20)


def digest(c: str) -> Column:
    """128 bits of a text's SHA-256, packed."""
    return F.unhex(F.substring(F.sha2(F.col(c), 256), 1, 32))


def alike_classes(df: DataFrame, key: str, text: str, per_task: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Members (key, look, raw, n_alike) and links (look, raw_a, raw_b) of the texts that look like others.

    ``look`` names what a text looks like and ``raw`` its spelling; the rows
    that look the same and are spelt differently are ``n_alike``. A link is a
    pair of spellings (raw_a < raw_b) of one look, however many rows have
    them: copies are counted, never paired.
    """
    slim = canonical(df.select(key, text).where(F.length(text) > 0), key, text, "_canonical")
    rows = cut(slim.select(F.col(key), digest("_canonical").alias("look"), digest(text).alias("raw")))
    spelt = rows.groupBy("look", "raw").agg(F.count("*").alias("n"))
    looks = spelt.groupBy("look").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("kinds > 1").drop("kinds")
    some = cut(spelt.join(looks.hint("merge"), "look"))  # spellings of looks that have several
    largest = some.agg(F.max("all")).first()[0] or 0
    hot = {} if largest <= per_task else None  # where no look has many rows, no key needs counting
    members = split_join(rows, some, ["look", "raw"], per_task=per_task, left_hot=hot, right_hot={}).select(key, "look", "raw", (F.col("all") - F.col("n")).alias("n_alike"))
    a, b = some.select("look", F.col("raw").alias("raw_a")), some.select("look", F.col("raw").alias("raw_b"))
    return members, split_join(a, b, ["look"], per_task=per_task, left_hot=hot, right_hot=hot).where("raw_a < raw_b")


def alike_pairs(df: DataFrame, key: str, text: str, per_task: int = 2_000_000) -> DataFrame:
    """Pairs (key_a < key_b) of rows whose non-empty texts look the same and whose characters differ: the links, expanded by their members."""
    members, found = alike_classes(df, key, text, per_task)
    members = kept(members)
    hot = {} if (members.agg(F.max("n_alike")).first()[0] or 0) <= per_task else None
    a = members.select("look", F.col("raw").alias("raw_a"), F.col(key).alias("a"))
    b = members.select("look", F.col("raw").alias("raw_b"), F.col(key).alias("b"))
    wide = split_join(split_join(a, found, ["look", "raw_a"], per_task=per_task, left_hot=hot, right_hot=hot), b, ["look", "raw_b"], per_task=per_task, left_hot=hot, right_hot=hot)
    return wide.where("a <> b").select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()
