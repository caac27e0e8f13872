"""Evaluation texts leaking into training text: a broadcast hash set of test n-grams.

Items and documents are folded alike (case, punctuation, spacing, look-alike
characters). Items are cut into windows of ``words`` consecutive words, or in
scripts without spaces of ``letters`` consecutive letters and digits; the
hashes of all windows form a set that every task holds. A task hashes the
windows of its documents by array operations over whole batches, looks them
up, and verifies each hit letter by letter, so hash collisions never count.

The set is broadcast only while it has at most ``most_windows`` windows
(checked by a count); beyond, the windows of items and of documents are joined
by hash instead, with the same verification.

Defined results for odd input: null and empty texts, and items shorter than a
window, give no rows; repeated documents each get their rows; identical items
are each reported; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.skew import split_join
from . import fold

UNSPACED = ("zh", "ja", "th")
P = np.uint64(0x9E3779B97F4A7C15 | 1)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
SPAN_DDL = "doc {key}, item {item}, start_char bigint, end_char bigint"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(27))


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each position on; shorter input gives none."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.append(np.uint64(0), np.cumsum(values * _powers(P, n), dtype=np.uint64))
    return _mix((total[size:] - total[:-size]) * _powers(P_INV, n - size + 1))


class Units:
    """The units (words, or letters) of a batch of texts, with what is needed to hash, compare and locate them."""

    def __init__(self, texts: list[str], letters: bool):
        f, number, place = fold.searchable(texts)
        if letters:
            keep = f != 0
            self.code, self.doc, self.start = f[keep], number[keep], place[keep]
            self.end = self.start + 1
            self.value = _mix(self.code.astype(np.uint64) + np.uint64(0x1234567))
            self.first, self.past = np.arange(len(self.code)), np.arange(len(self.code)) + 1
        else:
            solid = f != 0
            begins = np.flatnonzero(solid & ~np.append(False, solid[:-1]))
            stops = np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1
            self.code, self.first, self.past = f, begins, stops
            self.doc, self.start, self.end = number[begins], place[begins], place[stops - 1] + 1
            inside = np.arange(len(f)) - np.repeat(np.append(0, begins), np.diff(np.concatenate([[0], begins, [len(f)]])))
            weights = _powers(P, int(inside.max(initial=0)) + 1)
            parts = np.where(solid, (f.astype(np.uint64) + np.uint64(1)) * weights[inside], np.uint64(0))
            self.value = _mix(np.add.reduceat(parts, begins)) if len(begins) else np.zeros(0, np.uint64)

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether the window lies within one text) of each window."""
        h = windows(self.value, size)
        return h, self.doc[: len(h)] == self.doc[size - 1 :] if len(h) else np.zeros(0, bool)

    def content(self, at: int, size: int) -> bytes:
        """The folded letters of a window, with one separator between words however many stand there."""
        part = self.code[self.first[at] : self.past[at + size - 1]]
        return part[(part != 0) | np.append(True, part[:-1] != 0)].tobytes()


def is_unspaced(text: str, lang: str | None) -> bool:
    """Whether a text counts in letters: by its language, else by its script."""
    if lang and lang.strip():
        return lang.strip().lower()[:2] in UNSPACED
    c = fold.codes(text)
    wide = ((c >= 0xE00) & (c < 0xE80)) | ((c >= 0x3040) & (c < 0xA000)) | ((c >= 0x20000) & (c < 0x32000))
    return int(wide.sum()) * 2 > len(c)


class ItemIndex:
    """Sorted window hashes of the items, with the content of each window for verification."""

    def __init__(self, rows: list[tuple], words: int, letters: int):
        self.size = {False: words, True: letters}
        self.hash, self.items, self.filter = {}, {}, {}
        for unspaced in (False, True):
            found: dict[int, dict[bytes, set]] = {}
            own = [(k, t) for k, t, lang in rows if t and is_unspaced(t, lang) is unspaced]
            units = Units([t for _, t in own], unspaced)
            h, whole = units.hashes(self.size[unspaced])
            for i in np.flatnonzero(whole).tolist():
                found.setdefault(int(h[i]), {}).setdefault(units.content(i, self.size[unspaced]), set()).add(own[units.doc[i]][0])
            self.hash[unspaced] = np.array(sorted(found), dtype=np.uint64)
            self.items[unspaced] = found
            self.filter[unspaced] = np.zeros(1 << 22, dtype=bool)
            self.filter[unspaced][(self.hash[unspaced] >> np.uint64(42)).astype(np.int64)] = True

    def search(self, texts: list[str]) -> list[tuple[int, object, int, int]]:
        """(index of the text, item, start, end) of each run of hit windows."""
        out: list = []
        for unspaced in (False, True):
            if not len(self.hash[unspaced]):
                continue
            which = [i for i, x in enumerate(texts) if not unspaced or not x.isascii()]
            if not which:
                continue
            size = self.size[unspaced]
            units = Units([texts[i] for i in which], unspaced)
            h, whole = units.hashes(size)
            at = np.flatnonzero(whole & self.filter[unspaced][(h >> np.uint64(42)).astype(np.int64)])
            places = np.searchsorted(self.hash[unspaced], h[at])
            ok = places < len(self.hash[unspaced])
            at, places = at[ok], places[ok]
            at = at[self.hash[unspaced][places] == h[at]]
            runs: dict = {}
            for i in at.tolist():
                for item in self.items[unspaced][int(h[i])].get(units.content(i, size), ()):
                    key = (which[units.doc[i]], item)
                    a, b, last = runs.get(key, (None, None, -9))
                    if a is not None and i > last + size:
                        out.append((*key, a, b))
                        a = None
                    runs[key] = (int(units.start[i]) if a is None else a, int(units.end[i + size - 1]), i)
            out += [(*k, a, b) for k, (a, b, _) in runs.items()]
        return out


def leaked_spans(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", lang: str = "lang",
                 words: int = 12, letters: int = 24, most_windows: int = 5_000_000, chars_at_once: int = 1_000_000) -> DataFrame:
    """The spans of documents that stand in an item: doc_key, item_key, start_char, end_char (exclusive)."""
    keys = {"key": dict(docs.dtypes)[doc_key], "item": dict(items.dtypes)[item_key]}
    held = items.select(F.col(item_key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where(F.length("t") > 0)
    corpus = docs.select(F.col(doc_key).alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    bound = held.agg(F.sum(F.length("t"))).first()[0] or 0  # at most one window begins at each character
    if bound <= most_windows:
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in held.collect()], words, letters))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, part in batch.groupby(np.cumsum(batch["t"].str.len().to_numpy()) // chars_at_once):
                    rows = index.value.search(part["t"].tolist())
                    ids = part["k"].to_numpy()
                    yield pd.DataFrame([(ids[i], *r) for i, *r in rows], columns=["doc", "item", "start_char", "end_char"])

        spans = corpus.mapInPandas(work, SPAN_DDL.format(**keys))
    else:
        spans = _joined(corpus, held, words, letters, chars_at_once, keys)
    return spans.withColumnsRenamed({"doc": doc_key, "item": item_key})


def _joined(corpus: DataFrame, held: DataFrame, words: int, letters: int, chars_at_once: int, keys: dict) -> DataFrame:
    """Beyond the bound: windows of both sides, joined by hash and content (a digest of the folded letters).

    Hashes of the documents' windows are cut down to those that items have (a
    left semi join on distinct hashes; hashes and row ids only). The documents
    that are left are read again, and only windows with such a hash are
    digested and joined, so the digests and the join hold hits only.
    """

    def windows_of(batches: Iterator[pd.DataFrame], both: bool):
        """(part, places of its texts, units, hashes, whole windows, unspaced, size) of every stretch of a batch."""
        for batch in batches:
            for _, part in batch.groupby(np.cumsum(batch["t"].str.len().to_numpy()) // chars_at_once):
                texts = part["t"].tolist()
                for unspaced, size in ((False, words), (True, letters)):
                    which = [i for i, x in enumerate(texts) if both or is_unspaced(x, part["l"].iloc[i]) is unspaced]
                    units = Units([texts[i] for i in which], unspaced)
                    h, whole = units.hashes(size)
                    if whole.any():
                        yield part, np.array(which, int), units, h.view(np.int64), np.flatnonzero(whole), unspaced, size

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, which, units, h, at, unspaced, _ in windows_of(batches, True):
            yield pd.DataFrame({"row": part["r"].to_numpy()[which[units.doc[at]]], "unspaced": unspaced, "h": h[at]}).drop_duplicates()

    def digests(both: bool):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, which, units, h, at, unspaced, size in windows_of(batches, both):
                if both:
                    hits = np.unique(np.concatenate([*part["hits"], np.zeros(0, np.int64)]))
                    at = at[np.isin(h[at], hits)]
                yield pd.DataFrame({
                    "k": part["k"].to_numpy()[which[units.doc[at]]], "row": part["r"].to_numpy()[which[units.doc[at]]],
                    "place": at - np.searchsorted(units.doc, units.doc[at]),
                    "unspaced": unspaced, "h": h[at],
                    "digest": [blake2b(units.content(i, size), digest_size=16).digest() for i in at.tolist()],
                    "start_char": units.start[at], "end_char": units.end[at + size - 1],
                })

        return work

    ddl = "k {}, row bigint, place bigint, unspaced boolean, h bigint, digest binary, start_char bigint, end_char bigint"
    b = held.withColumn("r", F.lit(0).cast("bigint")).mapInPandas(digests(False), ddl.format(keys["item"])).select(F.col("k").alias("item"), "unspaced", "h", "digest").distinct()
    docs = corpus.withColumns({"l": F.lit(None).cast("string"), "r": F.xxhash64("t")})
    met = docs.mapInPandas(hashes, "row bigint, unspaced boolean, h bigint").join(b.select("unspaced", "h").distinct().hint("merge"), ["unspaced", "h"], "left_semi")
    met = met.groupBy(F.col("row").alias("r")).agg(F.collect_set("h").alias("hits"))  # as many as a text has windows
    a = docs.join(met.hint("merge"), "r").select("k", "t", "l", "r", "hits").mapInPandas(digests(True), ddl.format(keys["key"]))
    on = ["unspaced", "h", "digest"]
    #: runs of windows that touch are one span, as in ItemIndex.search
    own = ["doc", "row", "item", "unspaced"]
    w = Window.partitionBy(*own).orderBy("place")
    hits = split_join(a.withColumnRenamed("k", "doc"), b, on, right_hot={}).select(*own, "place", "start_char", "end_char").distinct()
    far = F.col("place") > F.lag("place").over(w) + F.when(F.col("unspaced"), letters).otherwise(words)
    runs = hits.withColumn("far", F.coalesce(far.cast("int"), F.lit(0))).withColumn("run", F.sum("far").over(w))
    return runs.groupBy(*own, "run").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char")).select("doc", "item", "start_char", "end_char")


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", **options) -> DataFrame:
    """Which documents contain which items, each once."""
    return leaked_spans(docs, items, doc_key, item_key, **options).select(doc_key, item_key).distinct()


def remove_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold a leak, with the leaked spans cut out (overlapping spans as one)."""
    spans = leaked_spans(docs, items, doc_key, text=text, **options).groupBy(doc_key).agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char"))).alias("_spans"))
    kept = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.when(s["start_char"] > acc["at"], F.col(text).substr((acc["at"] + 1).cast("int"), (s["start_char"] - acc["at"]).cast("int"))).otherwise(F.lit(""))).alias("out"),
            F.greatest(acc["at"], s["end_char"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.col(text).substr((acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return docs.drop("_spans").join(spans, doc_key).withColumn("clean_text", kept).drop("_spans")
