"""Exact nearest rows by inner product, and the policy that selects among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _best(ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, key: str, k: int) -> pd.DataFrame:
    """The k best rows of one batch for each query; ties at the border included."""
    s = q @ x.T
    m = min(k, s.shape[1])
    floor = np.partition(s, -m, axis=1)[:, -m]
    r, c = np.nonzero(s >= floor[:, None] - 1e-9)
    return _cut(pd.DataFrame({"q_id": ids[r], key: own[c], "score": s[r, c]}), key, k)


def _cut(hits: pd.DataFrame, key: str, k: int) -> pd.DataFrame:
    hits = hits.assign(s=hits["score"].round(9)).sort_values(["q_id", "s", key], ascending=[True, False, True])
    return hits[hits.groupby("q_id").cumcount() < k].drop(columns="s")


def fetched(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, block: int = 2048, most_bytes: int = 256 << 20) -> DataFrame:
    """q_id, key, score, rank: the k best corpus rows of each query.

    A stated query set against all rows, in blocks. Queries whose vectors take
    at most ``most_bytes`` (as floats, summed up first) are broadcast: each task
    multiplies its corpus batches with blocks of them and keeps its own k best,
    so the shuffle holds k rows per query and task. More queries meet the
    corpus block by block: both sides are cut into blocks of about that size by
    hash, each row goes to every block of the other side, and a task holds two
    blocks. Both ways are exact.
    """
    kind = dict(corpus.dtypes)[key]
    ddl = f"q_id {kind}, {key} {kind}, score double"
    size = lambda df: 8 * (df.agg(F.sum(F.size(vector))).first()[0] or 0)
    taken = size(queries)
    if taken <= most_bytes:
        rows = queries.select(key, vector).toPandas()
        held = corpus.sparkSession.sparkContext.broadcast((rows[key].to_numpy(), _unit(rows[vector]) if len(rows) else np.zeros((0, 1))))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            best: dict[int, pd.DataFrame] = {}
            for b in batches:
                if len(b) and len(q):
                    x, own = _unit(b[vector]), b[key].to_numpy()
                    for a in range(0, len(q), block):
                        new = _best(ids[a : a + block], q[a : a + block], own, x, key, k)
                        best[a] = _cut(pd.concat([best[a], new]), key, k) if a in best else new
            yield from best.values()

        got = corpus.select(key, vector).mapInPandas(work, ddl)
    else:
        n, m = (-(-s // most_bytes) for s in (taken, size(corpus)))

        def side(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
            t = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))
            return t.withColumn(other, F.col(other).cast("bigint"))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):  # a block that nothing meets
                return pd.DataFrame(columns=["q_id", key, "score"])
            q, x = _unit(a["v"]), _unit(b["v"])
            return pd.concat([_best(a["k"].to_numpy()[i : i + block], q[i : i + block], b["k"].to_numpy(), x, key, k) for i in range(0, len(q), block)])

        groups = ["_q", "_c"]
        got = side(queries, "_q", n, "_c", m).groupBy(*groups).cogroup(side(corpus, "_c", m, "_q", n).groupBy(*groups)).applyInPandas(meet, ddl)
    w = Window.partitionBy("q_id").orderBy(F.desc(F.round("score", 9)), key)
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_of_all(df: DataFrame, key: str, vector: str, k: int, most_bytes: int = 256 << 20) -> DataFrame:
    """q_id, key, score, rank: the k best other rows of every row, exact; any number fits (see ``fetched``)."""
    w = Window.partitionBy("q_id").orderBy("rank")
    hits = fetched(df, df, key, vector, k + 1, most_bytes=most_bytes)
    return hits.where(F.col("q_id") != F.col(key)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def selected(hits: DataFrame, rows: DataFrame, key: str, language: str, label: str | None, k: int) -> DataFrame:
    """The k places of each query: not the query itself, its language first, padded with others.

    With ``label``, the first row of each label in the query's language comes
    before the rest. Rows were ranked before the exclusion, as over-fetching means.
    """
    cols = [c for c in (language, label) if c]
    info = rows.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in cols])
    mine = rows.select(F.col(key).alias("q_id"), F.col(language).alias("_mine"))
    t = hits.where(F.col("q_id") != F.col(key)).join(info, key).join(mine, "q_id").withColumn("_other", F.col(f"_{language}") != F.col("_mine"))
    order = [F.col("_other")]
    if label:
        nth = F.row_number().over(Window.partitionBy("q_id", "_other", f"_{label}").orderBy("rank"))
        t = t.withColumn("_late", F.when(~F.col("_other") & (nth == 1), 0).otherwise(1))
        order.append(F.col("_late"))
    w = Window.partitionBy("q_id").orderBy(*order, "rank")
    return t.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
