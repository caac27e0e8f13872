"""Splits that keep related records together: components by frontier breadth-first search.

Records and the keys they share form a graph. Each key links its records in a
star around the smallest one (linear in the incidences, whatever the key's
size), so no group is ever gathered or paired. Joins on keys and on vertices
split those that hold more than ``per_task`` rows over several tasks
(``operators.skew``).

One level of the search: every vertex whose hash is smaller than those of all
its neighbours is a seed (a steady share of any graph, chains included); all seeds expand at once, hop by hop, over the hash-partitioned
adjacency; a vertex takes the smallest label that reaches it first, and
vertices not reached within ``hops`` start on their own. Edges between
vertices of different labels are collisions; they form the next, smaller graph
over labels. Once that has at most ``most_local`` edges (a documented bound,
about 16 MB) one task merges it by union-find; until then it is searched by
another level. Every level is checkpointed in the shared folder.

Splits follow the hash order of components: their sizes are summed up in that
order (by hash bucket first, so that no task sees all components), and each
takes the split in which its middle falls.

Defined results for odd input: null keys never match; records without any key
are components of their own; repeated records count once; empty input gives
empty output; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.skew import hot_buckets, split_join
from ..session import cut


def _merge(edges: DataFrame) -> DataFrame:
    """u, label for every vertex of a small graph: union-find in one task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        ids = list(parent)
        yield pd.DataFrame({"u": np.array(ids, np.int64), "label": np.array([find(x) for x in ids], np.int64)})

    return edges.where("u < v").coalesce(1).mapInPandas(work, "u bigint, label bigint")


def _level(edges: DataFrame, hops: int, per_task: int, hot: dict[int, int]) -> DataFrame:
    """u, label: one level of the search; ``edges`` holds both directions."""
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
    smallest = edges.groupBy("u").agg(F.min(order("v")).alias("least"))
    labels = smallest.where(order("u") < F.col("least")).select("u", F.col("u").alias("label"))
    frontier = labels
    for _ in range(hops):
        reached = split_join(edges, frontier, ["u"], per_task=per_task, left_hot=hot, right_hot={}).groupBy("v").agg(F.min("label").alias("label")).withColumnRenamed("v", "u")
        frontier = reached.join(labels, "u", "left_anti")
        labels = labels.unionByName(frontier)
    alone = smallest.select("u").join(labels, "u", "left_anti").select("u", F.col("u").alias("label"))
    return labels.unionByName(alone)


def components(links: DataFrame, hops: int = 2, most_local: int = 1_000_000, per_task: int = 2_000_000) -> DataFrame:
    """u, label over the vertices of ``links`` (u, v: bigint, any direction, loops allowed). label is one of the component's vertices."""
    edges = links.where("u <> v")
    edges = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    total = None
    while True:
        hot = hot_buckets(edges, ["u"], per_task)  # a key's centre is next to all its records; edges lie in both directions
        labels = cut(_level(edges, hops, per_task, hot))
        a = split_join(edges.where("u < v"), labels, ["u"], per_task=per_task, left_hot=hot, right_hot={}).select(F.col("label").alias("a"), F.col("v").alias("u"))
        small = split_join(a, labels, ["u"], per_task=per_task, left_hot=hot, right_hot={}).select(F.col("a").alias("u"), F.col("label").alias("v")).where("u <> v")
        small = cut(small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        total = labels if total is None else _follow(total, labels, per_task)
        n = small.count()
        if n == 0:
            return total
        if n <= most_local:
            return _follow(total, _merge(small), per_task)
        edges, total = small, cut(total)


def _follow(labels: DataFrame, further: DataFrame, per_task: int) -> DataFrame:
    step = further.select(F.col("u").alias("label"), F.col("label").alias("_next"))
    return split_join(labels, step, ["label"], "left", per_task=per_task).select("u", F.coalesce("_next", "label").alias("label"))


def group_records(records: DataFrame, key: str, shared: list, hops: int = 2, most_local: int = 1_000_000, per_task: int = 2_000_000) -> DataFrame:
    """key, group (bigint) for every distinct record key.

    ``shared`` are columns or arrays of strings; records that hold the same
    non-null value under the same entry belong together.
    """
    tagged = [
        F.transform(F.array_distinct(F.array_compact(c)), lambda v, i=i: F.concat(F.lit(f"{i}|"), v)) if many else F.when(c.isNotNull(), F.array(F.concat(F.lit(f"{i}|"), c)))
        for i, (c, many) in enumerate(shared)
    ]
    empty = F.array().cast("array<string>")
    keys = F.concat(*[F.coalesce(t, empty) for t in tagged])
    docs = cut(records.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct().withColumn("u", F.monotonically_increasing_id()))
    held = records.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.explode(keys).alias("s")).distinct().join(docs, "k").select("s", "u")
    held = cut(held)
    centres = held.groupBy("s").agg(F.min("u").alias("v"))
    links = split_join(held, centres, ["s"], per_task=per_task, right_hot={}).where("u <> v").select("u", "v").distinct()
    found = components(links, hops, most_local, per_task)
    return docs.join(found, "u", "left").select(F.col("k").alias(key), F.coalesce("label", "u").alias("group"))


def assign_splits(groups: DataFrame, key: str, shares: dict[str, float], seed: str = "quirewell", buckets: int = 4096) -> DataFrame:
    """key, split: whole groups in the order of their hash, by the given shares of all records.

    ``groups`` holds key and ``name`` (a stable name of the group). A share is
    met up to the size of the groups at its edges.
    """
    groups = groups.select(key, "name")
    sized = groups.groupBy("name").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(F.lit(seed), "name")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    totals = {r[0]: r[1] for r in sized.groupBy("bucket").agg(F.sum("n")).collect()}  # at most ``buckets`` rows
    offset, running = {}, 0
    for b in sorted(totals):
        offset[b] = running
        running += totals[b]
    starts = groups.sparkSession.createDataFrame([(int(b), int(o)) for b, o in offset.items()], "bucket bigint, start bigint")
    order = Window.partitionBy("bucket").orderBy("h", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = (F.col("start") + F.sum("n").over(order) - F.col("n") / 2) / F.lit(max(running, 1))
    edge, split = 0.0, None
    for name, share in list(shares.items())[:-1]:
        edge += share
        split = F.when(F.col("middle") < edge, F.lit(name)) if split is None else split.when(F.col("middle") < edge, F.lit(name))
    last = list(shares)[-1]
    placed = sized.join(F.broadcast(starts), "bucket").withColumn("middle", middle).select("name", (split.otherwise(F.lit(last)) if split is not None else F.lit(last)).alias("split"))
    return split_join(groups, placed, ["name"], right_hot={}).select(key, "split")
