"""Folds, stratified splits, class weights and baselines; deterministic by hash order, never by a random state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ranked(df: DataFrame, key: str, strata: list[str]) -> DataFrame:
    """df with ``_rank`` (place in the hash order of its stratum) and ``_n`` (size of the stratum).

    A stratum may hold a third of all rows, so none is sorted in one task: rows
    are ranked within buckets of their hash, and the counts of the buckets
    before (4,096 per stratum at most) are added.
    """
    t = df.withColumn("_hash", F.md5(F.col(key).cast("string"))).withColumn("_bucket", F.substring("_hash", 1, 3))
    counts = t.groupBy(*strata, "_bucket").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*strata)
    counts = counts.withColumn("_before", F.sum("_c").over(w.orderBy("_bucket")) - F.col("_c")).withColumn("_n", F.sum("_c").over(w))
    own = F.row_number().over(Window.partitionBy(*strata, "_bucket").orderBy("_hash", key))
    on = [*strata, "_bucket"]
    counts = counts.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(on)], "_before", "_n")
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    joined = t.withColumn("_own", own).join(counts, same)
    return joined.select(*df.columns, (F.col("_own") + F.col("_before")).alias("_rank"), "_n")


def stratified_folds(df: DataFrame, key: str, strata: list[str], folds: int) -> DataFrame:
    """df with its fold: hash order within each stratum, dealt in turn."""
    return ranked(df, key, strata).withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank", "_n")


def _portion(n: Column, share: float) -> Column:
    """round(n * share), half to even, at least one."""
    return F.greatest(F.lit(1.0), F.bround(n * F.lit(share), 0))


def stratified_split(df: DataFrame, key: str, strata: list[str], test: float, val: float, least: int = 5) -> DataFrame:
    """split: test, val and train shares in each stratum; strata under ``least`` rows stay in train."""
    t = ranked(df, key, strata)
    a, b = _portion(F.col("_n"), test), _portion(F.col("_n"), val)
    split = F.when(F.col("_n") < least, "train").when(F.col("_rank") <= a, "test").when(F.col("_rank") <= a + b, "val").otherwise("train")
    return t.withColumn("split", split).drop("_rank", "_n")


def carve(df: DataFrame, key: str, strata: list[str], share: float, least: int) -> DataFrame:
    """split: val for a share of each stratum of at least ``least`` rows, else train."""
    t = ranked(df, key, strata)
    return t.withColumn("split", F.when((F.col("_n") >= least) & (F.col("_rank") <= _portion(F.col("_n"), share)), "val").otherwise("train")).drop("_rank", "_n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight: inverse frequencies, scaled to a mean of one over classes."""
    c = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # as few rows as classes
    w = c.withColumn("w", F.sum("n").over(whole) / F.col("n"))
    return w.select(label, "n", F.round(F.col("w") * F.count("*").over(whole) / F.sum("w").over(whole), 6).alias("weight"))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus their mean, over their population deviation (1 where that is under 1e-6)."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    t = df.crossJoin(F.broadcast(stats))  # stats is one row
    for c in columns:
        sd = F.when(F.col(f"_s_{c}") < 1e-6, 1.0).otherwise(F.col(f"_s_{c}"))
        t = t.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / sd)
    return t.select(*df.columns)


def balanced(df: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """``per_class`` rows of each class by hash order; short classes repeat their rows until they are full."""
    t = ranked(df, key, [label]).where(F.col("_rank") <= per_class)
    held = F.least(F.col("_n"), F.lit(per_class))
    times = F.floor((per_class - F.col("_rank")) / held) + 1
    return t.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("_rank", "_n")


def hash_baseline(df: DataFrame, key: str, labels: tuple[str, ...]) -> DataFrame:
    pick = F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("bigint") % len(labels)
    return df.select(key, F.get(F.array(*[F.lit(x) for x in labels]), pick.cast("int")).alias("guess"))


def by_hash(df: DataFrame, cols: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, those of the smallest hashes; rows above the expected share are dropped where they are read, so no task gets them all."""
    n = df.count()
    h = F.xxhash64(*cols).bitwiseAND(F.lit(2**62 - 1))
    share = min(1.0, (1.1 * most + 50) / max(n, 1))
    return df.where(h <= int(share * (2**62 - 1))).orderBy(h, *cols).limit(most)
