"""Joins that split hot keys.

One key may hold a third of all rows. Rows are counted in hash buckets of
their keys (partial counts; at most ``buckets`` numbers reach the driver).
Where a bucket holds more than ``per_task`` rows of a side, that side's rows
are spread over so many salts, and the other side's rows of the bucket are
repeated once for each; so no task gets a whole hot key, and no pair is lost
or doubled. Buckets without a hot key are joined as they are.

Defined results for odd input: null keys never match; repeated rows each
count; empty sides give what the plain join gives. The columns ``_s`` and
``_t`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hot_buckets(df: DataFrame, on: list[str], per_task: int = 2_000_000, buckets: int = 16_384) -> dict[int, int]:
    """bucket -> salts of the hash buckets of ``on`` that hold more than ``per_task`` rows."""
    counts = df.groupBy(F.pmod(F.xxhash64(*on), F.lit(buckets)).alias("b")).count().where(F.col("count") > per_task)
    return {r[0]: -(-r[1] // per_task) for r in counts.collect()}


def hot_sides(df: DataFrame, on: list[str], left: str, right: str, per_task: int = 2_000_000, buckets: int = 16_384) -> tuple[dict[int, int], dict[int, int]]:
    """``hot_buckets`` of the rows where ``left`` holds and of those where ``right`` holds, in one pass."""
    b = F.pmod(F.xxhash64(*on), F.lit(buckets)).alias("b")
    counts = df.groupBy(b).agg(F.count_if(left).alias("x"), F.count_if(right).alias("y")).where((F.col("x") > per_task) | (F.col("y") > per_task)).collect()
    return tuple({r.b: -(-r[c] // per_task) for r in counts if r[c] > per_task} for c in ("x", "y"))


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", per_task: int = 2_000_000, buckets: int = 16_384, left_hot: dict[int, int] | None = None, right_hot: dict[int, int] | None = None) -> DataFrame:
    """``left.join(right, on, how)`` for ``how`` inner, left or left_semi, by sorted runs, hot keys split.

    Outer and semi joins split the left side only: a row must meet all partners in one place.
    ``left_hot`` and ``right_hot`` spare the counting where it is known (``hot_buckets``; {} for a side with unique keys).
    """
    bucket = F.pmod(F.xxhash64(*on), F.lit(buckets))
    a = hot_buckets(left, on, per_task, buckets) if left_hot is None else left_hot
    b = {} if how != "inner" else hot_buckets(right, on, per_task, buckets) if right_hot is None else right_hot
    if not a and not b:
        return left.join(right.hint("merge"), on, how)
    rows = [(int(k), a.get(k, 1), b.get(k, 1)) for k in sorted(a.keys() | b.keys())]
    plan = F.broadcast(left.sparkSession.createDataFrame(rows, "_b bigint, _n bigint, _m bigint"))
    one, many = F.coalesce("_n", F.lit(1)), F.coalesce("_m", F.lit(1))

    def salted(df: DataFrame, own, other, name: str, repeated: str) -> DataFrame:
        t = df.withColumn("_b", bucket).join(plan, "_b", "left")
        own_salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), own)
        return t.withColumns({name: own_salt, repeated: F.explode(F.sequence(F.lit(0).cast("bigint"), other - 1))}).drop("_b", "_n", "_m")

    x, y = salted(left, one, many, "_s", "_t"), salted(right, many, one, "_t", "_s")
    return x.join(y.hint("merge"), [*on, "_s", "_t"], how).drop("_s", "_t")


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A side for a join: broadcast if it has at most ``most`` rows (which are then computed once, here), else left to sorted runs."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df.hint("merge")
