"""Labels and keys: domains, null rules, composite ids, last-wins indexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The label sets and their order on the ordinal scale.
AT = ("TRUE", "PROBABLE", "FALSE")
IS_AT = ("TRUE", "FALSE")
ORDINAL = {"FALSE": 0, "PROBABLE": 1, "TRUE": 2}
KEY = ("document_id", "pers_entity_id", "loc_entity_id")


def null_to_false(label: Column) -> Column:
    """A missing label counts as FALSE."""
    return F.coalesce(label, F.lit("FALSE"))


def checked(label: Column, allowed: tuple[str, ...]) -> Column:
    """The label, or an error that names a value outside the set (null passes)."""
    return F.when(label.isNull() | label.isin(*allowed), label).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("string"))


def outside(df: DataFrame, label: str, allowed: tuple[str, ...]) -> DataFrame:
    """label, n: the values outside the set."""
    return df.where(F.col(label).isNotNull() & ~F.col(label).isin(*allowed)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def normalised(label: Column, allowed: tuple[str, ...]) -> Column:
    """Upper case without blanks if that is a label, else null."""
    up = F.upper(F.trim(label))
    return F.when(up.isin(*allowed), up)


def case_normalised(label: Column) -> Column:
    """TRUE or FALSE in upper case whatever their case; other text as it is."""
    up = F.upper(F.trim(label))
    return F.when(up.isin(*IS_AT), up).otherwise(label)


def sample_id(*cols: str) -> Column:
    return F.concat_ws(" | ", *(cols or KEY))


def split_sample_id(sid: Column) -> list[Column]:
    parts = F.split(sid, r" \| ")
    return [F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(KEY)]


def within_window(distance: Column, days: int = 30) -> Column:
    """Whether a signed distance in days lies in the window; unknown is outside."""
    return F.coalesce(F.abs(distance) <= days, F.lit(False))


def breaks_constraint(at: Column, is_at: Column) -> Column:
    return F.coalesce((at == "FALSE") & (is_at == "TRUE"), F.lit(False))


def repaired(at: Column, is_at: Column) -> Column:
    """isAt, forced to FALSE where at is FALSE."""
    return F.when(at == "FALSE", F.lit("FALSE")).otherwise(is_at)


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per complete key: the last in the given order (ascending); rows with a missing key part are left out."""
    known = df.dropna(subset=keys)
    w = Window.partitionBy(*keys).orderBy(*[F.struct(c.alias("x"))["x"].desc_nulls_last() for c in order])
    return known.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
