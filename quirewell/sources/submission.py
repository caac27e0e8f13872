"""Predictions merged back into nested documents, checked and counted; order-preserving JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.labels import AT, IS_AT, checked


def _joined(documents: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per pair of the latest delivery of each document, with its prediction if there is one."""
    latest = documents.groupBy("document_id").agg(F.max("loaded_at").alias("loaded_at"))
    docs = documents.join(latest, ["document_id", "loaded_at"]).dropDuplicates(["document_id"])
    e = docs.select("document_id", F.posexplode("sampled_pairs").alias("i", "p")).where("p is not null")
    e = e.withColumn("pers_entity_id", F.col("p.pers_entity_id")).withColumn("loc_entity_id", F.col("p.loc_entity_id"))
    q = predictions.select("document_id", "pers_entity_id", "loc_entity_id", checked(F.col("at_predicted"), AT).alias("a"), checked(F.col("isAt_predicted"), IS_AT).alias("b"), F.lit(True).alias("found"))
    return e.join(q, ["document_id", "pers_entity_id", "loc_entity_id"], "left")


def merged(documents: DataFrame, predictions: DataFrame, enforce_constraint: bool = True) -> DataFrame:
    """document_id, sampled_pairs: labels replaced, other fields and the order kept; an unknown label is an error."""
    j = _joined(documents, predictions)
    at = F.coalesce("a", F.lit("FALSE"))
    is_at = F.coalesce("b", F.lit("FALSE"))
    if enforce_constraint:
        is_at = F.when(at == "FALSE", "FALSE").otherwise(is_at)
    pair = F.col("p").withField("at", at).withField("isAt", is_at).withField("at_explanation", F.lit(None).cast("string")).withField("isAt_explanation", F.lit(None).cast("string"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("i", pair.alias("p")))), lambda x: x["p"])
    return j.groupBy("document_id").agg(pairs.alias("sampled_pairs"))


def stats(documents: DataFrame, predictions: DataFrame) -> DataFrame:
    j = _joined(documents, predictions)
    at = F.coalesce("a", F.lit("FALSE"))
    fixed = (at == "FALSE") & F.coalesce(F.col("b") == "TRUE", F.lit(False))
    is_at = F.when(at == "FALSE", "FALSE").otherwise(F.coalesce("b", F.lit("FALSE")))
    return j.agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("pairs"), F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(fixed).alias("fixed"), F.count_if(at == "TRUE").alias("at_true"), F.count_if(is_at == "TRUE").alias("isat_true"))


def write_submission(documents: DataFrame, predictions: DataFrame, path: str) -> None:
    """JSON lines, one document each."""
    merged(documents, predictions).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
