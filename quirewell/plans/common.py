"""Inputs shared by the queries, in DataFrame and in SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.labels import KEY, last_wins
from ..session import table

MODELS = ("encoder-ft", "llm-small-ctx", "vote-lookup")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """prediction_log indexed by model and key: the last label of each key wins."""
    order = [F.col("logged_at"), F.col("received_at"), F.coalesce("at_predicted", F.lit("")), F.coalesce("isAt_predicted", F.lit("")), F.coalesce("latency_ms", F.lit(-1.0)), F.coalesce("raw_output", F.lit(""))]
    return last_wins(table(spark, d, "prediction_log"), ["model", *KEY], order)


def wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per key that all three models answered: at_<i>, isat_<i>, gold labels, language.

    The N-way inner join of the model logs, as one aggregation by key.
    """
    per = predictions(spark, d)
    pick = [F.max(F.when(F.col("model") == m, F.coalesce(c, F.lit("FALSE")))).alias(f"{out}_{i}") for c, out in (("at_predicted", "at"), ("isAt_predicted", "isat")) for i, m in enumerate(MODELS)]
    n = F.count("*").alias("n_models")
    golds = [F.max("at_gold").alias("at_gold"), F.max("isAt_gold").alias("isat_gold"), F.max("language").alias("language")]
    return per.groupBy(*KEY).agg(n, *pick, *golds).where(F.col("n_models") == len(MODELS)).drop("n_models")


def instances(spark: SparkSession, d: str) -> DataFrame:
    """relation_instance without its repeated rows."""
    return table(spark, d, "relation_instance").dropDuplicates(["sample_id"])


#: SQL of ``predictions``.
PRED = """pred AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY model, document_id, pers_entity_id, loc_entity_id
  ORDER BY logged_at DESC NULLS LAST, received_at DESC NULLS LAST, coalesce(at_predicted,'') DESC, coalesce("isAt_predicted",'') DESC, coalesce(latency_ms,-1.0) DESC, coalesce(raw_output,'') DESC) AS rn
  FROM prediction_log WHERE model IS NOT NULL AND document_id IS NOT NULL AND pers_entity_id IS NOT NULL AND loc_entity_id IS NOT NULL) WHERE rn = 1)"""
#: SQL of ``wide``.
WIDE = PRED + ", wide AS (SELECT document_id, pers_entity_id, loc_entity_id, " + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN coalesce({c}, 'FALSE') END) AS {o}_{i}" for c, o in (("at_predicted", "at"), ('"isAt_predicted"', "isat")) for i, m in enumerate(MODELS)
) + ", max(at_gold) AS at_gold, max(\"isAt_gold\") AS isat_gold, max(language) AS language FROM pred GROUP BY ALL HAVING count(*) = 3)"
