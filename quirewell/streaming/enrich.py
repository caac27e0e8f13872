"""Stateless enrichment of delivered documents as a stream: the batch functions, unchanged, over readStream.

An extension; the operators themselves are batch operators. A directory of
JSON lines is read file by file, unnested and given its temporal features, so
a stream's output equals the batch's over the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..sources.files import DOCUMENT_DDL, unnest


def enriched(documents: DataFrame) -> DataFrame:
    """Pairs with the features that need nothing but their own document; works on batches and streams alike."""
    t = unnest(documents)
    pers, locs = T.known(F.col("pers_mentions_list")), T.known(F.col("loc_mentions_list"))
    return t.select(
        "document_id", "pair_no", "pers_entity_id", "loc_entity_id", "language",
        T.pub_date(F.col("date")).alias("pub_date"), T.signal_category(F.coalesce("text", F.lit(""))).alias("signal"),
        T.shared_sentence(F.col("text"), pers, locs).alias("sentence_position"), T.flag(T.char_gap(F.col("text"), pers, locs) < 20).alias("adjacent"),
    )


def start(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int = 100):
    """A running query from a folder of JSON lines to a folder of Parquet; stop it with ``.stop()``."""
    docs = spark.readStream.schema(DOCUMENT_DDL).option("maxFilesPerTrigger", files_per_trigger).json(source)
    return enriched(docs).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
