"""Files in and out: JSON lines (flat and nested), CSV tables, directories of logs and reports."""

from __future__ import annotations

import os
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PAIR_DDL = (
    "pers_entity_id string, pers_wikidata_QID string, pers_mentions_list array<string>, loc_entity_id string, loc_wikidata_QID string, loc_mentions_list array<string>, "
    "at string, at_explanation string, isAt string, isAt_explanation string"
)
DOCUMENT_DDL = f"document_id string, source string, language string, date string, text string, media struct<publication_title:string,time_period:string,source_type:string>, sampled_pairs array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ', 1) for x in PAIR_DDL.split(', ')))}>>"
PREDICTION_DDL = "document_id string, pers_entity_id string, loc_entity_id string, language string, at_predicted string, isAt_predicted string, at_gold string, isAt_gold string, at_explanation string, isAt_explanation string, latency_ms double, raw_output string, at_vote_tuple array<string>, flipped boolean"
FLAT_DDL = f"document_id string, language string, date string, text string, context string, {PAIR_DDL}, sentence_position int, ocr_quality double, nearest_timex_distance int"


def read_jsonl(spark: SparkSession, path: str | list[str], ddl: str) -> DataFrame:
    """JSON lines of a declared schema: blank lines are skipped, unknown keys dropped, missing ones null. No inference pass."""
    return spark.read.schema(ddl).json(path).dropna(how="all")


def detect_format(spark: SparkSession, path: str) -> str:
    """nested if the first line has sampled_pairs, else flat."""
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
    return "nested" if first and re.search(r'"sampled_?[pP]airs"', first[0][0]) else "flat"


def unnest(documents: DataFrame) -> DataFrame:
    """Documents to pairs with their position; the document's text serves as context."""
    e = documents.select(*[c for c in documents.columns if c != "sampled_pairs"], F.posexplode("sampled_pairs").alias("pair_no", "p")).where("p is not null")
    return e.select(*[c for c in e.columns if c != "p"], "p.*", F.col("text").alias("context"))


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("header", "true").csv(path)


def read_splits(spark: SparkSession, path: str, task: str) -> DataFrame:
    """sample_id, split of one task."""
    t = read_csv(spark, path, "sample_id string, task string, split string, document_id string, pers_entity_id string, loc_entity_id string, language string, at_label string, isAt_label string")
    return t.where(F.col("task") == task).select("sample_id", F.lower(F.trim("split")).alias("split"))


def read_confidences(spark: SparkSession, path: str) -> DataFrame:
    """A confidence table with its derived ambiguity: normalised entropy times one minus the margin."""
    from ..operators.votes import binary_ambiguity

    t = read_csv(spark, path, "document_id string, pers_entity_id string, loc_entity_id string, pred_label string, confidence double, prob_TRUE double, prob_FALSE double")
    p = F.coalesce("prob_TRUE", F.when(F.col("pred_label") == "TRUE", F.col("confidence")).otherwise(1 - F.col("confidence")))
    return t.withColumn("ambiguity", binary_ambiguity(p)).withColumn("margin", F.abs(2 * p - 1))


def read_configs(spark: SparkSession, folder: str, include: str = "*_predictions.jsonl", exclude: str | None = None, least_rows: int = 1) -> DataFrame:
    """All logs of a folder in one table with the file's name as ``config``; files with too few rows are left out."""
    t = spark.read.schema(PREDICTION_DDL).option("pathGlobFilter", include).option("recursiveFileLookup", "true").json(folder)
    t = t.withColumn("config", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)?$", 1))
    if exclude:
        t = t.where(~F.col("config").rlike(exclude))
    enough = t.groupBy("config").count().where(F.col("count") >= least_rows).select("config")
    return t.join(F.broadcast(enough), "config", "left_semi")  # one row per file


def read_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of every submission file of a folder with the file's name as ``run``; files of predictions are skipped."""
    t = spark.read.schema(DOCUMENT_DDL).option("pathGlobFilter", "*.jsonl").json(folder)
    t = t.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)?$", 1))
    return t.where(~F.col("run").contains("predictions"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, nulls written out, in as many files as there are partitions."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_reports(spark: SparkSession, folder: str, exclude: str = r"^compare_|_summary|\.bootstrap$") -> DataFrame:
    """experiment, metric, value: every number of every report file, whatever its nesting."""
    t = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(folder)
    t = t.withColumn("experiment", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)).where(~F.col("experiment").rlike(exclude))
    flat = F.from_json("value", "map<string,string>")
    return t.select("experiment", F.explode(flat).alias("metric", "text")).select("experiment", "metric", F.col("text").try_cast("double").alias("value")).where("value is not null")


def read_hierarchy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(target, child, surface) and (target, parent) out of a cache of maps."""
    t = spark.read.option("wholetext", "true").text(path).select(F.explode(F.from_json("value", "map<string,map<string,array<string>>>")).alias("target", "entry"))
    e = t.select("target", F.explode("entry").alias("child", "names")).select("target", "child", F.explode("names").alias("name"))
    return e.where("child <> '_parents'").withColumnRenamed("name", "surface"), e.where("child = '_parents'").select("target", F.col("name").alias("parent"))


def validated(raw: DataFrame, ddl: str = DOCUMENT_DDL) -> DataFrame:
    """line, problem: what is wrong with each line of text (columns line, value) as a document; good lines give no row."""
    at, is_at = ["TRUE", "PROBABLE", "FALSE"], ["TRUE", "FALSE"]
    t = raw.withColumn("d", F.from_json("value", ddl + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    pairs = F.coalesce("d.sampled_pairs", F.array().cast(f"array<struct<{', '.join(f'{n}:{k}' for n, k in (x.split(' ', 1) for x in PAIR_DDL.split(', ')))}>>"))
    rules: list[tuple[str, Column]] = [
        ("not JSON", F.col("d._bad").isNotNull()),
        ("document_id missing", F.col("d._bad").isNull() & F.col("d.document_id").isNull()),
        ("sampled_pairs missing", F.col("d._bad").isNull() & F.col("d.sampled_pairs").isNull()),
        ("pair without entity", F.exists(pairs, lambda p: p["pers_entity_id"].isNull() | p["loc_entity_id"].isNull())),
        ("unknown at", F.exists(pairs, lambda p: p["at"].isNotNull() & ~p["at"].isin(at))),
        ("unknown isAt", F.exists(pairs, lambda p: p["isAt"].isNotNull() & ~p["isAt"].isin(is_at))),
    ]
    problems = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    return t.select("line", F.explode(problems).alias("problem"))


def submission_filename(team: str, source: str, run: int) -> str:
    return f"{team}_{os.path.splitext(os.path.basename(source))[0]}_run{run}.jsonl"


def choose_by_language(paths: list[str], source: str) -> str | None:
    """The path whose name carries the language token of the source's name, else the first."""
    tokens = set(re.split(r"[^a-z]+", os.path.basename(source).lower())) & {"en", "fr", "de", "lb"}
    for p in sorted(paths):
        if tokens & set(re.split(r"[^a-z]+", os.path.basename(p).lower())):
            return p
    return sorted(paths)[0] if paths else None


def package(out: str, files: list[str]) -> str:
    """A zip of the files, in the order of their names."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(files):
            z.write(f, os.path.basename(f))
    return out
