"""Problem 1 in this project's terms: delivered records into documents, pairs and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.shred import Naming, as_table, shred, typed_tables
from ..session import table

#: The field names under which delivered records hold their parts.
DELIVERY = Naming(
    elements={
        "sampled_pairs": "pair",
        "sampledPairs": "pair",
        "pers_mentions_list": "mention",
        "loc_mentions_list": "mention",
        "person.mentions": "mention",
        "location.mentions": "mention",
        "document": "document",
        "documents": "document",
    },
    roles={"pers_mentions_list": "pers", "loc_mentions_list": "loc", "pair.person": "pers", "pair.location": "loc"},
    signatures={"document_id": "document", "sampled_pairs": "document", "sampledPairs": "document"},
    inherit={"document": "document_id"},
    tables=("document", "pair", "mention"),
)


def delivered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(table(spark, sf_dir, "raw_record"), "record_id", "payload", DELIVERY)


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per delivered document; it names the record it came in."""
    cols = ["document_id", "language", "date", "text", "media_publication_title", "media_source_type"]
    t = as_table(delivered_rows(spark, sf_dir), "document", cols).withColumnRenamed("position", "document_no")
    return t.select("record_key", "row_id", "document_no", *cols)


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair; ``parent_id`` is the key of its document."""
    cols = ["pers_entity_id", "loc_entity_id", "person_entity_id", "location_entity_id", "pers_wikidata_qid", "loc_wikidata_qid", "person_wikidata_qid", "location_wikidata_qid", "at", "is_at", "labels_at", "labels_is_at", "justification_evidence_strength"]
    t = as_table(delivered_rows(spark, sf_dir), "pair", cols, ["document_id"])
    return t.select(
        "record_key", "row_id", "parent_id", F.col("parent_document_id").alias("document_id"), F.col("position").alias("pair_no"),
        F.coalesce("pers_entity_id", "person_entity_id").alias("pers_entity_id"),
        F.coalesce("loc_entity_id", "location_entity_id").alias("loc_entity_id"),
        F.coalesce("pers_wikidata_qid", "person_wikidata_qid").alias("pers_wikidata_QID"),
        F.coalesce("loc_wikidata_qid", "location_wikidata_qid").alias("loc_wikidata_QID"),
        F.coalesce("at", "labels_at").alias("at"), F.coalesce("is_at", "labels_is_at").alias("isAt"),
        F.col("justification_evidence_strength").alias("evidence_strength"),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mention string of raw_record.payload; a row carries its parent's position, so no join back to the pairs is needed."""
    t = as_table(delivered_rows(spark, sf_dir), "mention", ["value", "surface"], ["document_id"])
    return t.where((F.col("parent_table") == "pair") & F.coalesce("value", "surface").isNotNull()).select(
        F.col("record_key").cast("bigint").alias("record_id"),
        F.col("parent_document_id").alias("document_id"),
        F.col("parent_position").alias("pair_no"),
        F.col("role").alias("side"),
        F.col("position").alias("mention_no"),
    )


#: Delivered documents and pairs in SQL, shared by the three queries.
_PARTS = r"""v AS (SELECT record_id, CAST(payload AS JSON) AS j FROM raw_record WHERE json_valid(payload)),
l AS (SELECT record_id, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') WHEN json_exists(j, '$.batch') THEN json_extract(j, '$.batch.documents[*]') WHEN json_exists(j, '$.document') THEN [json_extract(j, '$.document')] ELSE [j] END AS docs, CASE WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.batch') THEN '/batch0' ELSE '' END AS above FROM v),
d AS (SELECT record_id, above, unnest(docs) AS doc, generate_subscripts(docs, 1) - 1 AS document_no FROM l),
s AS (SELECT record_id, above, document_no, doc->>'document_id' AS document_id, CASE WHEN json_exists(doc, '$.sampled_pairs') THEN doc->'sampled_pairs' ELSE doc->'sampledPairs' END AS x FROM d),
t AS (SELECT record_id, above, document_no, document_id, CASE WHEN json_type(x) = 'VARCHAR' THEN CAST(x->>'$' AS JSON) ELSE x END AS x FROM s),
p AS (SELECT record_id, above, document_no, document_id, unnest(y) AS pair, generate_subscripts(y, 1) - 1 AS pair_no FROM (SELECT record_id, above, document_no, document_id, CASE WHEN json_type(x) = 'ARRAY' THEN json_extract(x, '$[*]') WHEN json_type(x) = 'OBJECT' THEN [x] END AS y FROM t))"""
#: SQL of ``p1_found``.
P1_SQL = f"""WITH {_PARTS},
m AS (SELECT record_id, document_id, pair_no, 'pers' AS side, coalesce(pair->'pers_mentions_list', json_extract(pair, '$.person.mentions')) AS z FROM p UNION ALL SELECT record_id, document_id, pair_no, 'loc', coalesce(pair->'loc_mentions_list', json_extract(pair, '$.location.mentions')) FROM p),
e AS (SELECT record_id, document_id, pair_no, side, unnest(w) AS item, generate_subscripts(w, 1) - 1 AS mention_no FROM (SELECT *, CASE WHEN json_type(z) = 'ARRAY' THEN json_extract(z, '$[*]') WHEN json_type(z) IN ('VARCHAR', 'OBJECT') THEN [z] END AS w FROM m))
SELECT record_id, document_id, CAST(pair_no AS BIGINT) AS pair_no, side, CAST(mention_no AS BIGINT) AS mention_no FROM e WHERE json_type(item) = 'VARCHAR' OR json_type(item) = 'OBJECT' AND json_type(item->'surface') = 'VARCHAR'"""
#: SQL of ``p1_documents`` and ``p1_pairs``.
P1_TABLES_SQL = {
    "p1_documents": f"""WITH {_PARTS} SELECT CAST(record_id AS VARCHAR) AS record_key, record_id || above || '/document' || document_no AS row_id, CAST(document_no AS BIGINT) AS document_no, doc->>'document_id' AS document_id, doc->>'language' AS language, doc->>'date' AS date, doc->>'text' AS text,
doc->'media'->>'publication_title' AS media_publication_title, doc->'media'->>'source_type' AS media_source_type FROM d WHERE json_type(doc) = 'OBJECT'""",
    "p1_pairs": f"""WITH {_PARTS} SELECT CAST(record_id AS VARCHAR) AS record_key, record_id || above || '/document' || document_no || '/pair' || pair_no AS row_id, record_id || above || '/document' || document_no AS parent_id, document_id, CAST(pair_no AS BIGINT) AS pair_no,
coalesce(pair->>'pers_entity_id', pair->'person'->>'entity_id') AS pers_entity_id, coalesce(pair->>'loc_entity_id', pair->'location'->>'entity_id') AS loc_entity_id, coalesce(pair->>'pers_wikidata_QID', pair->'person'->'wikidata'->>'QID') AS "pers_wikidata_QID", coalesce(pair->>'loc_wikidata_QID', pair->'location'->'wikidata'->>'QID') AS "loc_wikidata_QID",
coalesce(pair->>'at', pair->'labels'->>'at') AS "at", coalesce(pair->>'isAt', pair->'labels'->>'isAt') AS "isAt", pair->'justification'->>'evidence_strength' AS evidence_strength FROM p WHERE json_type(pair) = 'OBJECT'""",
}


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """articles with a key per delivery: of a document delivered twice, each delivery is a row of its own."""
    return table(spark, sf_dir, "articles").withColumn("row_id", F.concat("document_id", F.lit("@"), F.coalesce(F.date_format("loaded_at", "yyyyMMddHHmmssSSSSSS"), F.lit(""))))


def article_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """articles, pairs and the mentions of either side as linked tables, by the types of the columns."""
    return typed_tables(articles(spark, sf_dir), "row_id", "article", {"sampled_pairs": "pair", "pers_mentions_list": "pers", "loc_mentions_list": "loc"})


def document_of(row_id: str) -> Column:
    return F.regexp_extract(row_id, r"^(.*?)@[0-9]*(?:/|$)", 1)


def p1_article_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per delivered article."""
    return article_tables(spark, sf_dir)["article"]


def p1_article_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair of articles.sampled_pairs; null pairs keep their position. ``parent_id`` is the key of its article."""
    return article_tables(spark, sf_dir)["pair"].withColumnRenamed("position", "pair_no").withColumn("document_id", document_of("parent_id"))


def p1_article_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mention of articles.sampled_pairs; null mentions keep their position. ``parent_id`` is the key of its pair."""
    t = article_tables(spark, sf_dir)
    sides = [t[x].select("row_id", "parent_id", document_of("parent_id").alias("document_id"), F.lit(x).alias("side"), F.col("position").alias("mention_no"), F.col("value").alias("mention")) for x in ("pers", "loc")]
    return sides[0].union(sides[1])


_ARTICLES_SQL = """a AS (SELECT *, document_id || '@' || coalesce(strftime(loaded_at, '%Y%m%d%H%M%S%f'), '') AS row_id FROM articles),
x AS (SELECT row_id AS parent_id, document_id, unnest(sampled_pairs) AS p, CAST(generate_subscripts(sampled_pairs, 1) - 1 AS INTEGER) AS pair_no FROM a),
p AS (SELECT *, parent_id || '/pair' || pair_no AS row_id FROM x WHERE p IS NOT NULL)"""
#: SQL of the queries over articles.
ARTICLE_SQL = {
    "p1_article_documents": f"WITH {_ARTICLES_SQL} SELECT row_id, document_id, loaded_at, source, language, date, text, media.publication_title AS media_publication_title, media.time_period AS media_time_period, media.source_type AS media_source_type, correspondent FROM a",
    "p1_article_pairs": f'WITH {_ARTICLES_SQL} SELECT row_id, parent_id, document_id, pair_no, p.pers_entity_id, p."pers_wikidata_QID", p.loc_entity_id, p."loc_wikidata_QID", p."at", p.at_explanation, p."isAt", p."isAt_explanation" FROM p',
    "p1_article_mentions": f"""WITH {_ARTICLES_SQL}, m AS (SELECT row_id AS parent_id, document_id, 'pers' AS side, unnest(p.pers_mentions_list) AS mention, CAST(generate_subscripts(p.pers_mentions_list, 1) - 1 AS INTEGER) AS mention_no FROM p
UNION ALL SELECT row_id, document_id, 'loc', unnest(p.loc_mentions_list), CAST(generate_subscripts(p.loc_mentions_list, 1) - 1 AS INTEGER) FROM p) SELECT parent_id || '/' || side || mention_no AS row_id, parent_id, document_id, side, mention_no, mention FROM m WHERE mention IS NOT NULL""",
}
