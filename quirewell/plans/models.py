"""Queries over trained models, selection, external stand-ins and splits; fitted values have no SQL and are tested instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import ml, predictors, sampling as S
from ..operators.labels import KEY, null_to_false
from ..session import table
from .common import PRED, WIDE, predictions, wide
from .ensembles import UNIQ, uniq
from .scoring import SPLIT_SQL, document_split

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query()
def m12_spectral(spark: SparkSession, d: str) -> DataFrame:
    """Eigenmap coordinates of every vector, from an eigenmap of a bounded sample."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return ml.SpectralMap(components=4, near=15, most=1000).fit(e, "embedding", "vec_id").transform(e, "vec_id", "embedding")


def _greedy_sql() -> str:
    """All seven subsets of the three models scored, then the greedy path through them."""
    subsets = [[i for i in range(3) if n >> i & 1] for n in range(1, 8)]
    name = lambda c: "+".join(f"at_{i}" for i in c)
    long = " UNION ALL ".join(f"SELECT '{name(c)}' AS s, concat_ws('|', {', '.join(f'at_{i}' for i in c)}) AS v, g, fold FROM t" for c in subsets)
    two = " UNION ALL ".join(f"SELECT 'at_{i}' AS a, 'at_{j}' AS b, '{name(sorted((i, j)))}' AS s" for i in range(3) for j in range(3) if i != j)
    return f"""WITH {WIDE}, t AS (SELECT at_0, at_1, at_2, at_gold AS g, (row_number() OVER (PARTITION BY at_gold ORDER BY md5(k), k) - 1) % 5 AS fold FROM (SELECT *, concat_ws('|', document_id, pers_entity_id, loc_entity_id) AS k FROM wide WHERE at_gold IS NOT NULL)),
long AS ({long}), f AS (SELECT unnest([0, 1, 2, 3, 4]) AS f), cnt AS (SELECT s, f, v, g, count(*) AS n FROM long, f WHERE fold <> f GROUP BY ALL), tab AS (SELECT s, f, v, g AS label FROM (SELECT *, row_number() OVER (PARTITION BY s, f, v ORDER BY n DESC, g) AS rn FROM cnt) WHERE rn = 1),
held AS (SELECT s, fold AS f, v, g, count(*) AS n FROM long GROUP BY ALL), rec AS (SELECT s, f, g, sum(CASE WHEN coalesce(label, 'FALSE') = g THEN n ELSE 0 END) / sum(n) AS r FROM held LEFT JOIN tab USING (s, f, v) GROUP BY ALL),
score AS (SELECT s, avg(r) AS m FROM (SELECT s, f, avg(r) AS r FROM rec GROUP BY ALL) GROUP BY s), one AS (SELECT s AS a, m FROM score WHERE length(s) = 4 ORDER BY m DESC, s LIMIT 1),
two AS (SELECT a, b, score.m FROM ({two}) p JOIN one USING (a) JOIN score USING (s) WHERE score.m > one.m + 1e-6 ORDER BY score.m DESC, b LIMIT 1),
three AS (SELECT a, b, replace(replace('at_0at_1at_2', a, ''), b, '') AS c, score.m FROM two, score WHERE s = 'at_0+at_1+at_2' AND score.m > two.m + 1e-6)
SELECT 1 AS step, a AS chosen, round(m, 6) AS macro_recall FROM one UNION ALL SELECT 2, a || '+' || b, round(m, 6) FROM two UNION ALL SELECT 3, a || '+' || b || '+' || c, round(m, 6) FROM three"""


@query(_greedy_sql())
def e21_greedy_selection(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d).withColumn("key", F.concat_ws("|", *KEY))
    trace = ml.greedy_selection(w, ["at_0", "at_1", "at_2"], "at_gold", "key", most=3)
    return spark.createDataFrame([(i + 1, "+".join(c), round(s, 6)) for i, (c, s) in enumerate(trace)], "step int, chosen string, macro_recall double")


@query()
def e22_nested_cv(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d).withColumn("key", F.concat_ws("|", *KEY))
    return ml.nested_cv(w, ["at_0", "at_1", "at_2"], "at_gold", "key", folds=3, most=3)


@query(f"""WITH {UNIQ}, {SPLIT_SQL}, s AS (SELECT u.sample_id, CASE WHEN sp.split = 'test' THEN 'test' WHEN sp.split IS NULL THEN 'none' ELSE 'train' END AS base, language, "at", "isAt" FROM u LEFT JOIN sp USING (document_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY base, language, "at", "isAt" ORDER BY md5(sample_id), sample_id) AS rn, count(*) OVER (PARTITION BY base, language, "at", "isAt") AS n FROM s)
SELECT sample_id, CASE WHEN base = 'train' AND n >= 4 AND rn <= greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE base END AS split FROM r""")
def m02_baseline_split(spark: SparkSession, d: str) -> DataFrame:
    """The frozen split, with a stratified part of its training samples carved out for validation."""
    t = uniq(spark, d).join(document_split(spark, d), "document_id", "left")
    t = t.withColumn("base", F.when(F.col("split") == "test", "test").when(F.col("split").isNull(), "none").otherwise("train")).drop("split")
    c = S.carve(t, "sample_id", ["base", "language", "at", "isAt"], 0.1, 4)
    return c.select("sample_id", F.when((F.col("base") == "train") & (F.col("split") == "val"), "val").otherwise(F.col("base")).alias("split"))


@query(f"""WITH {UNIQ}, s AS (SELECT sample_id, coalesce("at",'FALSE') AS label FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id), sample_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM s)
SELECT sample_id, label, CAST(unnest(generate_series(1, CAST(1 + (200 - rn) // least(n, 200) AS BIGINT))) AS INTEGER) AS copy FROM r WHERE rn <= 200""")
def m05_balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """Two hundred rows of each class; a class with fewer repeats its rows. The size is the sampler's feature."""
    t = uniq(spark, d).select("sample_id", null_to_false(F.col("at")).alias("label"))
    return S.balanced(t, "sample_id", "label", 200).select("sample_id", "label", "copy")


@query()
def v06_self_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Three samples per instance from the stand-in client, and their majority."""
    t = table(spark, d, "relation_instance").dropDuplicates(["sample_id"]).select("sample_id", F.concat_ws(" ", "sample_id", "context").alias("prompt"))
    return predictors.consistent(predictors.answered(t, "prompt", predictors.HashClient(), samples=3), ["sample_id"])


@query()
def v04_agentic(spark: SparkSession, d: str) -> DataFrame:
    first = lambda c: F.get(F.col(c), F.lit(0))
    t = table(spark, d, "relation_instance").dropDuplicates(["sample_id"]).select("sample_id", F.concat_ws(" ", "sample_id", "context").alias("prompt"), first("pers_mentions_list").alias("person"), first("loc_mentions_list").alias("place"), "date", "language", F.col("context").alias("text"))
    return predictors.agentic(t, ["sample_id"], "prompt", predictors.HashClient("a"), predictors.HashClient("b"), predictors.HashClient("c"))


@query()
def r05_hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "relation_instance").dropDuplicates(["sample_id"]).select("sample_id", "context")
    return predictors.hashed_embedding(t, "context").select("sample_id", "embedding")


@query("SELECT DISTINCT sample_id, list_transform(regexp_extract_all(coalesce(context, ''), '\\b((?:1[5-9]|20)[0-9]{2}(?:-[0-9]{2}(?:-[0-9]{2})?)?)\\b', 1), lambda s: s) AS found FROM relation_instance")
def f05_iso_timexes(spark: SparkSession, d: str) -> DataFrame:
    t = predictors.iso_timexes(table(spark, d, "relation_instance").select("sample_id", "context"), "context")
    return t.select("sample_id", F.transform("temporal_expressions", lambda e: e["value"]).alias("found")).distinct()


@query("SELECT DISTINCT sample_id, CASE WHEN language = 'fr' THEN 1.0 ELSE 0.0 END::DOUBLE AS lang_fr, 0.0::DOUBLE AS has_timex, coalesce(ocr_quality, 1.0) AS ocr_quality FROM relation_instance")
def filter_ablation(spark: SparkSession, d: str) -> DataFrame:
    """One named feature set to zero; columns are chosen by name, so order and number of the rest don't matter."""
    t = table(spark, d, "relation_instance").select("sample_id", T.flag(F.col("language") == "fr").alias("lang_fr"), T.flag(F.col("has_timex_in_isat_window")).alias("has_timex"), F.coalesce("ocr_quality", F.lit(1.0)).alias("ocr_quality"))
    return t.withColumn("has_timex", F.lit(0.0)).select("sample_id", "lang_fr", "has_timex", "ocr_quality").distinct()


@query(f"""WITH {PRED}, c AS (SELECT document_id, pers_entity_id, loc_entity_id, TRY_CAST(regexp_extract(raw_output, 'conf_isAt=([0-9]+[.][0-9]+)', 1) AS DOUBLE) AS c FROM pred WHERE model = 'llm-small-ctx')
SELECT document_id, pers_entity_id, loc_entity_id, round((CASE WHEN c > 1e-9 THEN -c * ln(c) ELSE 0 END + CASE WHEN 1 - c > 1e-9 THEN -(1 - c) * ln(1 - c) ELSE 0 END) / ln(2) * (1 - abs(2 * c - 1)), 6) AS ambiguity, round(1 - c, 6) AS doubt FROM c WHERE c IS NOT NULL""")
def f60_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """Ambiguity from the top confidence alone, in both of its readings."""
    from ..operators.votes import binary_ambiguity

    c = F.regexp_extract("raw_output", r"conf_isAt=([0-9]+[.][0-9]+)", 1).try_cast("double")
    t = predictions(spark, d).where("model = 'llm-small-ctx'").select(*KEY, c.alias("c")).where("c is not null")
    return t.select(*KEY, F.round(binary_ambiguity(F.col("c")), 6).alias("ambiguity"), F.round(1 - F.col("c"), 6).alias("doubt"))


@query("""WITH p AS (SELECT 'When l_quantity in [10, 30] → consider R (precision ' || CAST(CAST(round_even(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 0) AS INTEGER) AS VARCHAR) || '% on training, support=' || count(*) FILTER (l_returnflag = 'R') || '/' || count(*) || ')' AS rule FROM lineitem WHERE l_quantity BETWEEN 10 AND 30) SELECT rule FROM p""")
def f37_rule_text(spark: SparkSession, d: str) -> DataFrame:
    """A subgroup as a sentence for a prompt."""
    from ..operators.mining import describe, matches

    p = {"l_quantity": (10.0, 30.0)}
    t = table(spark, d, "lineitem").where(matches(p)).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    percent = F.bround(100.0 * F.col("k") / F.col("n"), 0).cast("int")
    return t.select(F.concat(F.lit(f"When {describe(p)} → consider R (precision "), percent, F.lit("% on training, support="), "k", F.lit("/"), "n", F.lit(")")).alias("rule"))


@query(f"""WITH {PRED} SELECT experiment, metric, value, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, experiment) AS INTEGER) AS place FROM (SELECT model AS experiment, 'accuracy' AS metric, round(avg(CASE WHEN at_gold = at_predicted THEN 1.0 ELSE 0 END), 6) AS value FROM pred GROUP BY model UNION ALL SELECT model, 'latency', round(avg(latency_ms), 6) FROM pred GROUP BY model)""")
def k11_results_index(spark: SparkSession, d: str) -> DataFrame:
    """Results of all experiments in long form, ranked by metric."""
    hit = F.coalesce((F.col("at_gold") == F.col("at_predicted")).cast("int"), F.lit(0))
    g = predictions(spark, d).groupBy(F.col("model").alias("experiment")).agg(F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg("latency_ms"), 6).alias("latency"))
    long = g.unpivot("experiment", ["accuracy", "latency"], "metric", "value")
    return long.withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "experiment")))


@query("""WITH q AS (SELECT vec_id AS q_id, embedding AS qv, label AS ql FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q_id, ql, label, row_number() OVER (PARTITION BY q_id ORDER BY round(list_sum(list_transform(list_zip(qv, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(qv, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 9) DESC, vec_id) AS rank FROM q, embeddings WHERE vec_id <> q_id)
SELECT k, count(*) AS n, count(*) FILTER (label = ql) AS same_label FROM s, (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k GROUP BY k""")
def r08_k_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How many of the k nearest share the query's label, for several k, from one search."""
    from ..operators.retrieval import fetched

    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    hits = fetched(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 6).where("q_id <> vec_id")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("rank")))
    t = hits.join(e.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("q_id"), F.col("label").alias("ql")), "q_id")
    k = t.withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).where("rank <= k")
    return k.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("ql")).alias("same_label"))


@query()
def m20_silhouette(spark: SparkSession, d: str) -> DataFrame:
    """How well the labels of the embeddings part them, over all components."""
    t = table(spark, d, "embeddings")
    width = t.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"e{i}" for i in range(width)]
    e = t.select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(x) for i, x in enumerate(names)])
    return spark.createDataFrame([(round(ml.silhouette(e, names, "label"), 6),)], "silhouette double")


@query()
def g12_subtypes(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the vectors over affinity edges from every one of them to its 10 nearest; an edge found from both ends counts once."""
    from ..operators.retrieval import nearest_of_all

    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    ends = [F.least("q_id", "vec_id").alias("src"), F.greatest("q_id", "vec_id").alias("dst")]
    edges = nearest_of_all(e, "vec_id", "embedding", 10).groupBy(*ends).agg(F.greatest(F.max("score"), F.lit(1e-6)).alias("weight"))
    return ml.subtypes(edges, 2)


@query("""WITH t AS (SELECT document_id, max(text) AS text FROM articles GROUP BY document_id), r AS (SELECT DISTINCT sample_id, document_id, loc_mentions_list[1] AS span FROM relation_instance)
SELECT sample_id, CASE WHEN coalesce(span, '') = '' OR instr(text, span) = 0 THEN 0.0 WHEN instr(text, span) - 1 < 100 OR instr(text, span) - 1 > length(text) - 100 THEN 1.0 ELSE 0.0 END::DOUBLE AS near_edge FROM r JOIN t USING (document_id)""")
def f21_span_in_dateline_region(spark: SparkSession, d: str) -> DataFrame:
    """Whether an extracted span (here the first place mention) starts in the head or tail where datelines stand."""
    text = table(spark, d, "articles").groupBy("document_id").agg(F.max("text").alias("text"))
    r = table(spark, d, "relation_instance").select("sample_id", "document_id", F.get("loc_mentions_list", F.lit(0)).alias("span")).distinct()
    return r.join(text, "document_id").select("sample_id", T.span_near_edge(F.col("text"), F.col("span")).alias("near_edge"))


@query()
def f10_enriched(spark: SparkSession, d: str) -> DataFrame:
    """The composed enrichment over every delivered article, as the stream computes it."""
    from ..streaming.enrich import enriched

    return enriched(table(spark, d, "articles"))
