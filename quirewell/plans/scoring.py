"""Scoring queries over prediction_log and relation_instance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import metrics as M
from ..operators.labels import AT, IS_AT, KEY, null_to_false
from ..session import table
from .common import MODELS, PRED, WIDE, predictions, wide

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if it has one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


COUNTS = PRED + ", c AS (SELECT model, coalesce(at_gold,'FALSE') AS gold, coalesce(at_predicted,'FALSE') AS p, count(*) AS n FROM pred GROUP BY ALL)"


@query(f"WITH {PRED} SELECT model, document_id, pers_entity_id, loc_entity_id, at_predicted, \"isAt_predicted\" AS isat_predicted FROM pred")
def s07_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).select("model", *KEY, "at_predicted", F.col("isAt_predicted").alias("isat_predicted"))


@query(f"""WITH {COUNTS}, l AS (SELECT unnest(['TRUE','PROBABLE','FALSE']) AS label)
SELECT m.model, l.label, CAST(coalesce(sum(n) FILTER (gold = l.label), 0) AS BIGINT) AS support, CAST(coalesce(sum(n) FILTER (gold = l.label AND p = l.label), 0) AS BIGINT) AS hits,
 round(sum(n) FILTER (gold = l.label AND p = l.label) / sum(n) FILTER (gold = l.label), 6) AS recall
FROM (SELECT DISTINCT model FROM c) m CROSS JOIN l LEFT JOIN c ON c.model = m.model GROUP BY ALL""")
def a01_recall_by_label(spark: SparkSession, d: str) -> DataFrame:
    return M.recalls(predictions(spark, d), "at_gold", "at_predicted", AT, ["model"])


@query(f"""WITH {COUNTS}, r AS (SELECT model, gold, sum(CASE WHEN gold = p THEN n ELSE 0 END) / sum(n) AS r FROM c WHERE gold IN ('TRUE','PROBABLE','FALSE') GROUP BY ALL)
SELECT model, round(avg(r), 6) AS macro_recall, (SELECT count(*) FROM pred q WHERE q.model = r.model) AS n, (SELECT count(*) FROM pred q WHERE q.model = r.model AND at_gold IS NULL) AS n_gold_null FROM r GROUP BY model""")
def a01_macro_recall(spark: SparkSession, d: str) -> DataFrame:
    return M.macro_recall(predictions(spark, d), "at_gold", "at_predicted", AT, ["model"])


TARGETS = [("at_gold", "at_predicted", AT), ("isAt_gold", "isAt_predicted", IS_AT)]


@query(f"""WITH {PRED}, r AS (
 SELECT model, 0 AS t, coalesce(at_gold,'FALSE') AS gold, avg(CASE WHEN coalesce(at_gold,'FALSE') = coalesce(at_predicted,'FALSE') THEN 1.0 ELSE 0 END) AS r FROM pred GROUP BY ALL
 UNION ALL SELECT model, 1, coalesce("isAt_gold",'FALSE'), avg(CASE WHEN coalesce("isAt_gold",'FALSE') = coalesce("isAt_predicted",'FALSE') THEN 1.0 ELSE 0 END) FROM pred GROUP BY ALL),
m AS (SELECT model, t, round(avg(r), 6) AS mr FROM r GROUP BY ALL)
SELECT model, max(mr) FILTER (t = 0) AS mr_0, max(mr) FILTER (t = 1) AS mr_1, round((max(mr) FILTER (t = 0) + max(mr) FILTER (t = 1)) / 2, 6) AS global_score FROM m GROUP BY model""")
def a02_global_score(spark: SparkSession, d: str) -> DataFrame:
    return M.global_score(predictions(spark, d), TARGETS, ["model"])


@query(f"WITH {COUNTS} SELECT model, gold, p AS pred, CAST(sum(n) AS BIGINT) AS n FROM c WHERE gold IN ('TRUE','PROBABLE','FALSE') AND p IN ('TRUE','PROBABLE','FALSE') GROUP BY ALL")
def a03_confusion(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(predictions(spark, d), "at_gold", "at_predicted", AT, ["model"])


REPORT = COUNTS + """, l AS (SELECT unnest(['TRUE','PROBABLE','FALSE']) AS label), t AS (SELECT model, label,
 sum(CASE WHEN gold = label AND p = label THEN n ELSE 0 END) AS tp, sum(CASE WHEN p = label THEN n ELSE 0 END) AS predicted, sum(CASE WHEN gold = label THEN n ELSE 0 END) AS support FROM c CROSS JOIN l GROUP BY ALL),
f AS (SELECT model, label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM t),
rep AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM f)"""


@query(f"WITH {REPORT} SELECT model, label, round(prec, 6) AS \"precision\", round(rec, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep")
def a04_class_report(spark: SparkSession, d: str) -> DataFrame:
    t = M.class_report(predictions(spark, d), "at_gold", "at_predicted", AT, ["model"])
    return t.select("model", "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"""WITH {REPORT} SELECT model, {", ".join(f"round(coalesce(avg({c}) FILTER (support > 0), 0.0), 6) AS macro_{n}, round(coalesce(sum({c} * support) / sum(support), 0.0), 6) AS weighted_{n}" for c, n in (("prec", "precision"), ("rec", "recall"), ("f1", "f1")))} FROM rep GROUP BY model""")
def a05_report_averages(spark: SparkSession, d: str) -> DataFrame:
    return M.averages(M.class_report(predictions(spark, d), "at_gold", "at_predicted", AT, ["model"]), ["model"])


@query(f"""WITH {COUNTS}, s AS (SELECT model, sum(n) AS n, sum(CASE WHEN gold = p THEN n ELSE 0 END) AS same, {", ".join(f"sum(CASE WHEN {s} = '{x}' THEN n ELSE 0 END) AS {s}_{x}" for s in ("gold", "p") for x in AT)} FROM c GROUP BY model),
q AS (SELECT model, same / n AS po, ({" + ".join(f"gold_{x} * p_{x}" for x in AT)}) / (n * n) AS pe FROM s)
SELECT model, round(po, 4) AS accuracy, round((po - pe) / (1 - pe), 4) AS kappa FROM q""")
def a06_kappa(spark: SparkSession, d: str) -> DataFrame:
    return M.kappa(predictions(spark, d), "at_gold", "at_predicted", AT, ["model"])


@query(f"""WITH {PRED}, g AS (SELECT model, coalesce(language, '?') AS language, coalesce(at_gold,'FALSE') AS gold, CASE WHEN coalesce(at_gold,'FALSE') = coalesce(at_predicted,'FALSE') THEN 1 ELSE 0 END AS hit FROM pred),
r AS (SELECT model, coalesce(language, 'OVERALL') AS language, gold, avg(hit) AS r, count(*) AS n FROM g GROUP BY GROUPING SETS ((model, gold), (model, language, gold)))
SELECT model, language, round(avg(r), 6) AS macro_recall, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL""")
def a07_by_language(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).select("model", F.coalesce("language", F.lit("?")).alias("language"), null_to_false(F.col("at_gold")).alias("gold"), (null_to_false(F.col("at_gold")) == null_to_false(F.col("at_predicted"))).cast("int").alias("hit"))
    cells = p.groupBy("model", "language", "gold").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    both = cells.unionByName(cells.withColumn("language", F.lit("OVERALL"))).groupBy("model", "language", "gold").agg((F.sum("hits") / F.sum("n")).alias("r"), F.sum("n").alias("n"))
    return both.groupBy("model", "language").agg(F.round(F.avg("r"), 6).alias("macro_recall"), F.sum("n").alias("n"))


@query(f"""WITH {PRED} SELECT model, side, label, count(*) AS n FROM (SELECT model, 'gold' AS side, coalesce(at_gold,'FALSE') AS label FROM pred UNION ALL SELECT model, 'predicted', coalesce(at_predicted,'FALSE') FROM pred) GROUP BY ALL""")
def a08_label_distribution(spark: SparkSession, d: str) -> DataFrame:
    sides = F.explode(F.array(F.struct(F.lit("gold").alias("side"), null_to_false(F.col("at_gold")).alias("label")), F.struct(F.lit("predicted").alias("side"), null_to_false(F.col("at_predicted")).alias("label"))))
    return predictions(spark, d).select("model", sides.alias("e")).groupBy("model", "e.side", "e.label").agg(F.count("*").alias("n"))


HITS = "coalesce(at_gold,'FALSE') = coalesce(at_predicted,'FALSE') AS a, coalesce(\"isAt_gold\",'FALSE') = coalesce(\"isAt_predicted\",'FALSE') AS b"


@query(f"WITH {PRED} SELECT model, count(*) AS n, count(*) FILTER (a) AS at_right, count(*) FILTER (b) AS isat_right, count(*) FILTER (a AND b) AS both_right FROM (SELECT model, {HITS} FROM pred) GROUP BY model")
def a09_accuracy_summary(spark: SparkSession, d: str) -> DataFrame:
    a = null_to_false(F.col("at_gold")) == null_to_false(F.col("at_predicted"))
    b = null_to_false(F.col("isAt_gold")) == null_to_false(F.col("isAt_predicted"))
    return predictions(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.count_if(a).alias("at_right"), F.count_if(b).alias("isat_right"), F.count_if(a & b).alias("both_right"))


SPLIT_SQL = "sp AS (SELECT document_id, min(lower(trim(split))) AS split FROM split_ids GROUP BY document_id)"


def document_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "split_ids").groupBy("document_id").agg(F.min(F.lower(F.trim("split"))).alias("split"))


@query(f"""WITH {PRED}, {SPLIT_SQL}, g AS (SELECT model, split, coalesce(at_gold,'FALSE') AS gold, avg(CASE WHEN coalesce(at_gold,'FALSE') = coalesce(at_predicted,'FALSE') THEN 1.0 ELSE 0 END) AS r, count(*) AS n, count(*) FILTER (at_gold IS NULL) AS z FROM pred JOIN sp USING (document_id) GROUP BY ALL)
SELECT model, split, round(avg(r), 6) AS macro_recall, CAST(sum(n) AS BIGINT) AS n, CAST(sum(z) AS BIGINT) AS n_gold_null FROM g GROUP BY ALL""")
def a10_by_split(spark: SparkSession, d: str) -> DataFrame:
    return M.macro_recall(predictions(spark, d).join(document_split(spark, d), "document_id"), "at_gold", "at_predicted", AT, ["model", "split"])


PER = PRED + """, g AS (SELECT document_id, pers_entity_id, loc_entity_id, model, coalesce(at_predicted,'FALSE') AS p, coalesce(at_gold,'FALSE') AS gold FROM pred),
per AS (SELECT document_id, pers_entity_id, loc_entity_id, count(*) AS n_total, count(*) FILTER (p = gold) AS n_correct FROM g GROUP BY ALL)"""


def per_instance(spark: SparkSession, d: str) -> DataFrame:
    hit = null_to_false(F.col("at_gold")) == null_to_false(F.col("at_predicted"))
    return predictions(spark, d).groupBy(*KEY).agg(F.count("*").alias("n_total"), F.count_if(hit).alias("n_correct"))


@query(f"""WITH {PER}, w AS (SELECT document_id, pers_entity_id, loc_entity_id, p, count(*) AS k FROM g WHERE p <> gold GROUP BY ALL),
m AS (SELECT document_id, pers_entity_id, loc_entity_id, p AS modal_wrong FROM (SELECT *, row_number() OVER (PARTITION BY document_id, pers_entity_id, loc_entity_id ORDER BY k DESC, p) AS rn FROM w) WHERE rn = 1)
SELECT per.*, round(n_correct / n_total, 6) AS frac, modal_wrong, n_correct = 0 AS all_wrong, n_correct = n_total AS all_right FROM per LEFT JOIN m USING (document_id, pers_entity_id, loc_entity_id)""")
def a11_instance_correctness(spark: SparkSession, d: str) -> DataFrame:
    gold, p = null_to_false(F.col("at_gold")), null_to_false(F.col("at_predicted"))
    cells = predictions(spark, d).groupBy(*KEY, p.alias("p"), (p == gold).alias("hit")).agg(F.count("*").alias("k"))
    t = cells.groupBy(*KEY).agg(F.sum("k").alias("n_total"), F.sum(F.when(F.col("hit"), F.col("k")).otherwise(0)).alias("n_correct"), F.array_sort(F.collect_list(F.when(~F.col("hit"), F.struct((-F.col("k")).alias("k"), F.col("p"))))).alias("w"))
    return t.select(*KEY, "n_total", "n_correct", F.round(F.col("n_correct") / F.col("n_total"), 6).alias("frac"), F.get("w", F.lit(0))["p"].alias("modal_wrong"), (F.col("n_correct") == 0).alias("all_wrong"), (F.col("n_correct") == F.col("n_total")).alias("all_right"))


@query(f"""WITH {PRED} SELECT document_id, pers_entity_id, loc_entity_id, CASE WHEN count(DISTINCT at_gold) > 1 THEN 'MISMATCH(' || array_to_string(list_sort(list(DISTINCT at_gold) FILTER (at_gold IS NOT NULL)), '|') || ')' ELSE max(at_gold) END AS gold,
 {", ".join(f"max(at_predicted) FILTER (model = '{m}') AS p_{i}" for i, m in enumerate(MODELS))} FROM pred GROUP BY ALL""")
def a12_instance_table(spark: SparkSession, d: str) -> DataFrame:
    golds = F.array_sort(F.collect_set("at_gold"))
    picks = [F.max(F.when(F.col("model") == m, F.col("at_predicted"))).alias(f"p_{i}") for i, m in enumerate(MODELS)]
    t = predictions(spark, d).groupBy(*KEY).agg(golds.alias("golds"), *picks)
    gold = F.when(F.size("golds") > 1, F.concat(F.lit("MISMATCH("), F.array_join("golds", "|"), F.lit(")"))).otherwise(F.get("golds", F.lit(0)))
    return t.select(*KEY, gold.alias("gold"), *[f"p_{i}" for i in range(len(MODELS))])


@query(f"WITH {PER} SELECT n_total, n_correct, count(*) AS n FROM per GROUP BY ALL")
def a13_hardness_histogram(spark: SparkSession, d: str) -> DataFrame:
    return per_instance(spark, d).groupBy("n_total", "n_correct").agg(F.count("*").alias("n"))


@query(f"WITH {PER} SELECT document_id, pers_entity_id, loc_entity_id, n_correct, n_total FROM per ORDER BY n_correct, n_total DESC, document_id, pers_entity_id, loc_entity_id LIMIT 50")
def a14_hardest(spark: SparkSession, d: str) -> DataFrame:
    return per_instance(spark, d).orderBy("n_correct", F.desc("n_total"), *KEY).limit(50).select(*KEY, "n_correct", "n_total")


@query(f"""WITH {WIDE}, o AS (SELECT coalesce(at_gold,'FALSE') AS gold, CASE WHEN coalesce(at_gold,'FALSE') IN (at_0, at_1, at_2) THEN coalesce(at_gold,'FALSE') ELSE at_0 END AS best FROM wide)
SELECT count(*) AS n, count(*) FILTER (gold = best) AS n_right, round(count(*) FILTER (gold = best) / count(*), 6) AS oracle_accuracy FROM o""")
def a15_oracle_bound(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d).withColumn("gold", null_to_false(F.col("at_gold"))).withColumn("votes", F.array("at_0", "at_1", "at_2"))
    best = F.when(F.exists("votes", lambda v: v == F.col("gold")), F.col("gold")).otherwise(F.get("votes", F.lit(0)))
    return w.agg(F.count("*").alias("n"), F.count_if(best == F.col("gold")).alias("n_right")).withColumn("oracle_accuracy", F.round(F.try_divide("n_right", "n"), 6))


@query(f"""WITH {WIDE} SELECT at_0 || '/' || at_1 || '/' || at_2 AS cell, count(*) AS n, count(*) FILTER (at_0 = coalesce(at_gold,'FALSE')) AS first_right FROM wide GROUP BY ALL ORDER BY n DESC, cell LIMIT 12""")
def a16_vote_cells(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d).groupBy(F.concat_ws("/", "at_0", "at_1", "at_2").alias("cell")).agg(F.count("*").alias("n"), F.count_if(F.col("at_0") == null_to_false(F.col("at_gold"))).alias("first_right"))
    return w.orderBy(F.desc("n"), "cell").limit(12)


@query(f"""WITH {PRED}, v AS (SELECT model, document_id, pers_entity_id, loc_entity_id, coalesce(at_predicted,'FALSE') AS p FROM pred)
SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, count(*) FILTER (a.p = b.p) AS n_same, round(count(*) FILTER (a.p = b.p) / count(*), 6) AS agreement
FROM v a JOIN v b USING (document_id, pers_entity_id, loc_entity_id) WHERE a.model < b.model GROUP BY ALL""")
def a17_pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The self-join over model pairs: models per key are few, so pairs are made within the key's row."""
    votes = predictions(spark, d).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("model", null_to_false(F.col("at_predicted")).alias("p")))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda b: F.struct(a["model"].alias("model_a"), b["model"].alias("model_b"), (a["p"] == b["p"]).alias("same")))))
    e = votes.select(F.explode(pairs).alias("e")).select("e.*")
    return e.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.count_if("same").alias("n_same")).withColumn("agreement", F.round(F.col("n_same") / F.col("n"), 6))


@query(f"""WITH {WIDE} SELECT coalesce(language,'?') AS language, CASE WHEN a AND b THEN 'both right' WHEN a THEN 'first right' WHEN b THEN 'second right' ELSE 'both wrong' END AS cell, isat_0 = isat_1 AS agree, count(*) AS n
FROM (SELECT *, isat_0 = coalesce(isat_gold,'FALSE') AS a, isat_1 = coalesce(isat_gold,'FALSE') AS b FROM wide) GROUP BY ALL""")
def a18_disagreement_anatomy(spark: SparkSession, d: str) -> DataFrame:
    g = null_to_false(F.col("isat_gold"))
    a, b = F.col("isat_0") == g, F.col("isat_1") == g
    cell = F.when(a & b, "both right").when(a, "first right").when(b, "second right").otherwise("both wrong")
    return wide(spark, d).groupBy(F.coalesce("language", F.lit("?")).alias("language"), cell.alias("cell"), (F.col("isat_0") == F.col("isat_1")).alias("agree")).agg(F.count("*").alias("n"))


@query(f"""WITH {WIDE} SELECT CASE WHEN isat_0 = isat_1 AND isat_1 = isat_2 THEN 'all' WHEN isat_0 = isat_1 THEN '0=1' WHEN isat_0 = isat_2 THEN '0=2' ELSE '1=2' END AS pattern, count(*) AS n, count(*) FILTER (isat_0 = coalesce(isat_gold,'FALSE')) AS first_right FROM wide GROUP BY ALL""")
def a19_three_way_patterns(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = F.col("isat_0"), F.col("isat_1"), F.col("isat_2")
    pattern = F.when((x == y) & (y == z), "all").when(x == y, "0=1").when(x == z, "0=2").otherwise("1=2")
    return wide(spark, d).groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"), F.count_if(x == null_to_false(F.col("isat_gold"))).alias("first_right"))


@query(f"""WITH {PRED}, c AS (SELECT coalesce(at_gold,'FALSE') = coalesce(at_predicted,'FALSE') AS hit, TRY_CAST(regexp_extract(raw_output, 'conf_at=([0-9]+[.][0-9]+)', 1) AS DOUBLE) AS conf FROM pred)
SELECT CAST(floor(conf * 10) AS INT) AS bin, count(*) AS n, count(*) FILTER (hit) AS n_right, round(count(*) FILTER (hit) / count(*), 6) AS accuracy FROM c WHERE conf IS NOT NULL GROUP BY ALL""")
def a20_confidence_bins(spark: SparkSession, d: str) -> DataFrame:
    """Half-open bins of a tenth of the confidence that the raw output states."""
    conf = F.regexp_extract("raw_output", r"conf_at=([0-9]+[.][0-9]+)", 1).try_cast("double")
    t = predictions(spark, d).select(conf.alias("conf"), (null_to_false(F.col("at_gold")) == null_to_false(F.col("at_predicted"))).alias("hit")).where("conf is not null")
    return t.groupBy(F.floor(F.col("conf") * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.count_if("hit").alias("n_right")).withColumn("accuracy", F.round(F.col("n_right") / F.col("n"), 6))




@query("""SELECT field, min(v) AS lo, max(v) AS hi, round(avg(v), 6) AS mean, median(v) AS mid, count(v) AS n FROM (
 SELECT 'ocr_quality' AS field, ocr_quality AS v FROM relation_instance UNION ALL SELECT 'sentence_position', CAST(sentence_position AS DOUBLE) FROM relation_instance
 UNION ALL SELECT 'len_context', CAST(length(context) AS DOUBLE) FROM relation_instance UNION ALL SELECT 'n_pers', CAST(len(pers_mentions_list) AS DOUBLE) FROM relation_instance) GROUP BY field""")
def a21_descriptive(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "relation_instance")
    fields = [("ocr_quality", F.col("ocr_quality")), ("sentence_position", F.col("sentence_position").cast("double")), ("len_context", F.length("context").cast("double")), ("n_pers", F.size("pers_mentions_list").cast("double"))]
    fields[3] = ("n_pers", F.when(F.col("pers_mentions_list").isNotNull(), fields[3][1]))
    e = t.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("v")) for n, c in fields])).alias("e")).select("e.*")
    return e.groupBy("field").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.avg("v"), 6).alias("mean"), F.median("v").alias("mid"), F.count("v").alias("n"))


@query("""SELECT "at", "isAt" AS isat, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM relation_instance GROUP BY "at", "isAt" """)
def a21_joint_distribution(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "relation_instance").groupBy("at", F.col("isAt").alias("isat")).agg(F.count("*").alias("n"))
    return t.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a handful of rows


@query("""SELECT language, count(*) AS n, count(pers_wikidata_QID) AS pers_qid, count(loc_wikidata_QID) AS loc_qid, count(*) FILTER (pers_wikidata_QID IS NOT NULL AND loc_wikidata_QID IS NOT NULL) AS both_qid FROM relation_instance GROUP BY language""")
def a21_qid_coverage(spark: SparkSession, d: str) -> DataFrame:
    both = F.col("pers_wikidata_QID").isNotNull() & F.col("loc_wikidata_QID").isNotNull()
    return table(spark, d, "relation_instance").groupBy("language").agg(F.count("*").alias("n"), F.count("pers_wikidata_QID").alias("pers_qid"), F.count("loc_wikidata_QID").alias("loc_qid"), F.count_if(both).alias("both_qid"))


@query(f"""WITH {SPLIT_SQL} SELECT split, language, count(*) FILTER ("at" = 'TRUE') AS "TRUE", count(*) FILTER ("at" = 'PROBABLE') AS "PROBABLE", count(*) FILTER ("at" = 'FALSE') AS "FALSE" FROM relation_instance JOIN sp USING (document_id) GROUP BY split, language""")
def a22_language_by_label(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "relation_instance").join(document_split(spark, d), "document_id")
    return t.groupBy("split", "language").agg(*[F.count_if(F.col("at") == x).alias(x) for x in AT])


@query("""SELECT CAST(substr(date, 1, 4) AS INT) // 10 * 10 AS decade, count(DISTINCT document_id) AS n_documents FROM articles WHERE regexp_matches(date, '^[0-9]{4}') GROUP BY 1""")
def a23_decades(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "articles").where(F.col("date").rlike("^[0-9]{4}"))
    return t.groupBy((F.floor(F.substring("date", 1, 4).cast("int") / 10) * 10).cast("int").alias("decade")).agg(F.count_distinct("document_id").alias("n_documents"))


@query("""WITH l AS (SELECT language, length(text) AS v, row_number() OVER (PARTITION BY language ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY language) AS n FROM articles WHERE text IS NOT NULL)
SELECT language, max(n) AS n, CAST(max(v) FILTER (i = CAST(floor(n * 0.1) AS BIGINT)) AS INTEGER) AS p10, CAST(max(v) FILTER (i = CAST(floor(n * 0.5) AS BIGINT)) AS INTEGER) AS p50, CAST(max(v) FILTER (i = CAST(floor(n * 0.9) AS BIGINT)) AS INTEGER) AS p90 FROM l GROUP BY language""")
def a23_length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by index: the value at position floor(q * n) of each language's sorted lengths.

    Lengths are counted first, so the running sum goes over distinct lengths, not rows.
    """
    c = table(spark, d, "articles").where("text is not null").groupBy("language", F.length("text").alias("v")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("language").orderBy("v")
    c = c.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy("language")))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("v")))
    return c.groupBy("language").agg(F.max("n").alias("n"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"))


FLAGS = {"has_timex": ("coalesce(has_timex_in_isat_window, false)", lambda: F.coalesce("has_timex_in_isat_window", F.lit(False))), "lead": ("coalesce(sentence_position BETWEEN 0 AND 1, false)", lambda: F.coalesce(F.col("sentence_position").between(0, 1), F.lit(False))), "has_pers_qid": ("pers_wikidata_QID IS NOT NULL", lambda: F.col("pers_wikidata_QID").isNotNull())}


@query("WITH b AS (SELECT avg(CASE WHEN \"at\" = 'TRUE' THEN 1.0 ELSE 0 END) AS base FROM relation_instance), f AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, {s} AS f, \"at\" FROM relation_instance" for k, (s, _) in FLAGS.items()) + """)
SELECT feature, round(avg(CASE WHEN f THEN 1.0 ELSE 0 END), 6) AS fire_rate, count(*) FILTER (f AND "at" = 'TRUE') AS true_where_fired, round(avg(CASE WHEN "at" = 'TRUE' THEN 1.0 ELSE 0 END) FILTER (f) - max(base), 6) AS lift FROM f, b GROUP BY feature""")
def a24_feature_lift(spark: SparkSession, d: str) -> DataFrame:
    """How far the share of at=TRUE rises above its base where a feature fires, and how often it fires."""
    t = table(spark, d, "relation_instance")
    hit = F.coalesce(F.col("at") == "TRUE", F.lit(False))
    e = t.select(hit.alias("hit"), F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), c().alias("f")) for k, (_, c) in FLAGS.items()])).alias("e")).select("hit", "e.*")
    g = e.groupBy("feature").agg(F.avg(F.col("f").cast("int")).alias("rate"), F.count_if(F.col("f") & F.col("hit")).alias("true_where_fired"), F.avg(F.when(F.col("f"), F.col("hit").cast("int"))).alias("fired"), F.avg(F.col("hit").cast("int")).alias("base"))
    return g.select("feature", F.round("rate", 6).alias("fire_rate"), "true_where_fired", F.round(F.col("fired") - F.col("base"), 6).alias("lift"))


@query(f"""WITH {PRED}, f AS (SELECT model, ('0x' || substr(md5(document_id), 1, 6))::BIGINT % 5 AS fold, avg(CASE WHEN coalesce(at_gold,'FALSE') = coalesce(at_predicted,'FALSE') THEN 1.0 ELSE 0 END) AS a FROM pred GROUP BY ALL)
SELECT model, round(avg(a), 6) AS mean, round(coalesce(stddev_samp(a), 0.0), 6) AS sd, count(*) AS folds FROM f GROUP BY model""")
def a25_fold_mean(spark: SparkSession, d: str) -> DataFrame:
    fold = (F.conv(F.substring(F.md5("document_id"), 1, 6), 16, 10).cast("bigint") % 5).alias("fold")
    hit = (null_to_false(F.col("at_gold")) == null_to_false(F.col("at_predicted"))).cast("int")
    f = predictions(spark, d).groupBy("model", fold).agg(F.avg(hit).alias("a"))
    return f.groupBy("model").agg(F.round(F.avg("a"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("a"), F.lit(0.0)), 6).alias("sd"), F.count("*").alias("folds"))


@query()
def a26_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: random resamples. Tested for bracketing its point and for its seed."""
    return M.bootstrap(predictions(spark, d), "at_gold", "at_predicted", AT, ["model"])


@query()
def a27_bootstrap_index(spark: SparkSession, d: str) -> DataFrame:
    return M.bootstrap(predictions(spark, d), "isAt_gold", "isAt_predicted", IS_AT, ["model"], replicates=2000, quantile="index")


@query("""WITH b AS (SELECT CASE WHEN ocr_quality <= q[1] THEN 0 WHEN ocr_quality <= q[2] THEN 1 ELSE 2 END AS a, coalesce("at",'FALSE') AS b FROM relation_instance, (SELECT quantile_cont(ocr_quality, [1.0/3, 2.0/3]) AS q FROM relation_instance) WHERE ocr_quality IS NOT NULL),
c AS (SELECT a, b, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT sum(n) AS total FROM c), ma AS (SELECT a, sum(n) AS na FROM c GROUP BY a), mb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b)
SELECT round((SELECT sum(n / total * ln(n * total / (na * nb))) FROM c JOIN ma USING (a) JOIN mb USING (b), t) / (((SELECT -sum(na / total * ln(na / total)) FROM ma, t) + (SELECT -sum(nb / total * ln(nb / total)) FROM mb, t)) / 2), 6) AS nmi""")
def a28_nmi(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "relation_instance").where("ocr_quality is not null")
    cuts = t.agg(F.percentile("ocr_quality", F.array(F.lit(1.0 / 3), F.lit(2.0 / 3))).alias("q"))
    b = t.crossJoin(F.broadcast(cuts)).select(F.when(F.col("ocr_quality") <= F.col("q")[0], 0).when(F.col("ocr_quality") <= F.col("q")[1], 1).otherwise(2).alias("a"), null_to_false(F.col("at")).alias("b"))  # cuts is one row
    return M.nmi(b, "a", "b")


STATUS = "CASE WHEN regexp_matches(raw_output, '^at=(TRUE|FALSE|PROBABLE) isAt=(TRUE|FALSE)') THEN 'ok' WHEN trim(coalesce(raw_output, '')) = '' THEN 'fail' ELSE 'partial' END"


@query(f"WITH {PRED} SELECT model, count(*) AS calls, round(sum(latency_ms), 2) AS latency_ms, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'partial') AS partial, count(*) FILTER (s = 'fail') AS fail FROM (SELECT *, {STATUS} AS s FROM pred) GROUP BY model")
def a29_call_counters(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("raw_output").rlike("^at=(TRUE|FALSE|PROBABLE) isAt=(TRUE|FALSE)"), "ok").when(F.trim(F.coalesce("raw_output", F.lit(""))) == "", "fail").otherwise("partial")
    t = predictions(spark, d).withColumn("s", s)
    return t.groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum("latency_ms"), 2).alias("latency_ms"), *[F.count_if(F.col("s") == x).alias(x) for x in ("ok", "partial", "fail")])


@query(ORACLE["a02_global_score"].replace("SELECT model, max(mr) FILTER (t = 0) AS mr_0", "SELECT *, row_number() OVER (ORDER BY global_score DESC, model) AS place FROM (SELECT model, max(mr) FILTER (t = 0) AS mr_0") + ")")
def a30_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Models by score; one row each, so the unpartitioned window is tiny."""
    t = M.global_score(predictions(spark, d), TARGETS, ["model"])
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("global_score"), "model")).cast("bigint"))


@query(f"""WITH {COUNTS}, r AS (SELECT model, gold, sum(CASE WHEN gold = p THEN n ELSE 0 END) / sum(n) AS r FROM c GROUP BY ALL), m AS (SELECT model, round(avg(r), 6) AS mine FROM r GROUP BY model), o AS (SELECT model, round(avg(rec) FILTER (support > 0), 6) AS other FROM (SELECT model, gold, sum(CASE WHEN gold = p THEN n ELSE 0 END) / sum(n) AS rec, sum(n) AS support FROM c GROUP BY ALL) GROUP BY model)
SELECT model, mine, other, abs(mine - other) <= 0.001 AS consistent FROM m JOIN o USING (model)""")
def a31_scorer_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Two scorers side by side: from counts of recall, and from the class report."""
    p = predictions(spark, d)
    mine = M.macro_recall(p, "at_gold", "at_predicted", AT, ["model"], "mine").select("model", "mine")
    other = M.averages(M.class_report(p, "at_gold", "at_predicted", AT, ["model"]), ["model"]).select("model", F.col("macro_recall").alias("other"))
    return mine.join(other, "model").withColumn("consistent", F.abs(F.col("mine") - F.col("other")) <= 1e-3)


@query(f"""WITH {PER}, h AS (SELECT n_correct, count(*) AS n FROM per GROUP BY ALL), c AS (SELECT n_correct, sum(n) OVER (ORDER BY n_correct) / sum(n) OVER () AS cum FROM h)
SELECT q, min(n_correct) AS n_correct FROM c, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 1.0]::DOUBLE[]) AS q) WHERE cum >= q GROUP BY q""")
def a33_hardness_percentiles(spark: SparkSession, d: str) -> DataFrame:
    h = per_instance(spark, d).groupBy("n_correct").agg(F.count("*").alias("n"))  # as many rows as models
    c = h.select("n_correct", (F.sum("n").over(Window.orderBy("n_correct")) / F.sum("n").over(Window.partitionBy())).alias("cum"))
    q = F.explode(F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9, 1.0)]))
    return c.select("n_correct", "cum", q.alias("q")).where("cum >= q").groupBy("q").agg(F.min("n_correct").alias("n_correct"))


@query("""SELECT task, lower(trim(split)) AS split, language, coalesce(CASE WHEN task = 'at' THEN at_label ELSE "isAt_label" END, 'FALSE') AS label, count(*) AS n FROM split_ids GROUP BY ALL""")
def a34_split_balance(spark: SparkSession, d: str) -> DataFrame:
    label = null_to_false(F.when(F.col("task") == "at", F.col("at_label")).otherwise(F.col("isAt_label")))
    return table(spark, d, "split_ids").groupBy("task", F.lower(F.trim("split")).alias("split"), "language", label.alias("label")).agg(F.count("*").alias("n"))
