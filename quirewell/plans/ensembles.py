"""Ensemble, join, split and key queries over prediction_log and its neighbours, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import labels as L, sampling as S, votes as V
from ..operators.labels import KEY, null_to_false
from ..session import table
from .common import MODELS, PRED, WIDE, predictions, wide
from .scoring import SPLIT_SQL, document_split

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KEYS = ", ".join(KEY)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def voted(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d).withColumn("votes", F.array("at_0", "at_1", "at_2")).withColumn("isat_votes", F.array("isat_0", "isat_1", "isat_2"))


# ---- joins and sets


@query(f"WITH {WIDE} SELECT * FROM wide")
def j01_inner_three_way(spark: SparkSession, d: str) -> DataFrame:
    """The keys that all models answered, with every answer."""
    return wide(spark, d)


@query(f"""WITH {PRED}, a AS (SELECT * FROM pred WHERE model = 'encoder-ft'), b AS (SELECT * FROM pred WHERE model = 'llm-small-ctx')
SELECT {KEYS}, a.at_predicted, b."isAt_predicted" AS isat_predicted, coalesce(a.at_gold, b.at_gold) AS at_gold, coalesce(a."isAt_gold", b."isAt_gold") AS isat_gold, a.model IS NULL AS only_b, b.model IS NULL AS only_a FROM a FULL JOIN b USING ({KEYS})""")
def j02_full_outer_combine(spark: SparkSession, d: str) -> DataFrame:
    """at from one run, isAt from another, whichever of them knows the key."""
    p = predictions(spark, d)
    side = lambda m, n: p.where(F.col("model") == m).select(*KEY, *[F.col(c).alias(f"{n}_{c}") for c in ("model", "at_predicted", "isAt_predicted", "at_gold", "isAt_gold")])
    t = side(MODELS[0], "a").join(side(MODELS[1], "b"), list(KEY), "full")
    return t.select(*KEY, F.col("a_at_predicted").alias("at_predicted"), F.col("b_isAt_predicted").alias("isat_predicted"), F.coalesce("a_at_gold", "b_at_gold").alias("at_gold"), F.coalesce("a_isAt_gold", "b_isAt_gold").alias("isat_gold"), F.col("a_model").isNull().alias("only_b"), F.col("b_model").isNull().alias("only_a"))


GOLD = 'gold AS (SELECT sample_id, min(document_id) AS document_id, min(pers_entity_id) AS pers_entity_id, min(loc_entity_id) AS loc_entity_id, max("at") AS gold_at, max("isAt") AS gold_isat FROM relation_instance GROUP BY sample_id)'


def gold(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "relation_instance")
    return t.groupBy("sample_id").agg(*[F.min(c).alias(c) for c in KEY], F.max("at").alias("gold_at"), F.max("isAt").alias("gold_isat"))


@query(f"""WITH {PRED}, {GOLD} SELECT sample_id, coalesce(gold_at,'FALSE') AS gold_at, coalesce(at_predicted,'FALSE') AS predicted, model IS NULL AS missing FROM gold LEFT JOIN (SELECT * FROM pred WHERE model = 'encoder-ft') p USING ({KEYS})""")
def j03_left_gold(spark: SparkSession, d: str) -> DataFrame:
    """Every gold row with its prediction; a missing one is FALSE."""
    p = predictions(spark, d).where(F.col("model") == MODELS[0]).select(*KEY, "model", "at_predicted")
    t = gold(spark, d).join(p, list(KEY), "left")
    return t.select("sample_id", null_to_false(F.col("gold_at")).alias("gold_at"), null_to_false(F.col("at_predicted")).alias("predicted"), F.col("model").isNull().alias("missing"))


@query(f"""WITH {PRED} SELECT DISTINCT document_id || ' | ' || pers_entity_id || ' | ' || loc_entity_id AS sample_id FROM pred p WHERE model = 'llm-small-ctx' AND NOT EXISTS (SELECT 1 FROM pred q WHERE q.model = 'encoder-ft' AND q.document_id = p.document_id AND q.pers_entity_id = p.pers_entity_id AND q.loc_entity_id = p.loc_entity_id)""")
def j05_anti_missing(spark: SparkSession, d: str) -> DataFrame:
    """Keys of one model that another lacks."""
    p = predictions(spark, d)
    keys = lambda m: p.where(F.col("model") == m).select(*KEY)
    return keys(MODELS[1]).join(keys(MODELS[0]), list(KEY), "left_anti").distinct().select(L.sample_id().alias("sample_id"))


@query(f"""WITH {SPLIT_SQL} SELECT DISTINCT sample_id, language FROM relation_instance WHERE document_id IN (SELECT document_id FROM sp WHERE split = 'test')""")
def j06_semi_split(spark: SparkSession, d: str) -> DataFrame:
    test = document_split(spark, d).where("split = 'test'")
    return table(spark, d, "relation_instance").join(test, "document_id", "left_semi").select("sample_id", "language").distinct()



@query(f"""WITH {PRED}, k AS (SELECT {KEYS}, max(language) AS language, max(at_predicted) FILTER (model = 'encoder-ft') AS p0, max(at_predicted) FILTER (model = 'llm-small-ctx') AS p1, max(at_predicted) FILTER (model = 'vote-lookup') AS p2 FROM pred GROUP BY ALL)
SELECT {KEYS}, coalesce(CASE language WHEN 'fr' THEN p0 WHEN 'de' THEN p1 END, p2, 'MISSING') AS routed, CASE WHEN CASE language WHEN 'fr' THEN p0 WHEN 'de' THEN p1 END IS NOT NULL THEN 'route' WHEN p2 IS NOT NULL THEN 'default' ELSE 'none' END AS origin FROM k""")
def j07_routed_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Each key takes its language's model if that answered, else the default one, else MISSING."""
    picks = [F.max("language").alias("language"), *[F.max(F.when(F.col("model") == m, F.col("at_predicted"))).alias(f"p{i}") for i, m in enumerate(MODELS)]]
    k = predictions(spark, d).groupBy(*KEY).agg(*picks)
    route = F.when(F.col("language") == "fr", F.col("p0")).when(F.col("language") == "de", F.col("p1"))
    origin = F.when(route.isNotNull(), "route").when(F.col("p2").isNotNull(), "default").otherwise("none")
    return k.select(*KEY, F.coalesce(route, F.col("p2"), F.lit("MISSING")).alias("routed"), origin.alias("origin"))


@query("""WITH q AS (SELECT DISTINCT loc_entity_id, loc_wikidata_QID FROM relation_instance WHERE loc_wikidata_QID IS NOT NULL), m AS (SELECT loc_entity_id, min(loc_wikidata_QID) AS qid FROM q GROUP BY loc_entity_id)
SELECT p.loc_entity_id, m.qid, count(*) AS n FROM prediction_log p LEFT JOIN m USING (loc_entity_id) WHERE p.loc_entity_id IS NOT NULL GROUP BY ALL""")
def j08_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Fact rows are counted per place before they meet the dimension, so a hot place joins once."""
    m = table(spark, d, "relation_instance").where("loc_wikidata_QID is not null").groupBy("loc_entity_id").agg(F.min("loc_wikidata_QID").alias("qid"))
    n = table(spark, d, "prediction_log").where("loc_entity_id is not null").groupBy("loc_entity_id").agg(F.count("*").alias("n"))
    return n.join(m, "loc_entity_id", "left").select("loc_entity_id", "qid", "n")


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
x AS (SELECT event_id, e.user_id, date_diff('second', e.ts, p.ts) AS gap, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(e.ts)), p.ts) AS rn FROM e JOIN p USING (user_id))
SELECT event_id, user_id, gap FROM x WHERE rn = 1""")
def j10_nearest_in_time(spark: SparkSession, d: str) -> DataFrame:
    """The nearest purchase of each error's user, before or after: one sort per user, no pairs of events.

    The last purchase before and the first one after each error come from two
    running values over the user's events in time order.
    """
    from pyspark.sql import Window

    e = table(spark, d, "events").where(F.col("event_type").isin("error", "purchase")).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    bought = F.when(F.col("event_type") == "purchase", F.col("us"))
    w = Window.partitionBy("user_id").orderBy("us")
    before = F.last(bought, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first(bought, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    t = e.withColumn("b", before).withColumn("a", after).where(F.col("event_type") == "error").where("a is not null or b is not null")
    near = F.when(F.col("a").isNull() | ((F.col("b").isNotNull()) & (F.col("us") - F.col("b") <= F.col("a") - F.col("us"))), F.col("b")).otherwise(F.col("a"))
    gap = F.floor(near / 1_000_000) - F.floor(F.col("us") / 1_000_000)
    return t.select("event_id", "user_id", gap.cast("bigint").alias("gap"))


@query("""WITH s AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey), c AS (SELECT c_custkey, c_nationkey, (c_custkey % 25)::INT AS visit FROM customer)
SELECT c_custkey, s_nationkey AS place, n AS n_suppliers, CASE WHEN c_nationkey = s_nationkey THEN ['home'] ELSE [] END || CASE WHEN visit = s_nationkey THEN ['visit'] ELSE [] END AS linked_via FROM c JOIN s ON list_contains([c_nationkey, visit], s_nationkey)""")
def j11_membership(spark: SparkSession, d: str) -> DataFrame:
    """A theta join on membership in a list, as an equi-join with the exploded list; the other side is counted per place first."""
    c = table(spark, d, "customer").select("c_custkey", F.array(F.struct(F.lit("home").alias("via"), F.col("c_nationkey").alias("place")), F.struct(F.lit("visit").alias("via"), (F.col("c_custkey") % 25).cast("int").alias("place"))).alias("p"))
    e = c.select("c_custkey", F.posexplode("p").alias("i", "x")).select("c_custkey", "i", "x.*")
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("place")).agg(F.count("*").alias("n_suppliers"))
    t = e.join(s, "place")
    return t.groupBy("c_custkey", "place", "n_suppliers").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "via"))), lambda v: v["via"]).alias("linked_via"))


def _keys(spark, d, model):
    return predictions(spark, d).where(F.col("model") == model).select(*KEY)


@query(f"WITH {PRED} SELECT {KEYS} FROM pred WHERE model = 'encoder-ft' UNION SELECT {KEYS} FROM pred WHERE model = 'llm-small-ctx'")
def o03_key_union(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, MODELS[0]).union(_keys(spark, d, MODELS[1])).distinct()


@query(f"WITH {PRED} SELECT {KEYS} FROM pred WHERE model = 'encoder-ft' INTERSECT SELECT {KEYS} FROM pred WHERE model = 'llm-small-ctx'")
def o04_key_intersection(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, MODELS[0]).intersect(_keys(spark, d, MODELS[1]))


@query(f"WITH {PRED} SELECT {KEYS} FROM pred WHERE model = 'encoder-ft' EXCEPT SELECT {KEYS} FROM pred WHERE model = 'llm-small-ctx'")
def o05_key_difference(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d, MODELS[0]).subtract(_keys(spark, d, MODELS[1]))


@query("SELECT count(DISTINCT document_id) AS documents, count(DISTINCT pers_entity_id) AS persons, count(DISTINCT loc_entity_id) AS places, CAST(sum(len(list_distinct(pers_mentions_list))) AS BIGINT) AS mentions FROM relation_instance")
def o06_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.count_distinct(c).alias(n) for c, n in (("document_id", "documents"), ("pers_entity_id", "persons"), ("loc_entity_id", "places"))]
    known = F.array_distinct(F.array_compact("pers_mentions_list"))
    return table(spark, d, "relation_instance").agg(*counts, F.sum(F.when(F.col("pers_mentions_list").isNotNull(), F.size(known))).alias("mentions"))


@query(f"""WITH {PRED} SELECT model, {KEYS}, at_predicted FROM pred WHERE model = 'encoder-ft' UNION ALL SELECT model, {KEYS}, at_predicted FROM pred p WHERE model = 'vote-lookup' AND NOT EXISTS (SELECT 1 FROM pred q WHERE q.model = 'encoder-ft' AND q.document_id = p.document_id AND q.pers_entity_id = p.pers_entity_id AND q.loc_entity_id = p.loc_entity_id)""")
def o07_resume(spark: SparkSession, d: str) -> DataFrame:
    """Old rows, and new ones only for the keys that the old ones lack."""
    p = predictions(spark, d).select("model", *KEY, "at_predicted")
    old = p.where(F.col("model") == MODELS[0])
    return old.unionByName(p.where(F.col("model") == MODELS[2]).join(old.select(*KEY), list(KEY), "left_anti")).select("model", *KEY, "at_predicted")


# ---- votes


@query(f"WITH {WIDE} SELECT {KEYS}, [at_0, at_1, at_2] AS votes FROM wide")
def e01_vote_arrays(spark: SparkSession, d: str) -> DataFrame:
    return voted(spark, d).select(*KEY, "votes")


ORD = "CASE {} WHEN 'TRUE' THEN 2 WHEN 'PROBABLE' THEN 1 ELSE 0 END"
MEDIAN = "CASE list_sort([" + ", ".join(ORD.format(f"at_{i}") for i in range(3)) + "])[2] WHEN 2 THEN 'TRUE' WHEN 1 THEN 'PROBABLE' ELSE 'FALSE' END"
LOOKUP = WIDE + f""", {SPLIT_SQL}, w2 AS (SELECT wide.*, sp.split, {MEDIAN} AS med FROM wide JOIN sp USING (document_id)),
cnt AS (SELECT at_0, at_1, at_2, med, at_gold, count(*) AS n FROM w2 WHERE split = 'train' AND at_gold IS NOT NULL GROUP BY ALL),
top AS (SELECT *, max(n) OVER (PARTITION BY at_0, at_1, at_2) AS best, sum(n) OVER (PARTITION BY at_0, at_1, at_2) AS total FROM cnt),
lookup AS (SELECT at_0, at_1, at_2, CASE WHEN bool_or(at_gold = med) THEN max(med) ELSE min(at_gold) END AS label, CAST(max(total) AS BIGINT) AS n FROM top WHERE n = best GROUP BY at_0, at_1, at_2)"""


def lookup_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = voted(spark, d).join(document_split(spark, d), "document_id")
    return v, V.build_lookup(v.where("split = 'train'"), "votes", "at_gold")


@query(f"WITH {LOOKUP} SELECT [at_0, at_1, at_2] AS votes, label, n FROM lookup")
def e03_lookup_table(spark: SparkSession, d: str) -> DataFrame:
    return lookup_inputs(spark, d)[1]


MAJ = "CASE WHEN at_0 = at_1 OR at_0 = at_2 THEN at_0 WHEN at_1 = at_2 THEN at_1 ELSE 'FALSE' END"


@query(f"WITH {LOOKUP} SELECT {KEYS}, coalesce(label, {MAJ}) AS stacked, label IS NOT NULL AS seen FROM w2 LEFT JOIN lookup USING (at_0, at_1, at_2) WHERE split <> 'train'")
def e05_apply_lookup(spark: SparkSession, d: str) -> DataFrame:
    v, lookup = lookup_inputs(spark, d)
    return V.apply_lookup(v.where("split <> 'train'"), lookup, "votes").select(*KEY, "stacked", "seen")


@query(f"""WITH {WIDE}, c AS (SELECT *, {MEDIAN} AS med FROM wide), a AS (SELECT at_0, at_1, at_2, at_gold AS g, count(*) AS n FROM c WHERE at_gold IS NOT NULL GROUP BY ALL),
o AS (SELECT c.document_id, c.pers_entity_id, c.loc_entity_id, c.at_0, c.at_1, c.at_2, c.med, a.g, a.n - CASE WHEN a.g = c.at_gold THEN 1 ELSE 0 END AS n FROM c LEFT JOIN a USING (at_0, at_1, at_2)),
t AS (SELECT *, max(n) OVER (PARTITION BY {KEYS}) AS best FROM o),
r AS (SELECT {KEYS}, any_value({MAJ}) AS fb, max(best) AS best, CASE WHEN bool_or(g = med AND n = best) THEN max(med) ELSE min(g) FILTER (n = best) END AS label FROM t GROUP BY {KEYS})
SELECT {KEYS}, CASE WHEN best > 0 THEN label ELSE fb END AS stacked FROM r""")
def e06_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return V.leave_one_out(voted(spark, d), "votes", "at_gold").select(*KEY, "stacked")


@query(f"WITH {WIDE}, c AS (SELECT at_0 || '/' || at_1 || '/' || at_2 AS cell, at_gold AS g, count(*) AS n FROM wide WHERE at_gold IS NOT NULL GROUP BY ALL) SELECT cell, CAST(sum(n) AS BIGINT) AS n, arg_min(g, (-n, g)) AS modal_gold, string_agg(g || '=' || n, ',' ORDER BY g) AS breakdown FROM c GROUP BY cell")
def e07_cell_summary(spark: SparkSession, d: str) -> DataFrame:
    c = V.cells(voted(spark, d), "votes", "at_gold").groupBy(F.array_join("votes", "/").alias("cell"))
    t = c.agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("at_gold").alias("g")))).alias("by_n"))
    parts = F.array_sort(F.transform("by_n", lambda x: F.concat(x["g"], F.lit("="), (-x["m"]).cast("string"))))
    return t.select("cell", "n", F.get("by_n", F.lit(0))["g"].alias("modal_gold"), F.array_join(parts, ",").alias("breakdown"))


FR = {x: "(" + " + ".join(f"CASE WHEN at_{i} = '{x}' THEN 1 ELSE 0 END" for i in range(3)) + ") / 3.0" for x in L.AT}


@query(f"""WITH {WIDE}, f AS (SELECT *, {", ".join(f"{s} AS f_{x}" for x, s in FR.items())}, {", ".join(ORD.format(f"at_{i}") + f" AS o{i}" for i in range(3))} FROM wide),
g AS (SELECT *, (o0 + o1 + o2) / 3.0 AS mean, CASE WHEN at_1 = at_2 AND at_0 <> at_1 THEN at_1 ELSE at_0 END AS modal FROM f)
SELECT {KEYS}, {", ".join(f"round(f_{x}, 6) AS vote_frac_{x}" for x in L.AT)}, round(-({" + ".join(f"CASE WHEN f_{x} > 0 THEN f_{x} * ln(f_{x}) ELSE 0 END" for x in L.AT)}), 6) AS vote_entropy, CASE WHEN at_0 = at_1 AND at_1 = at_2 THEN 1.0::DOUBLE ELSE 0 END AS unanimous,
 round(((CASE WHEN at_0 <> at_1 THEN 1 ELSE 0 END) + (CASE WHEN at_0 <> at_2 THEN 1 ELSE 0 END) + (CASE WHEN at_1 <> at_2 THEN 1 ELSE 0 END)) / 3.0, 6) AS pairwise_disagreement, CAST(greatest(o0, o1, o2) - least(o0, o1, o2) AS DOUBLE) AS ordinal_range,
 round(sqrt(((o0 - mean) ** 2 + (o1 - mean) ** 2 + (o2 - mean) ** 2) / 3.0), 6) AS ordinal_std, CASE WHEN f_TRUE > 0 AND f_FALSE > 0 AND f_PROBABLE = 0 THEN 1.0::DOUBLE ELSE 0 END AS bimodal_true_false, CASE WHEN modal = 'PROBABLE' THEN 1.0::DOUBLE ELSE 0 END AS modal_is_probable FROM g""")
def e08_disagreement_features(spark: SparkSession, d: str) -> DataFrame:
    f = V.disagreement(F.col("votes"), 3)
    names = [f"vote_frac_{x}" for x in L.AT] + ["vote_entropy", "unanimous", "pairwise_disagreement", "ordinal_range", "ordinal_std", "bimodal_true_false", "modal_is_probable"]
    return voted(spark, d).select(*KEY, *[(F.round(f[n], 6) + 0.0).alias(n) for n in names])


@query(f"WITH {WIDE} SELECT {KEYS}, CASE WHEN at_0 = at_1 OR at_0 = at_2 THEN at_0 WHEN at_1 = at_2 THEN at_1 ELSE 'PROBABLE' END AS by_tied, CASE WHEN at_0 = at_1 OR at_0 = at_2 THEN at_0 WHEN at_1 = at_2 THEN at_1 ELSE 'FALSE' END AS by_false, CASE WHEN at_1 = at_2 AND at_0 <> at_1 THEN at_1 ELSE at_0 END AS by_first FROM wide")
def e09_plurality(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("votes")
    return voted(spark, d).select(*KEY, V.plurality(v).alias("by_tied"), V.plurality(v, "prefer_false").alias("by_false"), V.plurality(v, "first").alias("by_first"))


@query(f"WITH {WIDE} SELECT {KEYS}, CASE WHEN at_0 = at_1 OR at_0 = at_2 THEN at_0 WHEN at_1 = at_2 THEN at_1 ELSE {MEDIAN} END AS voted FROM wide")
def e10_plurality_median_of_all(spark: SparkSession, d: str) -> DataFrame:
    return voted(spark, d).select(*KEY, V.plurality(F.col("votes"), "median_of_all").alias("voted"))


NT = "(" + " + ".join(f"CASE WHEN isat_{i} = 'TRUE' THEN 1 ELSE 0 END" for i in range(3)) + ")"


@query(f"""WITH {WIDE} SELECT {KEYS}, CASE WHEN {NT} * 2 > 3 THEN 'TRUE' ELSE 'FALSE' END AS majority, CASE WHEN 2.0 * (CASE WHEN isat_0 = 'TRUE' THEN 2.0 ELSE 0 END + CASE WHEN isat_1 = 'TRUE' THEN 1.0 ELSE 0 END + CASE WHEN isat_2 = 'TRUE' THEN 0.5 ELSE 0 END) > 3.5 THEN 'TRUE' ELSE 'FALSE' END AS weighted,
 {NT} >= 1 AS any_true, {NT} = 3 AS all_true, CASE WHEN {NT} >= 2 THEN 'TRUE' ELSE 'FALSE' END AS two_of_three FROM wide""")
def e11_binary_votes(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("isat_votes")
    return voted(spark, d).select(*KEY, V.strict_majority(v).alias("majority"), V.weighted(v, [2.0, 1.0, 0.5]).alias("weighted"), F.exists(v, lambda x: x == "TRUE").alias("any_true"), F.forall(v, lambda x: x == "TRUE").alias("all_true"), V.at_least(v, 2).alias("two_of_three"))


@query(f"WITH {WIDE} SELECT {KEYS}, CASE WHEN at_0 = 'FALSE' AND at_1 = 'PROBABLE' THEN 'PROBABLE' ELSE at_0 END AS final_at, at_0 = 'FALSE' AND at_1 = 'PROBABLE' AS flipped, isat_2 AS final_isat FROM wide")
def e14_flip_rule(spark: SparkSession, d: str) -> DataFrame:
    flip = (F.col("at_0") == "FALSE") & (F.col("at_1") == "PROBABLE")
    return voted(spark, d).select(*KEY, F.when(flip, "PROBABLE").otherwise(F.col("at_0")).alias("final_at"), flip.alias("flipped"), F.col("isat_2").alias("final_isat"))


CONF = "TRY_CAST(regexp_extract(raw_output, 'conf_isAt=([0-9]+[.][0-9]+)', 1) AS DOUBLE)"
CONFS = WIDE + f", conf AS (SELECT {KEYS}, coalesce({CONF}, 0.5) AS conf FROM pred WHERE model = 'llm-small-ctx'), wc AS (SELECT wide.*, conf, CASE WHEN {NT} * 2 > 3 THEN 'TRUE' ELSE 'FALSE' END AS maj FROM wide JOIN conf USING ({KEYS}))"


def with_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = predictions(spark, d).where(F.col("model") == MODELS[1]).select(*KEY, F.coalesce(F.regexp_extract("raw_output", r"conf_isAt=([0-9]+[.][0-9]+)", 1).try_cast("double"), F.lit(0.5)).alias("conf"))
    return voted(spark, d).join(c, list(KEY)).withColumn("maj", V.strict_majority(F.col("isat_votes")))


@query(f"WITH {CONFS} SELECT t, count(*) FILTER (conf >= t) AS kept, count(*) FILTER (CASE WHEN conf >= t THEN isat_1 ELSE maj END = coalesce(isat_gold, 'FALSE')) AS n_right, count(*) AS n FROM wc, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS t) GROUP BY t")
def e15_confidence_routing(spark: SparkSession, d: str) -> DataFrame:
    """A model's label where it is sure enough, else the majority; all thresholds in one pass over the rows."""
    e = with_confidence(spark, d).withColumn("t", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.6, 0.7, 0.8, 0.9)])))
    label = F.when(F.col("conf") >= F.col("t"), F.col("isat_1")).otherwise(F.col("maj"))
    return e.groupBy("t").agg(F.count_if(F.col("conf") >= F.col("t")).alias("kept"), F.count_if(label == null_to_false(F.col("isat_gold"))).alias("n_right"), F.count("*").alias("n"))


AMB = "(CASE WHEN conf > 1e-9 THEN -conf * ln(conf) ELSE 0 END + CASE WHEN 1 - conf > 1e-9 THEN -(1 - conf) * ln(1 - conf) ELSE 0 END) / ln(2) * (1 - abs(2 * conf - 1))"


@query(f"WITH {CONFS}, r AS (SELECT *, row_number() OVER (ORDER BY round({AMB}, 9) DESC, {KEYS}) AS rn, count(*) OVER () AS n FROM wc) SELECT {KEYS}, rn <= round_even(0.2 * n, 0) AS routed, CASE WHEN rn <= round_even(0.2 * n, 0) THEN maj ELSE isat_1 END AS final_isat FROM r")
def e16_ambiguity_routing(spark: SparkSession, d: str) -> DataFrame:
    """The fifth of the rows whose label is most ambiguous goes to the majority."""
    t = with_confidence(spark, d).withColumn("ambiguity", F.round(V.binary_ambiguity(F.col("conf")), 9))
    r = V.top_share(t, "ambiguity", 0.2, list(KEY))
    return r.select(*KEY, "routed", F.when(F.col("routed"), F.col("maj")).otherwise(F.col("isat_1")).alias("final_isat"))


@query(f"WITH {CONFS}, r AS (SELECT *, row_number() OVER (ORDER BY round(abs(2 * conf - 1), 9), {KEYS}) AS rn, count(*) OVER () AS n FROM wc) SELECT {KEYS}, rn <= round_even(0.1 * n, 0) AS routed FROM r")
def e17_margin_routing(spark: SparkSession, d: str) -> DataFrame:
    t = with_confidence(spark, d).withColumn("margin", F.round(F.abs(2 * F.col("conf") - 1), 9))
    return V.top_share(t, "margin", 0.1, list(KEY), ascending=True).select(*KEY, "routed")


@query(f"WITH {CONFS} SELECT {KEYS}, CASE WHEN isat_1 = 'FALSE' THEN isat_1 WHEN conf >= 0.8 THEN isat_1 ELSE isat_0 END AS s1, CASE WHEN isat_1 = 'TRUE' THEN isat_1 ELSE maj END AS s2 FROM wc")
def e18_class_conditional(spark: SparkSession, d: str) -> DataFrame:
    s1 = F.when(F.col("isat_1") == "FALSE", F.col("isat_1")).when(F.col("conf") >= 0.8, F.col("isat_1")).otherwise(F.col("isat_0"))
    return with_confidence(spark, d).select(*KEY, s1.alias("s1"), F.when(F.col("isat_1") == "TRUE", F.col("isat_1")).otherwise(F.col("maj")).alias("s2"))


@query(f"WITH {CONFS} SELECT {KEYS}, CASE WHEN isat_0 = isat_1 THEN isat_0 WHEN conf >= 0.8 THEN isat_1 ELSE maj END AS final_isat, CASE WHEN isat_0 = isat_1 THEN 'agree' WHEN conf >= 0.8 THEN 'confident' ELSE 'majority' END AS stage FROM wc")
def e19_agreement_cascade(spark: SparkSession, d: str) -> DataFrame:
    same, sure = F.col("isat_0") == F.col("isat_1"), F.col("conf") >= 0.8
    return with_confidence(spark, d).select(*KEY, F.when(same, F.col("isat_0")).when(sure, F.col("isat_1")).otherwise(F.col("maj")).alias("final_isat"), F.when(same, "agree").when(sure, "confident").otherwise("majority").alias("stage"))


@query("""WITH r AS (SELECT sample_id, max("at") AS "at", max(ocr_quality) AS q, max(sentence_position) AS s FROM relation_instance GROUP BY sample_id)
SELECT sample_id, CASE WHEN coalesce("at",'FALSE') = 'FALSE' AND ((q BETWEEN 0.9 AND 1.0 AND s BETWEEN 0 AND 3) OR (s BETWEEN 4 AND 5 AND q BETWEEN 0.95 AND 1.0)) THEN 'PROBABLE' ELSE coalesce("at",'FALSE') END AS label,
 CASE WHEN coalesce("at",'FALSE') = 'FALSE' AND ((q BETWEEN 0.9 AND 1.0 AND s BETWEEN 0 AND 3) OR (s BETWEEN 4 AND 5 AND q BETWEEN 0.95 AND 1.0)) THEN ['FALSE>PROBABLE'] ELSE [] END AS history FROM r""")
def e23_subgroup_override(spark: SparkSession, d: str) -> DataFrame:
    """FALSE becomes PROBABLE where any eligible interval pattern matches; the change is appended to the history."""
    from ..operators.mining import matches_any

    patterns = [{"q": (0.9, 1.0), "s": (0.0, 3.0)}, {"s": (4.0, 5.0), "q": (0.95, 1.0)}]
    r = table(spark, d, "relation_instance").groupBy("sample_id").agg(F.max("at").alias("at"), F.max("ocr_quality").alias("q"), F.max("sentence_position").alias("s"))
    hit = (null_to_false(F.col("at")) == "FALSE") & matches_any(patterns)
    empty = F.array().cast("array<string>")
    return r.select("sample_id", F.when(hit, "PROBABLE").otherwise(null_to_false(F.col("at"))).alias("label"), F.when(hit, F.array_append(empty, F.lit("FALSE>PROBABLE"))).otherwise(empty).alias("history"))


@query("""WITH c AS (SELECT document_id, pers_entity_id, loc_entity_id, at_predicted AS label, count(*) AS k, min(logged_at) AS first FROM prediction_log WHERE at_predicted IS NOT NULL AND document_id IS NOT NULL AND pers_entity_id IS NOT NULL AND loc_entity_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, pers_entity_id, loc_entity_id ORDER BY k DESC, first, label) AS rn, sum(k) OVER (PARTITION BY document_id, pers_entity_id, loc_entity_id) AS total FROM c)
SELECT document_id, pers_entity_id, loc_entity_id, label, round(k / total, 6) AS agreement FROM r WHERE rn = 1""")
def e25_sample_majority(spark: SparkSession, d: str) -> DataFrame:
    """The label that most samples of a key gave; ties go to the one seen first."""
    t = table(spark, d, "prediction_log").dropna(subset=["at_predicted", *KEY])
    c = t.groupBy(*KEY, F.col("at_predicted").alias("label")).agg(F.count("*").alias("k"), F.min("logged_at").alias("first"))
    best = c.groupBy(*KEY).agg(F.min(F.struct((-F.col("k")).alias("m"), "first", "label")).alias("b"), F.sum("k").alias("total"))
    return best.select(*KEY, F.col("b.label").alias("label"), F.round(-F.col("b.m") / F.col("total"), 6).alias("agreement"))


@query(f"WITH {WIDE} SELECT array_to_string(list_filter([CASE WHEN at_0 = 'TRUE' THEN 'encoder-ft' END, CASE WHEN at_1 = 'TRUE' THEN 'llm-small-ctx' END, CASE WHEN at_2 = 'TRUE' THEN 'vote-lookup' END], lambda x: x IS NOT NULL), '+') AS provenance, count(*) AS n FROM wide GROUP BY ALL")
def e26_vote_provenance(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat_ws("+", *[F.when(F.col(f"at_{i}") == "TRUE", F.lit(m)) for i, m in enumerate(MODELS)])
    return wide(spark, d).groupBy(p.alias("provenance")).agg(F.count("*").alias("n"))


@query(f"""WITH {LOOKUP}, alpha AS (SELECT at_0, at_1, at_2, min(at_gold) AS label FROM top WHERE n = best GROUP BY ALL), b AS (SELECT w2.*, lookup.label AS om, alpha.label AS al FROM w2 LEFT JOIN lookup USING (at_0, at_1, at_2) LEFT JOIN alpha USING (at_0, at_1, at_2) WHERE split <> 'train')
SELECT tie, fb, count(*) AS n, count(*) FILTER (l IS NOT NULL) AS seen, count(*) FILTER (coalesce(l, CASE WHEN fb = 'majority' THEN {MAJ} ELSE 'FALSE' END) = coalesce(at_gold,'FALSE')) AS n_right
FROM (SELECT *, CASE WHEN tie = 'ordinal_median' THEN om ELSE al END AS l FROM b, (SELECT unnest(['ordinal_median','alphabetical']) AS tie), (SELECT unnest(['majority','label']) AS fb)) GROUP BY tie, fb""")
def e28_tie_fallback_grid(spark: SparkSession, d: str) -> DataFrame:
    """The stacker under each tie rule and fallback."""
    v = voted(spark, d).join(document_split(spark, d), "document_id")
    out = None
    for tie in ("ordinal_median", "alphabetical"):
        lookup = V.build_lookup(v.where("split = 'train'"), "votes", "at_gold", tie)
        for how in ("majority", "label"):
            t = V.apply_lookup(v.where("split <> 'train'"), lookup, "votes", how)
            g = t.agg(F.count("*").alias("n"), F.count_if("seen").alias("seen"), F.count_if(F.col("stacked") == null_to_false(F.col("at_gold"))).alias("n_right")).select(F.lit(tie).alias("tie"), F.lit(how).alias("fb"), "n", "seen", "n_right")
            out = g if out is None else out.unionByName(g)
    return out


# ---- predicates and keys


@query("""SELECT sample_id, document_id || ' | ' || pers_entity_id || ' | ' || loc_entity_id = sample_id AS same, string_split(sample_id, ' | ')[2] AS pers, coalesce(abs(nearest_timex_distance) <= 30, false) AS in_window, coalesce("at" = 'FALSE' AND "isAt" = 'TRUE', false) AS breaks, CASE WHEN "at" = 'FALSE' THEN 'FALSE' ELSE "isAt" END AS isat_repaired FROM relation_instance""")
def f_instance_predicates(spark: SparkSession, d: str) -> DataFrame:
    """P03-P07: composite id and its parts, the window flag, the constraint and its repair."""
    same = L.sample_id() == F.col("sample_id")
    parts = F.split("sample_id", r" \| ")
    return table(spark, d, "relation_instance").select("sample_id", same.alias("same"), F.get(parts, F.lit(1)).alias("pers"), L.within_window(F.col("nearest_timex_distance")).alias("in_window"), L.breaks_constraint(F.col("at"), F.col("isAt")).alias("breaks"), L.repaired(F.col("at"), F.col("isAt")).alias("isat_repaired"))


@query("SELECT at_predicted AS label, count(*) AS n FROM prediction_log WHERE at_predicted IS NOT NULL AND at_predicted NOT IN ('TRUE','PROBABLE') GROUP BY 1")
def f_label_domain(spark: SparkSession, d: str) -> DataFrame:
    """P02 with FALSE taken out of the domain, so that there is something to report."""
    return L.outside(table(spark, d, "prediction_log"), "at_predicted", ("TRUE", "PROBABLE"))


@query("WITH ok AS (SELECT model FROM prediction_log GROUP BY model HAVING count(at_predicted) > 0 AND count(DISTINCT at_predicted) > 1) SELECT model, count(*) AS n FROM prediction_log WHERE model IN (SELECT model FROM ok) GROUP BY model")
def f_real_predictions(spark: SparkSession, d: str) -> DataFrame:
    """P08: models with labels, and more than one kind of them."""
    per = table(spark, d, "prediction_log").groupBy("model").agg(F.count("*").alias("n"), F.count("at_predicted").alias("known"), F.count_distinct("at_predicted").alias("kinds"))
    return per.where("known > 0 and kinds > 1").select("model", "n")


@query("SELECT DISTINCT split, CASE WHEN upper(trim(split)) IN ('TRUE','FALSE') THEN upper(trim(split)) ELSE split END AS kept FROM split_ids UNION SELECT DISTINCT lower(\"isAt_label\"), CASE WHEN upper(trim(lower(\"isAt_label\"))) IN ('TRUE','FALSE') THEN upper(trim(\"isAt_label\")) ELSE lower(\"isAt_label\") END FROM split_ids")
def f_case_labels(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "split_ids")
    a = t.select("split", L.case_normalised(F.col("split")).alias("kept"))
    b = t.select(F.lower("isAt_label").alias("split"), L.case_normalised(F.lower("isAt_label")).alias("kept"))
    return a.union(b).distinct()


# ---- splits and sampling


STRATUM = "coalesce(\"at\",'FALSE') || '_' || coalesce(\"isAt\",'FALSE')"
UNIQ = "u AS (SELECT sample_id, min(document_id) AS document_id, max(language) AS language, max(\"at\") AS \"at\", max(\"isAt\") AS \"isAt\" FROM relation_instance GROUP BY sample_id)"


def uniq(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relation_instance").groupBy("sample_id").agg(F.min("document_id").alias("document_id"), F.max("language").alias("language"), F.max("at").alias("at"), F.max("isAt").alias("isAt"))


@query(f"WITH {UNIQ} SELECT sample_id, CAST((row_number() OVER (PARTITION BY {STRATUM} ORDER BY md5(sample_id), sample_id) - 1) % 5 AS INT) AS fold FROM u")
def m01_stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    stratum = F.concat_ws("_", null_to_false(F.col("at")), null_to_false(F.col("isAt")))
    return S.stratified_folds(uniq(spark, d).withColumn("stratum", stratum), "sample_id", ["stratum"], 5).select("sample_id", "fold")


STR3 = f"WITH {UNIQ}, s AS (SELECT *, row_number() OVER (PARTITION BY language, \"at\", \"isAt\" ORDER BY md5(sample_id), sample_id) AS rn, count(*) OVER (PARTITION BY language, \"at\", \"isAt\") AS n FROM u)"


@query(f"{STR3} SELECT sample_id, CASE WHEN n < 5 THEN 'train' WHEN rn <= greatest(1, round_even(n * 0.15, 0)) THEN 'test' WHEN rn <= greatest(1, round_even(n * 0.15, 0)) + greatest(1, round_even(n * 0.15, 0)) THEN 'val' ELSE 'train' END AS split FROM s")
def m03_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_split(uniq(spark, d), "sample_id", ["language", "at", "isAt"], 0.15, 0.15).select("sample_id", "split")


@query(f"""WITH {UNIQ}, {SPLIT_SQL}, t AS (SELECT u.* FROM u JOIN sp USING (document_id) WHERE split = 'train'), s AS (SELECT *, row_number() OVER (PARTITION BY language, "at", "isAt" ORDER BY md5(sample_id), sample_id) AS rn, count(*) OVER (PARTITION BY language, "at", "isAt") AS n FROM t)
SELECT sample_id, CASE WHEN n >= 4 AND rn <= greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM s""")
def m04_val_carve(spark: SparkSession, d: str) -> DataFrame:
    t = uniq(spark, d).join(document_split(spark, d).where("split = 'train'").select("document_id"), "document_id", "left_semi")
    return S.carve(t, "sample_id", ["language", "at", "isAt"], 0.1, 4).select("sample_id", "split")


@query(f"WITH {UNIQ}, s AS (SELECT *, row_number() OVER (PARTITION BY \"at\" ORDER BY md5(sample_id), sample_id) AS rn, count(*) OVER (PARTITION BY \"at\") AS n FROM u) SELECT sample_id, CASE WHEN n >= 4 AND rn <= greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM s")
def m22_val_carve_by_class(spark: SparkSession, d: str) -> DataFrame:
    return S.carve(uniq(spark, d), "sample_id", ["at"], 0.1, 4).select("sample_id", "split")


@query(f"WITH {UNIQ}, c AS (SELECT coalesce(\"at\",'FALSE') AS label, count(*) AS n FROM u GROUP BY ALL), w AS (SELECT label, n, (SELECT sum(n) FROM c) / n AS w FROM c) SELECT label, n, round(w * (SELECT count(*) FROM c) / (SELECT sum(w) FROM w), 6) AS weight FROM w")
def m06_class_weights(spark: SparkSession, d: str) -> DataFrame:
    return S.class_weights(uniq(spark, d).withColumn("label", null_to_false(F.col("at"))), "label")


@query("""WITH s AS (SELECT avg(ocr_quality) AS m, CASE WHEN stddev_pop(ocr_quality) < 1e-6 THEN 1 ELSE stddev_pop(ocr_quality) END AS sd FROM relation_instance WHERE ocr_quality IS NOT NULL)
SELECT sample_id, round((ocr_quality - m) / sd, 5) AS z FROM relation_instance, s WHERE ocr_quality IS NOT NULL""")
def m07_standardise(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "relation_instance").where("ocr_quality is not null").select("sample_id", "ocr_quality")
    return S.standardised(t, ["ocr_quality"]).select("sample_id", F.round("ocr_quality", 5).alias("z"))


@query(f"SELECT CASE WHEN d > 0.02 THEN 'go' WHEN d < -0.02 THEN 'no-go' ELSE 'hold' END AS gate, a, b FROM (SELECT a, b, a - b AS d FROM (WITH {PRED} SELECT round(avg(CASE WHEN at_gold = at_predicted THEN 1.0 ELSE 0 END) FILTER (model = 'encoder-ft'), 6) AS a, round(avg(CASE WHEN at_gold = at_predicted THEN 1.0 ELSE 0 END) FILTER (model = 'llm-small-ctx'), 6) AS b FROM pred))")
def m18_gate(spark: SparkSession, d: str) -> DataFrame:
    hit = F.coalesce((F.col("at_gold") == F.col("at_predicted")).cast("int"), F.lit(0))
    t = predictions(spark, d).agg(*[F.round(F.avg(F.when(F.col("model") == m, hit)), 6).alias(n) for m, n in ((MODELS[0], "a"), (MODELS[1], "b"))])
    return t.select(F.when(F.col("a") - F.col("b") > 0.02, "go").when(F.col("a") - F.col("b") < -0.02, "no-go").otherwise("hold").alias("gate"), "a", "b")


@query("""SELECT DISTINCT sample_id, ['TRUE','PROBABLE','FALSE'][1 + (('0x' || substr(md5(sample_id), 1, 6))::BIGINT % 3)] AS at_predicted FROM relation_instance""")
def m21_random_baseline(spark: SparkSession, d: str) -> DataFrame:
    """A baseline that guesses by hash: the same guess for a sample wherever and however often it runs."""
    return S.hash_baseline(table(spark, d, "relation_instance").select("sample_id").distinct(), "sample_id", L.AT).withColumnRenamed("guess", "at_predicted")
