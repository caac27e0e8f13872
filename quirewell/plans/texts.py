"""Text feature, parser, rule and retrieval queries, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lexicons as X, parse as P, text as T
from ..operators import rules as R
from ..session import table
from .common import PRED, predictions

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def features(df: DataFrame, keys: list[str], cols: dict) -> DataFrame:
    return df.select(*keys, *[(F.round(c.cast("double"), 6) + 0.0).alias(n) for n, c in cols.items()])


def with_text(spark: SparkSession, d: str) -> DataFrame:
    """Instances with the whole text of their article."""
    a = table(spark, d, "articles").groupBy("document_id").agg(F.max("text").alias("text"))
    r = table(spark, d, "relation_instance").dropDuplicates(["sample_id"])
    return r.join(a, "document_id", "left").withColumn("pers", T.known(F.col("pers_mentions_list"))).withColumn("locs", T.known(F.col("loc_mentions_list")))


R_SQL = "r AS (SELECT DISTINCT ON (sample_id) *, list_filter(coalesce(pers_mentions_list, []), lambda x: x IS NOT NULL AND x <> '') AS pers, list_filter(coalesce(loc_mentions_list, []), lambda x: x IS NOT NULL AND x <> '') AS locs FROM relation_instance)"


def instances(spark: SparkSession, d: str) -> DataFrame:
    """Distinct rows: repeated rows are equal in what is used here."""
    r = table(spark, d, "relation_instance")
    return r.withColumn("pers", T.known(F.col("pers_mentions_list"))).withColumn("locs", T.known(F.col("loc_mentions_list")))


# ---- scans and nested documents


DOCS = "docs AS (SELECT document_id, loaded_at, unnest(sampled_pairs) AS p, generate_subscripts(sampled_pairs, 1) - 1 AS pair_no FROM articles)"


@query(f"WITH {DOCS} SELECT document_id, loaded_at, CAST(pair_no AS INTEGER) AS pair_no, p.pers_entity_id, p.loc_entity_id, p.\"at\" AS label FROM docs WHERE p IS NOT NULL")
def s03_unnest_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents to pairs; null lists give none, null pairs keep their position."""
    e = table(spark, d, "articles").select("document_id", "loaded_at", F.posexplode("sampled_pairs").alias("pair_no", "p")).where("p is not null")
    return e.select("document_id", "loaded_at", "pair_no", "p.pers_entity_id", "p.loc_entity_id", F.col("p.at").alias("label"))


@query(f"WITH {DOCS} SELECT document_id, CAST(pair_no AS INTEGER) AS pair_no, p.pers_entity_id || '' AS pers_entity_id, p.loc_entity_id FROM docs JOIN (SELECT document_id, max(loaded_at) AS loaded_at FROM articles GROUP BY document_id) USING (document_id, loaded_at) WHERE p IS NOT NULL")
def s04_ordered_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the latest delivery, with their position."""
    a = table(spark, d, "articles")
    latest = a.groupBy("document_id").agg(F.max("loaded_at").alias("loaded_at"))
    e = a.join(latest, ["document_id", "loaded_at"]).select("document_id", F.posexplode("sampled_pairs").alias("pair_no", "p")).where("p is not null")
    return e.select("document_id", "pair_no", "p.pers_entity_id", "p.loc_entity_id")


@query("SELECT task, lower(trim(split)) AS split, count(DISTINCT sample_id) AS n FROM split_ids WHERE task = 'at' GROUP BY ALL")
def s06_split_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "split_ids").where("task = 'at'").groupBy("task", F.lower(F.trim("split")).alias("split")).agg(F.count_distinct("sample_id").alias("n"))


K02 = PRED + """, a AS (SELECT document_id, max(loaded_at) AS loaded_at FROM articles GROUP BY document_id),
e AS (SELECT document_id, unnest(sampled_pairs) AS p, generate_subscripts(sampled_pairs, 1) AS i FROM articles JOIN a USING (document_id, loaded_at)),
j AS (SELECT e.document_id, i, p.pers_entity_id AS pers, p.loc_entity_id AS loc, coalesce(q.at_predicted, 'FALSE') AS la, CASE WHEN coalesce(q.at_predicted, 'FALSE') = 'FALSE' THEN 'FALSE' ELSE coalesce(q."isAt_predicted", 'FALSE') END AS li, q.model IS NULL AS missing, coalesce(q.at_predicted,'FALSE') = 'FALSE' AND q."isAt_predicted" = 'TRUE' AS fixed
 FROM e LEFT JOIN (SELECT * FROM pred WHERE model = 'encoder-ft') q ON q.document_id = e.document_id AND q.pers_entity_id = p.pers_entity_id AND q.loc_entity_id = p.loc_entity_id WHERE p IS NOT NULL)"""


@query(f"WITH {K02} SELECT document_id, list(pers || '/' || loc || '=' || la || ',' || li ORDER BY i) AS pairs FROM j GROUP BY document_id")
def k02_submission(spark: SparkSession, d: str) -> DataFrame:
    """Predictions merged back into the documents, pair order kept, missing ones FALSE, the constraint repaired."""
    from ..sources.submission import merged

    m = merged(table(spark, d, "articles"), predictions(spark, d).where("model = 'encoder-ft'"))
    text = F.transform("sampled_pairs", lambda p: F.concat(p["pers_entity_id"], F.lit("/"), p["loc_entity_id"], F.lit("="), p["at"], F.lit(","), p["isAt"]))
    return m.select("document_id", text.alias("pairs"))


@query(f"WITH {K02} SELECT count(DISTINCT document_id) AS documents, count(*) AS pairs, count(*) FILTER (missing) AS missing, count(*) FILTER (fixed) AS fixed, count(*) FILTER (la = 'TRUE') AS at_true, count(*) FILTER (li = 'TRUE') AS isat_true FROM j")
def k03_submission_stats(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.submission import stats

    return stats(table(spark, d, "articles"), predictions(spark, d).where("model = 'encoder-ft'"))


@query(f"""WITH {PRED} SELECT document_id, pers_entity_id, loc_entity_id, {", ".join(f"CAST(max(CASE WHEN model = '{m}' AND coalesce(at_predicted,'FALSE') = coalesce(at_gold,'FALSE') THEN 1 ELSE 0 END) AS INTEGER) AS hit_{i}" for i, m in enumerate(("encoder-ft", "llm-small-ctx", "vote-lookup")))} FROM pred GROUP BY ALL""")
def k07_per_instance_table(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.coalesce("at_predicted", F.lit("FALSE")) == F.coalesce("at_gold", F.lit("FALSE"))).cast("int")
    picks = [F.max(F.when(F.col("model") == m, hit).otherwise(0)).alias(f"hit_{i}") for i, m in enumerate(("encoder-ft", "llm-small-ctx", "vote-lookup"))]
    return predictions(spark, d).groupBy("document_id", "pers_entity_id", "loc_entity_id").agg(*picks)


# ---- hierarchy walk


@query("""WITH RECURSIVE up AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region), walk AS (SELECT child AS start, parent AS node, 1 AS depth FROM up UNION ALL SELECT start, parent, depth + 1 FROM walk JOIN up ON up.child = walk.node WHERE depth < 5)
SELECT start, node, CAST(depth AS INTEGER) AS depth FROM walk""")
def s17_hierarchy_walk(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors up to depth five over an edge table, as a recursive query."""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    edges = n.union(r)
    return spark.sql(
        "WITH RECURSIVE walk(start, node, depth) AS (SELECT child, parent, 1 FROM {edges} UNION ALL SELECT walk.start, e.parent, walk.depth + 1 FROM walk JOIN {edges} e ON e.child = walk.node WHERE walk.depth < 5) SELECT start, node, depth FROM walk",
        edges=edges,
    )


# ---- time


@query("SELECT DISTINCT date, CASE WHEN regexp_matches(substr(date,1,10), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN substr(date,1,10) WHEN regexp_matches(substr(date,1,10), '^[0-9]{4}-[0-9]{2}$') THEN substr(date,1,10) || '-01' WHEN regexp_matches(substr(date,1,10), '^[0-9]{4}$') THEN substr(date,1,10) || '-01-01' ELSE '1900-01-01' END AS pub_date FROM articles")
def f06_pub_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").select("date", T.pub_date(F.col("date")).alias("pub_date")).distinct()


@query("""WITH x AS (SELECT sample_id, date, temporal_expressions AS e FROM relation_instance), u AS (SELECT sample_id, date, unnest(e) AS t, generate_subscripts(e, 1) AS i FROM x),
v AS (SELECT sample_id, i, date_diff('day', try_cast(date AS DATE), try_cast(CASE WHEN length(t.value) < 7 THEN NULL WHEN regexp_matches(t.value, '^[0-9]{4}-[0-9]{1,2}$') THEN t.value || '-01' ELSE t.value END AS DATE)) AS g FROM u WHERE regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'))
SELECT DISTINCT x.sample_id, CAST(m.g AS INTEGER) AS nearest FROM x LEFT JOIN (SELECT sample_id, arg_min(g, (abs(g), i)) AS g FROM v WHERE g IS NOT NULL GROUP BY sample_id) m USING (sample_id)""")
def f07_nearest_timex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relation_instance").select("sample_id", T.nearest_timex(F.col("temporal_expressions"), F.col("date")).alias("nearest")).distinct()


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\b(no\\s+longer|formerly|once)\\b') THEN 'negation' WHEN regexp_matches(text, '(?i)\\b(currently|at\\s+present|nowadays|these\\s+days|at\\s+the\\s+moment)\\b') THEN 'present' WHEN regexp_matches(text, '(?i)\\b(recently|lately|yesterday|tomorrow|the\\s+other\\s+day)\\b') THEN 'relative_only' ELSE 'no_signal' END AS category FROM documents WHERE lower(lang) = 'en' AND text IS NOT NULL""")
def f01_signal_category(spark: SparkSession, d: str) -> DataFrame:
    """The category of each English document's temporal words (English words are ASCII, so SQL sees the same)."""
    docs = table(spark, d, "documents").where("lower(lang) = 'en' and text is not null")
    return docs.select("doc_id", T.signal_category(F.col("text")).alias("category"))


@query()
def f01_signals(spark: SparkSession, d: str) -> DataFrame:
    """Every temporal word of every article, all languages; no SQL, as word borders before accents differ there."""
    s = table(spark, d, "articles").where("text is not null").select("document_id", "loaded_at", F.explode(T.temporal_signals(F.col("text"))).alias("s"))
    return s.select("document_id", "loaded_at", "s.*")


PERSON = "person AS (SELECT 'Q' || c_custkey AS qid, CAST(1700 + c_custkey % 250 AS INTEGER) AS birth, CASE WHEN c_custkey % 3 = 0 THEN CAST(1760 + c_custkey % 260 AS INTEGER) END AS death FROM customer)"


def persons(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for the person dimension: years derived from the customer key."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.concat(F.lit("Q"), k).alias("qid"), (1700 + k % 250).cast("int").alias("birth"), F.when(k % 3 == 0, (1760 + k % 260).cast("int")).alias("death"))


@query(f"""WITH {PERSON}, o AS (SELECT o_orderkey, 'Q' || o_custkey AS qid, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE year(o_orderdate) - 100 END AS y FROM orders)
SELECT o_orderkey, CASE WHEN y IS NULL THEN 'unknown' WHEN birth IS NULL OR birth > y THEN 'no_match' WHEN death IS NOT NULL AND death < y THEN 'dead_historical' WHEN y < 1980 THEN 'alive_past' ELSE 'alive_now' END AS status FROM o LEFT JOIN person USING (qid)""")
def f08_person_status(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Q"), "o_custkey").alias("qid"), F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate") - 100).alias("y"))
    return o.join(persons(spark, d), "qid", "left").select("o_orderkey", T.person_status(F.col("birth"), F.col("death"), F.col("y")).alias("status"))


@query("SELECT DISTINCT sample_id, CASE WHEN pers_wikidata_QID IS NULL OR loc_wikidata_QID IS NULL THEN 'unknown' WHEN right(pers_wikidata_QID, 1) = right(loc_wikidata_QID, 1) THEN 'match' ELSE 'no_match' END AS match FROM relation_instance")
def f09_location_match(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in relation links a person and a place whose identifiers end alike."""
    p, q = F.col("pers_wikidata_QID"), F.col("loc_wikidata_QID")
    return table(spark, d, "relation_instance").select("sample_id", T.location_match(p.isNotNull(), q.isNotNull(), F.right(p, F.lit(1)) == F.right(q, F.lit(1))).alias("match")).distinct()


@query("""SELECT DISTINCT sample_id, round(CASE WHEN coalesce(sentence_position, -1) >= 0 THEN least(1.0, sentence_position / 50.0) ELSE 0.0 END, 6)::DOUBLE AS sentence_position_norm, CASE WHEN sentence_position BETWEEN 0 AND 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_lead_paragraph, CASE WHEN abs(nearest_timex_distance) <= 30 THEN 1.0 ELSE 0.0 END::DOUBLE AS has_timex_in_window,
 round(coalesce(least(1.0, abs(nearest_timex_distance) / 365.0), 0.0), 6)::DOUBLE AS nearest_timex_distance_norm, round(coalesce(ocr_quality, 1.0), 6) AS ocr_quality FROM relation_instance""")
def f12_temporal_vector(spark: SparkSession, d: str) -> DataFrame:
    v = T.temporal_vector(F.col("sentence_position"), F.lit(None).cast("string"), F.col("nearest_timex_distance"), F.lit(None).cast("string"), F.col("ocr_quality"))
    names = ("sentence_position_norm", "is_lead_paragraph", "has_timex_in_window", "nearest_timex_distance_norm", "ocr_quality")
    return features(table(spark, d, "relation_instance"), ["sample_id"], {n: v[n] for n in names}).distinct()


# ---- evidence


@query(f"""WITH {R_SQL}, g AS (SELECT sample_id, context, pers, locs, list_min(list_filter(flatten(list_transform(pers, lambda p: list_transform(locs, lambda q: CASE WHEN instr(context, p) > 0 AND instr(context, q) > 0 THEN greatest(0, abs(instr(context, p) - instr(context, q)) - CASE WHEN instr(context, p) < instr(context, q) THEN length(p) ELSE length(q) END) END))), lambda x: x IS NOT NULL)) AS gap FROM r)
SELECT sample_id, round(coalesce(least(gap / 500.0, 1.0), 1.0), 6)::DOUBLE AS entity_char_distance, coalesce(CASE WHEN gap < 20 THEN 1.0 ELSE 0.0 END, 0.0)::DOUBLE AS entities_adjacent FROM g""")
def f16a_proximity(spark: SparkSession, d: str) -> DataFrame:
    gap = T.char_gap(F.col("context"), F.col("pers"), F.col("locs"))
    t = instances(spark, d).dropDuplicates(["sample_id"])
    return features(t, ["sample_id"], {"entity_char_distance": F.coalesce(F.least(gap / 500.0, F.lit(1.0)), F.lit(1.0)), "entities_adjacent": T.flag(gap < 20)})


@query("SELECT DISTINCT sample_id, " + " + ".join(f"CASE WHEN contains(lower(coalesce(context,'')), '{h}') THEN 1 ELSE 0 END" for h in X.HEDGES) + " AS n_hedges, (" + " OR ".join(f"contains(lower(coalesce(context,'')), '{w.lower()}')" for w in ("would", "might", "could", "may have", "should have", "aurait", "pourrait", "serait", "eût", "fût", "dürfte", "könnte", "würde", "hätte", "wäre", "géif", "kéint", "sollt", "hätt", "wier", "géing")) + ") AS subjunctive FROM relation_instance")
def f16c_lexicon_flags(spark: SparkSession, d: str) -> DataFrame:
    c = F.coalesce("context", F.lit(""))
    return table(spark, d, "relation_instance").select("sample_id", T.count_hits(c, X.HEDGES).alias("n_hedges"), T.contains_any(c, X.SUBJUNCTIVE).alias("subjunctive")).distinct()


@query(f"""WITH {R_SQL}, t AS (SELECT document_id, max(text) AS text FROM articles GROUP BY document_id), x AS (SELECT r.sample_id, text, pers, locs FROM r LEFT JOIN t USING (document_id))
SELECT sample_id, coalesce(list_sum(list_transform(locs, lambda m: (length(text) - length(replace(text, m, ''))) // length(m))), 0)::BIGINT AS direct, coalesce(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: len(list_filter(pers, lambda m: contains(s, m))) > 0 AND len(list_filter(locs, lambda m: contains(s, m))) > 0)), 0)::INTEGER AS shared FROM x""")
def f16e_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often the places are named in the whole article, and sentences that name person and place."""
    t = with_text(spark, d)
    both = F.coalesce(F.when(F.col("text").isNotNull(), T.sentences_with_both(F.col("text"), F.col("pers"), F.col("locs"))), F.lit(0))
    return t.select("sample_id", F.coalesce(T.total_count(F.col("text"), F.col("locs")), F.lit(0)).alias("direct"), both.alias("shared"))


@query()
def f16_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The 13 evidence features over whole articles; no SQL for its dynamic patterns, tested on fixtures."""
    t = with_text(spark, d)
    c, x, p, q = F.coalesce("context", F.lit("")), F.coalesce("text", F.lit("")), F.col("pers"), F.col("locs")
    t = t.withColumn("more", T.expanded(c, p, F.lower(F.coalesce("language", F.lit("en")))))
    gap = T.char_gap(c, p, q)
    hedges = T.count_hits(c, X.HEDGES)
    cols = {
        "entity_char_distance": F.coalesce(F.least(gap / 500.0, F.lit(1.0)), F.lit(1.0)), "entities_adjacent": T.flag(gap < 20), "has_preposition_link": T.flag(T.preposition_link(c, p, q)),
        "has_genitive_construction": T.flag(T.genitive(c, q)), "has_role_title": T.flag(T.contains_any(c, X.ROLES)), "has_hedging": T.flag(hedges > 0), "n_hedging_words": F.least(hedges / 3.0, F.lit(1.0)),
        "has_subjunctive": T.flag(T.contains_any(c, X.SUBJUNCTIVE)), "person_mention_count": F.least(T.total_count(x, F.col("more")) / 10.0, F.lit(1.0)), "location_mention_count": F.least(T.total_count(x, q) / 10.0, F.lit(1.0)),
        "cooccurrence_sentences": F.least(T.sentences_with_both(x, F.col("more"), q) / 5.0, F.lit(1.0)), "n_competing_locations": F.least(T.competing_places(x, q) / 10.0, F.lit(1.0)),
    }
    return features(t, ["sample_id"], cols | {"entity_in_quotes": T.in_quotes(F.col("context"), p, q)})


def _verbs_sql() -> str:
    from ..functions.lexicons import VERBS

    any_of = lambda words: "(" + " OR ".join(f"contains(lower(coalesce(context,'')), '{w}')" for w in words) + ")"
    parts = [f"CASE WHEN CASE language WHEN 'fr' THEN {any_of(by['fr'])} WHEN 'de' THEN {any_of(by['de'])} ELSE {any_of(by['en'])} END THEN 1.0 ELSE 0.0 END::DOUBLE AS verb_type_{k}" for k, by in VERBS.items()]
    return "SELECT DISTINCT sample_id, " + ", ".join(parts) + " FROM relation_instance"


@query(_verbs_sql())
def f17_verb_types(spark: SparkSession, d: str) -> DataFrame:
    v = T.verb_types(F.coalesce("context", F.lit("")), F.col("language"))
    return features(table(spark, d, "relation_instance"), ["sample_id"], {k: c for k, c in v.items() if k.startswith("verb_type")}).distinct()


@query("""WITH m AS (SELECT DISTINCT unnest(loc_mentions_list) AS child, loc_wikidata_QID AS qid FROM relation_instance WHERE loc_wikidata_QID IS NOT NULL), c AS (SELECT qid, list(child ORDER BY child) AS children FROM m WHERE child IS NOT NULL AND child <> '' GROUP BY qid),
t AS (SELECT document_id, max(text) AS text FROM articles GROUP BY document_id), r AS (SELECT DISTINCT sample_id, document_id, loc_wikidata_QID AS qid FROM relation_instance)
SELECT sample_id, round(least(coalesce(list_sum(list_transform(children, lambda m: (length(text) - length(replace(text, m, ''))) // length(m))), 0) / 10.0, 1.0), 6)::DOUBLE AS hierarchical_loc_count FROM r LEFT JOIN c USING (qid) LEFT JOIN t USING (document_id)""")
def f18_hierarchy_counts(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of any surface form of the place, from an edge table place -> forms (those that its instances list)."""
    r = table(spark, d, "relation_instance")
    forms = r.where("loc_wikidata_QID is not null").select(F.col("loc_wikidata_QID").alias("qid"), F.explode("loc_mentions_list").alias("child")).where("child is not null and child <> ''").distinct()
    by = forms.groupBy("qid").agg(F.sort_array(F.collect_list("child")).alias("children"))
    text = table(spark, d, "articles").groupBy("document_id").agg(F.max("text").alias("text"))
    t = r.select("sample_id", "document_id", F.col("loc_wikidata_QID").alias("qid")).distinct().join(by, "qid", "left").join(text, "document_id", "left")
    return features(t, ["sample_id"], {"hierarchical_loc_count": F.least(F.coalesce(T.total_count(F.col("text"), F.col("children")), F.lit(0)) / 10.0, F.lit(1.0))})


@query()
def f19_datelines(spark: SparkSession, d: str) -> DataFrame:
    """The five dateline features over whole articles; SQL lacks look-behind, so tested on fixtures."""
    t = T.datelines(with_text(spark, d).fillna({"text": ""}), "text", "locs")
    return t.select("sample_id", *[c for c in t.columns if c.startswith("location_")])


# ---- markers and templates



@query(f"""WITH {R_SQL}, a AS (SELECT sample_id, pers, locs, coalesce(context,'') AS t, list_min(list_transform(list_filter(pers, lambda x: instr(lower(coalesce(context,'')), lower(x)) > 0), lambda x: struct_pack(k := instr(lower(coalesce(context,'')), lower(x)), n := -length(x)))) AS z FROM r)
SELECT sample_id, CASE WHEN z IS NULL THEN t ELSE substr(t, 1, z.k - 1) || '[E1] ' || substr(t, z.k, -z.n) || ' [/E1]' || substr(t, z.k - z.n) END AS marked FROM a""")
def f30_person_marker(spark: SparkSession, d: str) -> DataFrame:
    t = instances(spark, d).dropDuplicates(["sample_id"])
    return t.select("sample_id", T.wrapped(F.coalesce("context", F.lit("")), F.col("pers"), "[E1]", "[/E1]")[0].alias("marked"))


_WRAP = lambda source, text, mentions, a, b, out: f"""(SELECT *, CASE WHEN z_{out} IS NULL THEN {text} ELSE substr({text}, 1, z_{out}.k - 1) || '{a} ' || substr({text}, z_{out}.k, -z_{out}.n) || ' {b}' || substr({text}, z_{out}.k - z_{out}.n) END AS {out} FROM (SELECT *, list_min(list_transform(list_filter({mentions}, lambda e: instr(lower({text}), lower(e)) > 0), lambda e: struct_pack(k := instr(lower({text}), lower(e)), n := -length(e)))) AS z_{out} FROM {source}))"""
MARKED = f"""{R_SQL}, base AS (SELECT sample_id, pers, locs, date, coalesce(context,'') AS t FROM r), w AS (SELECT * FROM {_WRAP(_WRAP("base", "t", "pers", "[E1]", "[/E1]", "x"), "x", "locs", "[E2]", "[/E2]", "y")}),
q AS (SELECT *, CASE WHEN z_x IS NULL AND len(pers) > 0 THEN '[E1] ' || pers[1] || ' [/E1]' END AS p1, CASE WHEN z_y IS NULL AND len(locs) > 0 THEN '[E2] ' || locs[1] || ' [/E2]' END AS p2 FROM w),
m AS (SELECT *, CASE WHEN p2 IS NOT NULL THEN p2 || ' . ' ELSE '' END || CASE WHEN p1 IS NOT NULL THEN p1 || ' . ' ELSE '' END || y AS separate, CASE WHEN concat_ws(' ', p1, p2) <> '' THEN concat_ws(' ', p1, p2) || ' . ' || y ELSE y END AS joint, CASE WHEN coalesce(date, '') = '' THEN 'unknown' ELSE date END AS around FROM q)"""


@query(f"WITH {MARKED} SELECT sample_id, separate, joint FROM m")
def f30_markers(spark: SparkSession, d: str) -> DataFrame:
    """Both entities marked, with a separate and with a joint prefix for those that aren't in the context."""
    t = instances(spark, d).dropDuplicates(["sample_id"])
    return t.select("sample_id", T.marked(F.col("context"), F.col("pers"), F.col("locs")).alias("separate"), T.marked(F.col("context"), F.col("pers"), F.col("locs"), joint=True).alias("joint"))


@query()
def f31_tags(spark: SparkSession, d: str) -> DataFrame:
    t = instances(spark, d).dropDuplicates(["sample_id"])
    a = T.tagged(F.coalesce("context", F.lit("")), F.col("pers"), "<PERSON>", "</PERSON>")
    return t.withColumn("a", a).select("sample_id", T.tagged(F.col("a"), F.col("locs"), "<LOCATION>", "</LOCATION>").alias("tagged"))


@query(f"WITH {R_SQL} SELECT sample_id, '[E1] ' || coalesce(pers[1], '') || ' [/E1] [MASK] [E2] ' || coalesce(locs[1], '') || ' [/E2] .' AS m1 FROM r")
def f32_template_m1(spark: SparkSession, d: str) -> DataFrame:
    t = instances(spark, d).dropDuplicates(["sample_id"])
    return t.select("sample_id", T.template("M1", F.col("context"), F.col("pers"), F.col("locs"), F.col("date")).alias("m1"))


@query(f"""WITH {MARKED} SELECT sample_id, separate || ' The relationship between [E1] and [E2] is [MASK] .' AS m2, 'Published: ' || around || ' . ' || separate || ' At this time, [E1] is [MASK] [E2] .' AS m3,
separate || ' In general, [E1] is [MASK] associated with [E2] . Around ' || around || ', [E1] is [MASK] present at [E2] .' AS m4, separate || ' [E1] [MASK] [MASK] [MASK] [E2] .' AS m5 FROM m""")
def f32_templates(spark: SparkSession, d: str) -> DataFrame:
    t = instances(spark, d).dropDuplicates(["sample_id"])
    return t.select("sample_id", *[T.template(m, F.col("context"), F.col("pers"), F.col("locs"), F.col("date")).alias(m.lower()) for m in ("M2", "M3", "M4", "M5")])


@query("SELECT DISTINCT sample_id, 'Person: ' || coalesce(pers_mentions_list[1], '?') || chr(10) || 'Place: ' || coalesce(loc_mentions_list[1], '?') || CASE WHEN date IS NULL THEN '' ELSE chr(10) || 'Date: ' || date END || CASE WHEN context IS NULL THEN '' ELSE chr(10) || 'Context: ' || context END AS message FROM relation_instance")
def f34_user_message(spark: SparkSession, d: str) -> DataFrame:
    """A prompt message with optional blocks; absent ones leave no line."""
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit("?"))
    lines = [F.concat(F.lit("Person: "), first("pers_mentions_list")), F.concat(F.lit("Place: "), first("loc_mentions_list")), F.concat(F.lit("Date: "), "date"), F.concat(F.lit("Context: "), "context")]
    return table(spark, d, "relation_instance").select("sample_id", F.concat_ws("\n", *lines).alias("message")).distinct()


@query()
def f03_shared_sentence(spark: SparkSession, d: str) -> DataFrame:
    """Index of the first sentence with both entities, and the context around it, from whole articles."""
    t = with_text(spark, d)
    return t.select("sample_id", T.shared_sentence(F.col("text"), F.col("pers"), F.col("locs")).alias("position"), T.context_window(F.col("text"), F.col("pers"), F.col("locs")).alias("window"))


# ---- parsers and rules


@query(f"""WITH {PRED} SELECT model, document_id, pers_entity_id, loc_entity_id, nullif(upper(regexp_extract(raw_output, '(?i)at\\s*=\\s*(TRUE|FALSE|PROBABLE)\\s+isAt\\s*=\\s*(TRUE|FALSE)\\s*\\|\\s*conf_at\\s*=\\s*([0-9.]+)\\s+conf_isAt\\s*=\\s*([0-9.]+)', 1)), '') AS label, try_cast(regexp_extract(raw_output, '(?i)conf_at\\s*=\\s*([0-9.]+)\\s+conf_isAt', 1) AS DOUBLE) AS conf FROM pred WHERE regexp_matches(raw_output, '(?i)at\\s*=\\s*(TRUE|FALSE|PROBABLE)\\s+isAt\\s*=\\s*(TRUE|FALSE)\\s*\\|\\s*conf_at\\s*=\\s*([0-9.]+)\\s+conf_isAt\\s*=\\s*([0-9.]+)')""")
def f40_strict_parse(spark: SparkSession, d: str) -> DataFrame:
    t = predictions(spark, d).withColumn("p", P.combined(F.col("raw_output"))).where("p.status = 'ok'")
    return t.select("model", "document_id", "pers_entity_id", "loc_entity_id", F.col("p.at").alias("label"), F.col("p.conf_at").alias("conf"))


@query()
def f40_parse(spark: SparkSession, d: str) -> DataFrame:
    """All outputs read in all three tiers."""
    return predictions(spark, d).select("model", "document_id", "pers_entity_id", "loc_entity_id", P.combined(F.col("raw_output")).alias("p")).select("model", "document_id", "pers_entity_id", "loc_entity_id", "p.*")


@query(f"WITH {PRED} SELECT model, document_id, pers_entity_id, loc_entity_id, json_extract_string(regexp_extract(raw_output, '```(?:json)?\\s*([^`]*?)\\s*```', 1), '$.at') AS label FROM pred WHERE regexp_matches(raw_output, '```(?:json)?\\s*[^`]*```')")
def f46_fenced_json(spark: SparkSession, d: str) -> DataFrame:
    t = predictions(spark, d).where(F.col("raw_output").rlike("```(?:json)?\\s*[^`]*```"))
    return t.select("model", "document_id", "pers_entity_id", "loc_entity_id", F.get_json_object(P.json_object("raw_output"), "$.at").alias("label"))


@query()
def e27_reparse(spark: SparkSession, d: str) -> DataFrame:
    """Logs read again with the present parser; what it can't read keeps its old label."""
    t = predictions(spark, d).withColumn("p", P.combined(F.col("raw_output")))
    return t.select("model", "document_id", "pers_entity_id", "loc_entity_id", F.coalesce("p.at", "at_predicted").alias("at_predicted"), F.coalesce("p.isAt", "isAt_predicted").alias("isat_predicted"))


BAD = {"coherence": "\"isAt_predicted\" = 'TRUE' AND at_predicted = 'FALSE'", "conf_at": "ca < 0.7", "conf_isat": "ci < 0.6"}


@query(f"""WITH {PRED}, c AS (SELECT *, try_cast(regexp_extract(raw_output, 'conf_at=([0-9.]+)', 1) AS DOUBLE) AS ca, try_cast(regexp_extract(raw_output, 'conf_isAt=([0-9.]+)', 1) AS DOUBLE) AS ci FROM pred),
v AS (SELECT *, coalesce({BAD['coherence']}, false) AS h, (CASE WHEN coalesce({BAD['conf_at']}, false) THEN 1 ELSE 0 END + CASE WHEN coalesce({BAD['conf_isat']}, false) THEN 1 ELSE 0 END) AS s FROM c)
SELECT model, document_id, pers_entity_id, loc_entity_id, CAST(CASE WHEN h THEN 1 ELSE 0 END AS INTEGER) AS n_hard, CAST(s AS INTEGER) AS n_soft, h OR s >= 2 AS escalate FROM v""")
def v01_checks(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None)
    conf = lambda n: F.regexp_extract("raw_output", rf"conf_{n}=([0-9.]+)", 1).try_cast("double")
    c = R.checks(F.col("at_predicted"), F.col("isAt_predicted"), conf("at"), conf("isAt"), none.cast("string"), none.cast("string"), none.cast("array<string>"), none.cast("boolean"), none.cast("string"))
    return predictions(spark, d).withColumn("c", c).select("model", "document_id", "pers_entity_id", "loc_entity_id", F.size("c.hard").alias("n_hard"), F.size("c.soft").alias("n_soft"), F.col("c.escalate").alias("escalate"))


@query("SELECT vec_id, CASE WHEN s >= 0.3 THEN 'TRUE' WHEN s >= 0.1 THEN 'PROBABLE' ELSE 'FALSE' END AS label, CASE WHEN s2 >= 0.3 THEN 'TRUE' ELSE 'FALSE' END AS isat_label FROM (SELECT vec_id, abs(embedding[1])::DOUBLE AS s, abs(embedding[2])::DOUBLE AS s2 FROM embeddings)")
def f22_score_thresholds(spark: SparkSession, d: str) -> DataFrame:
    a, b = R.classify_by_score(F.abs(F.col("embedding")[0]).cast("double"), F.abs(F.col("embedding")[1]).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", a.alias("label"), b.alias("isat_label"))


# ---- mining


PATTERNS = [{"l_quantity": (10.0, 30.0)}, {"l_quantity": (5.0, 45.0), "l_discount": (0.02, 0.08)}, {"l_tax": (0.0, 0.04), "l_extendedprice": (1000.0, 40000.0)}]


@query("WITH t AS (SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS np FROM lineitem), e AS (" + " UNION ALL ".join(f"SELECT {i} AS pattern_id, count(*) FILTER ({c}) AS support, count(*) FILTER ({c} AND l_returnflag = 'R') AS support_pos FROM lineitem" for i, c in enumerate(" AND ".join(f"{k} BETWEEN {lo} AND {hi}" for k, (lo, hi) in p.items()) for p in PATTERNS)) + """)
SELECT pattern_id, support, support_pos, round(support_pos / support, 6) AS "precision", round(support_pos / np, 6) AS recall, round((support / n) * (support_pos / support - np / n) / (np / n * (1 - np / n)), 6) AS nwracc FROM e, t""")
def g08_patterns(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.mining import evaluate

    return evaluate(table(spark, d, "lineitem"), PATTERNS, F.col("l_returnflag") == "R")


@query("""WITH t AS (SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND l_returnflag = 'R') SELECT 'l_quantity' AS feature, min(l_quantity) AS lo, max(l_quantity) AS hi FROM t UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount) FROM t UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM t""")
def g02_close_on_positive(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.mining import close_on_positive

    return close_on_positive(table(spark, d, "lineitem"), PATTERNS[0], ["l_quantity", "l_discount", "l_extendedprice"], F.col("l_returnflag") == "R")


@query("""WITH b(pattern_id, feature, lo, hi) AS (VALUES (0, 'l_quantity', -1.0::DOUBLE, 1000.0::DOUBLE), (0, 'l_discount', 0.02, 0.05), (1, 'l_tax', -5.0, 5.0), (1, 'l_quantity', 10.0, 20.0)), g AS (SELECT 'l_quantity' AS feature, min(l_quantity) AS a, max(l_quantity) AS z FROM lineitem UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax) FROM lineitem)
SELECT b.pattern_id, b.feature, b.lo, b.hi FROM b JOIN g USING (feature) WHERE NOT (lo <= a + 1e-6 AND hi >= z - 1e-6)""")
def filter_trim_vacuous(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.mining import vacuous

    b = spark.createDataFrame([(0, "l_quantity", -1.0, 1000.0), (0, "l_discount", 0.02, 0.05), (1, "l_tax", -5.0, 5.0), (1, "l_quantity", 10.0, 20.0)], "pattern_id int, feature string, lo double, hi double")
    return vacuous(b, table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN {' AND '.join(f'{k} BETWEEN {lo} AND {hi}' for k, (lo, hi) in p.items())} THEN 1.0 ELSE 0.0 END::DOUBLE AS sd_{i}" for i, p in enumerate(PATTERNS)) + " FROM lineitem")
def f61_subgroup_flags(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.mining import with_flags

    return with_flags(table(spark, d, "lineitem"), PATTERNS).select("l_orderkey", "l_linenumber", *[f"sd_{i}" for i in range(len(PATTERNS))])


@query()
def g05_discover(spark: SparkSession, d: str) -> DataFrame:
    """Annealed chains over lineitem; the boxes found are closed and evaluated on all rows."""
    from ..operators.mining import discover

    t = table(spark, d, "lineitem").withColumn("y", F.col("l_returnflag") == "R")
    return discover(t, ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], "y")


# ---- retrieval


@query("""WITH q AS (SELECT vec_id AS q_id, embedding AS qv, vec_id % 3 AS lang FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q_id, vec_id, label, vec_id % 3 AS lang2, q.lang, list_sum(list_transform(list_zip(qv, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(qv, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS score FROM q, embeddings),
f AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s), k AS (SELECT * FROM f WHERE rank <= 20 AND vec_id <> q_id)
SELECT q_id, vec_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY lang2 <> lang, rank) AS place FROM k) WHERE place <= 5""")
def r03_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Exact inner-product top-k in blocks, over-fetched before exclusion, same language first. Queries are every id divisible by 50."""
    from ..operators.retrieval import fetched, selected

    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label", (F.col("vec_id") % 3).alias("language"))
    hits = fetched(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 20)
    return selected(hits, e, "vec_id", "language", None, 5).select("q_id", "vec_id", F.round("score", 6).alias("score"), "place")


@query("""WITH q AS (SELECT vec_id AS q_id, embedding AS qv, vec_id % 3 AS lang FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q_id, vec_id, label, vec_id % 3 AS lang2, q.lang, list_sum(list_transform(list_zip(qv, embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(qv, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS score FROM q, embeddings),
f AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s), k AS (SELECT * FROM f WHERE rank <= 20 AND vec_id <> q_id), b AS (SELECT *, row_number() OVER (PARTITION BY q_id, lang2 <> lang, label ORDER BY rank) AS nth FROM k)
SELECT q_id, vec_id, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY lang2 <> lang, CASE WHEN lang2 = lang AND nth = 1 THEN 0 ELSE 1 END, rank) AS place FROM b) WHERE place <= 5""")
def r04_retrieve_diverse(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.retrieval import fetched, selected

    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label", (F.col("vec_id") % 3).alias("language"))
    hits = fetched(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 20)
    return selected(hits, e, "vec_id", "language", "label", 5).select("q_id", "vec_id", F.round("score", 6).alias("score"), "place")


@query("SELECT sample_id, document_id, language, pers_mentions_list[1] AS pers_mention, loc_mentions_list[1] AS loc_mention, context, \"at\" AS label FROM relation_instance")
def r06_metadata(spark: SparkSession, d: str) -> DataFrame:
    first = lambda c: F.get(F.col(c), F.lit(0))
    return table(spark, d, "relation_instance").select("sample_id", "document_id", "language", first("pers_mentions_list").alias("pers_mention"), first("loc_mentions_list").alias("loc_mention"), "context", F.col("at").alias("label"))


@query("SELECT m.vec_id, m.sample_id FROM mask_batch m WHERE m.mask_emb IS NOT NULL AND EXISTS (SELECT 1 FROM split_ids s WHERE s.sample_id = m.sample_id AND lower(trim(s.split)) = 'train')")
def r07_train_index(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of the train split only."""
    train = table(spark, d, "split_ids").where(F.lower(F.trim("split")) == "train").select("sample_id").distinct()
    return table(spark, d, "mask_batch").where("mask_emb is not null").join(train, "sample_id", "left_semi").select("vec_id", "sample_id")
