"""Feature matrices, messages, fold stability, trained models on held-out rows, and their SQL where SQL can say the same.

The tables hold no person states and no signal categories, so the matrices take
stand-ins for them: states from the person dimension of ``texts.persons``,
categories from the time expressions at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lexicons as X, prompts as M, text as T
from ..operators import matrices as B, metrics, mining, ml, predictors
from ..operators.labels import AT, null_to_false
from ..session import kept, table
from .common import PRED, predictions
from .scoring import SPLIT_SQL, document_split
from .texts import PERSON, features, persons, with_text

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """Instances with article text, person's state and signal category (stand-ins, see above)."""
    year = F.substring("date", 1, 4).try_cast("int")
    t = with_text(spark, d).join(persons(spark, d).withColumnRenamed("qid", "pers_wikidata_QID"), "pers_wikidata_QID", "left")
    category = F.when(F.col("has_timex_in_isat_window"), "present").when(F.col("nearest_timex_distance").isNotNull(), "relative_only").otherwise("no_signal")
    signals = F.array_distinct(F.filter(F.transform("temporal_expressions", lambda e: e["surface"]), lambda s: s.isNotNull()))
    return t.withColumns({"category": category, "status": T.person_status(F.col("birth"), F.col("death"), year), "signals": signals})


def handcrafted(t: DataFrame) -> dict:
    names = ("sentence_position", "category", "nearest_timex_distance", "status", "ocr_quality", "language", "pers_wikidata_QID", "loc_wikidata_QID", "pers_mentions_list", "loc_mentions_list", "temporal_expressions", "signals", "text", "context")
    return B.handcrafted(*[F.col(c) for c in names])


_ONE = lambda c, name: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END::DOUBLE AS {name}"
F13 = ", ".join(
    [f"0.0::DOUBLE AS verb_is_{x}" for x in ("present", "past", "negated", "future")]
    + ["round(CASE WHEN coalesce(sentence_position, -1) >= 0 THEN least(1.0, sentence_position / 50.0) ELSE 0.0 END, 6)::DOUBLE AS sentence_position_norm", _ONE("coalesce(sentence_position, -1) BETWEEN 0 AND 1", "is_lead_paragraph"), "0.0::DOUBLE AS signal_negation"]
    + [_ONE(f"category = '{c}'", f"signal_{n}") for c, n in (("present", "present"), ("relative_only", "relative"), ("no_signal", "none"))]
    + [_ONE("abs(nearest_timex_distance) <= 30", "has_timex_in_window"), "round(coalesce(least(1.0, abs(nearest_timex_distance) / 365.0), 0.0), 6)::DOUBLE AS nearest_timex_distance_norm", _ONE("status = 'dead_historical'", "person_is_deceased"), _ONE("status NOT IN ('unknown', 'no_match')", "person_status_known"), "round(coalesce(ocr_quality, 1.0), 6)::DOUBLE AS ocr_quality"]
    + [_ONE(f"language = '{x}'", f"lang_{x}") for x in X.LANGUAGES] + [_ONE(f"status = '{x}'", f"person_status_{x}") for x in X.STATUSES]
    + [_ONE("coalesce(pers_wikidata_QID, '') <> ''", "has_pers_qid"), _ONE("coalesce(loc_wikidata_QID, '') <> ''", "has_loc_qid")]
    + [f"coalesce(len({c}), 0)::DOUBLE AS {n}" for c, n in (("pers_mentions_list", "n_pers_mentions"), ("loc_mentions_list", "n_loc_mentions"), ("temporal_expressions", "n_temporal_expressions"), ("list_distinct(list_transform(temporal_expressions, lambda e: e.surface))", "n_temporal_signals"))]
    + ["0.0::DOUBLE AS n_tense_aspect_clusters", "round(least(1.0, length(coalesce(text, '')) / 12000.0), 6)::DOUBLE AS text_len_chars_norm", "round(least(1.0, length(coalesce(context, '')) / 2000.0), 6)::DOUBLE AS context_len_chars_norm"]
)
ENRICHED = f"""{PERSON}, txt AS (SELECT document_id, max(text) AS text FROM articles GROUP BY document_id), one AS (SELECT DISTINCT ON (sample_id) * FROM relation_instance),
enr AS (SELECT one.*, text, CASE WHEN has_timex_in_isat_window THEN 'present' WHEN nearest_timex_distance IS NOT NULL THEN 'relative_only' ELSE 'no_signal' END AS category, CASE WHEN y IS NULL THEN 'unknown' WHEN birth IS NULL OR birth > y THEN 'no_match' WHEN death IS NOT NULL AND death < y THEN 'dead_historical' WHEN y < 1980 THEN 'alive_past' ELSE 'alive_now' END AS status
FROM (SELECT *, try_cast(substr(date, 1, 4) AS INTEGER) AS y FROM one) one LEFT JOIN person ON person.qid = one.pers_wikidata_QID LEFT JOIN txt USING (document_id))"""


@query(f"WITH {ENRICHED} SELECT sample_id, {F13} FROM enr")
def f13_handcrafted(spark: SparkSession, d: str) -> DataFrame:
    """The 36 handcrafted columns of every instance."""
    t = enriched(spark, d)
    return features(t, ["sample_id"], handcrafted(t))


def subgroup_base(spark: SparkSession, d: str) -> DataFrame:
    """sample_id and the 47 columns that every configuration has: time, evidence, verbs, hierarchy, datelines, language."""
    r = table(spark, d, "relation_instance")
    forms = r.where("loc_wikidata_QID is not null").select("loc_wikidata_QID", F.explode("loc_mentions_list").alias("child")).where("child <> ''").distinct()
    children = forms.groupBy("loc_wikidata_QID").agg(F.sort_array(F.collect_list("child")).alias("children"))  # the forms of one place
    t = enriched(spark, d).join(children.hint("merge"), "loc_wikidata_QID", "left")
    c, x, p, q = F.coalesce("context", F.lit("")), F.coalesce("text", F.lit("")), F.col("pers"), F.col("locs")
    t = T.datelines(t.withColumns({"text": x, "more": T.expanded(c, p, F.lower(F.coalesce("language", F.lit("en"))))}), "text", "locs")
    time = {n: v for i, (n, v) in enumerate(handcrafted(t).items()) if i < 15}
    cols = time | B.evidence(c, F.col("text"), p, q, F.col("more")) | T.verb_types(c, F.col("language")) | B.hierarchy(F.col("text"), q, F.col("children"), F.array().cast("array<string>"))
    cols |= {n: F.col(n) for n in t.columns if n.startswith("location_")} | T.one_hot(F.col("language"), X.LANGUAGES, "lang_")
    return features(t, ["sample_id"], cols)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """sample_id and the vector of each sample that has a usable one (the first by id)."""
    v = table(spark, d, "mask_batch").where(F.col("sample_id").isNotNull() & (F.size("mask_emb") == 64) & ~F.exists("mask_emb", lambda x: x.isNull() | F.isnan(x)))
    return v.groupBy("sample_id").agg(F.min_by("mask_emb", "vec_id").alias("v"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    t = T.datelines(with_text(spark, d).fillna({"text": ""}), "text", "locs").withColumns({"person": F.get("pers", F.lit(0)), "place": F.get("locs", F.lit(0))})
    return B.question_block(t, "person", "place", "language", "context", "text", "location_is_dateline", B.NearestSentence()).select("sample_id", *[F.round(n, 6).alias(n) for n in B.QA_NAMES])


@query()
def f20_question_block(spark: SparkSession, d: str) -> DataFrame:
    """The 15 question-answering columns, by the stand-in answerer."""
    return answers(spark, d)


@query()
def f24_subgroup_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of the configuration with all in-house blocks: 47 columns, 10 spectral and 10 principal components."""
    v = vectors(spark, d)
    blocks = {"spectral": lambda: B.spectral(v, "sample_id", "v", 10, most=1_000), "pca": lambda: B.projected(v, "sample_id", "v", 10)}
    return B.configured(subgroup_base(spark, d), "sample_id", blocks, "SD-HSP")


_BLOCKS = [
    ("temporal", 15), ("evidence", 13), ("verbs", 7), ("hierarchy", 3), ("datelines", 5), ("language", 4),
]
_WIDTHS = {"SD-H": 47, "SD-HS": 57, "SD-HSP": 67, "SD-HQ": 62, "SD-HQS": 72}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in _WIDTHS.items()) + ") AS t(configuration, n_columns)")
def f24_widths(spark: SparkSession, d: str) -> DataFrame:
    """How many columns each configuration has, counted on the matrices themselves (their blocks planned, not computed)."""
    base = subgroup_base(spark, d)
    empty = lambda names: (lambda: base.select("sample_id", *[F.lit(0.0).alias(n) for n in names]))
    blocks = {"spectral": empty([f"spectral_EV{i + 2}" for i in range(10)]), "pca": empty([f"MASK_PC{i + 1}" for i in range(10)]), "qa": lambda: answers(spark, d)}
    return spark.createDataFrame([(k, len(B.configured(base, "sample_id", blocks, k).columns) - 1) for k in B.CONFIGURATIONS], "configuration string, n_columns int")


@query("SELECT DISTINCT sample_id, " + ", ".join(f"round(coalesce(ocr_quality, 0.0) * {i + 1} / 14, 6)::DOUBLE AS {n}" for i, n in enumerate(B.QA_NAMES[:-1])) + f", 0.0::DOUBLE AS {B.QA_NAMES[-1]} FROM relation_instance")
def f25_padded_block(spark: SparkSession, d: str) -> DataFrame:
    """A cache of 14 columns (here multiples of a quality) with its 15th."""
    cache = table(spark, d, "relation_instance").select("sample_id", *[(F.round(F.coalesce("ocr_quality", F.lit(0.0)) * (i + 1) / 14, 6)).alias(n) for i, n in enumerate(B.QA_NAMES[:-1])]).distinct()
    return B.padded_block(cache, "sample_id")


_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
_NL = " || chr(10) || "


@query(f"""WITH {PRED}, one AS (SELECT DISTINCT ON (document_id, pers_entity_id, loc_entity_id) * FROM relation_instance ORDER BY document_id, pers_entity_id, loc_entity_id, sample_id)
SELECT sample_id, {_NL.join([_QUOTED(X.JUSTIFY_HEADS["relation"]), "'Person: ''' || coalesce(pers_mentions_list[1], '') || '''  Location: ''' || coalesce(loc_mentions_list[1], '') || ''''", "'at = ' || coalesce(at_predicted, 'None') || ' (confidence: n/a)'", "'isAt = ' || coalesce(\"isAt_predicted\", 'None') || ' (confidence: n/a)'", "'Classifier reasoning: (none provided)'", "''", "'Publication date: ' || coalesce(date, 'None')", "'Language: ' || coalesce(one.language, 'None')", "''", _QUOTED(X.JUSTIFY_HEADS["text"]), "'\"' || coalesce(context, '') || '\"'", "''", _QUOTED(X.JUSTIFY_HEADS["knowledge"]), "'Person: ' || coalesce('label=' || pers_wikidata_QID, '(none)')", "'Location: ' || coalesce('label=' || loc_wikidata_QID, '(none)')", "''", _QUOTED(X.JUSTIFY_TASK)])} AS message FROM one JOIN pred USING (document_id, pers_entity_id, loc_entity_id) WHERE model = 'llm-small-ctx'""")
def f35_justification_message(spark: SparkSession, d: str) -> DataFrame:
    """The message that asks for a justification of a model's answer, over the context as it is."""
    keys = ["document_id", "pers_entity_id", "loc_entity_id"]
    one = table(spark, d, "relation_instance").groupBy(*keys).agg(F.min_by(F.struct("sample_id", "pers_mentions_list", "loc_mentions_list", "date", "language", "context", "pers_wikidata_QID", "loc_wikidata_QID"), "sample_id").alias("r"))
    t = predictions(spark, d).where("model = 'llm-small-ctx'").select(*keys, "at_predicted", "isAt_predicted").join(one, keys)
    none, first = F.lit(None), lambda c: F.get(F.col(f"r.{c}"), F.lit(0))
    message = M.justification(first("pers_mentions_list"), first("loc_mentions_list"), F.col("at_predicted"), F.col("isAt_predicted"), none, none, none, F.col("r.date"), F.col("r.language"), F.col("r.context"), M.facts(label=F.col("r.pers_wikidata_QID")), M.facts(label=F.col("r.loc_wikidata_QID")), none)
    return t.select("r.sample_id", message.alias("message"))


@query(f"""WITH {PRED} SELECT model, document_id, pers_entity_id, loc_entity_id, {_NL.join([_QUOTED(X.ESCALATE_HEADS["first"]), "'at=' || coalesce(at_predicted, 'None') || ', isAt=' || coalesce(\"isAt_predicted\", 'None')"])} || CASE WHEN flipped THEN chr(10) || chr(10) || {_QUOTED(X.ESCALATE_HEADS["findings"])} || chr(10) || 'evidence_strength: weak' || chr(10) || 'flags: [''a'', ''b'']' ELSE '' END || CASE WHEN at_predicted IS NULL THEN chr(10) || chr(10) || {_QUOTED(X.ESCALATE_HEADS["flags"])} || chr(10) || 'no label' ELSE '' END || chr(10) || chr(10) || {_QUOTED(X.ESCALATE_TASK)} AS addendum FROM pred""")
def f36_escalation_addendum(spark: SparkSession, d: str) -> DataFrame:
    """What a stronger model is told of a first answer; the findings here are constants, where the answer was flipped."""
    p, none = predictions(spark, d), F.lit(None).cast("string")
    told = M.escalation(F.col("at_predicted"), F.col("isAt_predicted"), none, none, none, F.coalesce("flipped", F.lit(False)), F.lit("weak"), F.array(F.lit("a"), F.lit("b")), none, F.when(F.col("at_predicted").isNull(), "no label"))
    return p.select("model", "document_id", "pers_entity_id", "loc_entity_id", told.alias("addendum"))


# ---- subgroups


@query("""WITH t AS (SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS np FROM lineitem), e AS (SELECT 0 AS pattern_id, count(*) FILTER (l_quantity BETWEEN 10 AND 30) AS s, count(*) FILTER (l_quantity BETWEEN 10 AND 30 AND l_returnflag = 'R') AS p FROM lineitem UNION ALL SELECT 1, count(*) FILTER (l_tax BETWEEN 0 AND 0.04), count(*) FILTER (l_tax BETWEEN 0 AND 0.04 AND l_returnflag = 'R') FROM lineitem UNION ALL SELECT 2, 0, 0),
q AS (SELECT pattern_id, s AS support, round(CASE WHEN s = 0 THEN 0.0 ELSE p / s END, 6) AS "precision" FROM e, t) SELECT pattern_id, support, "precision" FROM q WHERE "precision" >= 0.2 AND support >= 1""")
def f_quality_gates(spark: SparkSession, d: str) -> DataFrame:
    """Patterns that pass a least precision and support; an empty one doesn't."""
    patterns = [{"l_quantity": (10.0, 30.0)}, {"l_tax": (0.0, 0.04)}, {"l_quantity": (-5.0, -1.0)}]
    return mining.gated(mining.evaluate(table(spark, d, "lineitem"), patterns, F.col("l_returnflag") == "R"), -1.0, 0.2).select("pattern_id", "support", "precision")


@query("""WITH r AS (SELECT sample_id, max("at") AS "at", max(ocr_quality) AS q FROM relation_instance GROUP BY sample_id), h AS (SELECT *, coalesce("at", 'FALSE') AS old, CASE WHEN q < 0.5 THEN [{'from': 'TRUE', 'to': 'FALSE', 'run': 'first'}] END AS before FROM r)
SELECT sample_id, CASE WHEN old <> 'PROBABLE' AND q >= 0.9 THEN 'PROBABLE' ELSE old END AS label, list_transform(list_concat(coalesce(before, []), CASE WHEN old <> 'PROBABLE' AND (q >= 0.9 OR q < 0.3) AND q >= 0.9 THEN [{'from': old, 'to': 'PROBABLE', 'run': 'second'}] ELSE [] END), lambda c: c['from'] || '>' || c['to'] || ' ' || c['run']) AS changes FROM h""")
def e24_override_history(spark: SparkSession, d: str) -> DataFrame:
    """Labels overridden where a pattern matches; changes are appended to those that are there already."""
    r = table(spark, d, "relation_instance").groupBy("sample_id").agg(F.max("at").alias("at"), F.max("ocr_quality").alias("q"))
    earlier = F.array(F.struct(F.lit("TRUE").alias("from"), F.lit("FALSE").alias("to"), F.lit("first").alias("run")))
    t = r.select("sample_id", "q", null_to_false(F.col("at")).alias("label"), F.when(F.col("q") < 0.5, earlier).alias("history"))
    t = mining.overridden(t, "label", "history", mining.matches({"q": (0.9, float("inf"))}), "PROBABLE", run="second")
    return t.select("sample_id", "label", F.transform("history", lambda c: F.concat(c["from"], F.lit(">"), c["to"], F.lit(" "), c["run"])).alias("changes"))


@query()
def g10_fold_stability(spark: SparkSession, d: str) -> DataFrame:
    """Subgroups of instances labelled TRUE that are found again in the folds, by description and by extent."""
    t = model_rows(spark, d).withColumn("y", F.col("label") == "TRUE")
    strings, clusters = mining.fold_stability(t, ["sentence_position_norm", "nearest_timex_distance_norm", "ocr_quality", "n_pers_mentions", "context_len_chars_norm"], "y", "sample_id", least_precision=0.1)
    return strings.select(F.lit("description").alias("kind"), "pattern", "folds_stable", "precision").unionByName(clusters.select(F.lit("extent").alias("kind"), F.col("representative").alias("pattern"), "folds_stable", "precision"))


# ---- models on held-out rows


MODEL_FEATURES = [
    "sentence_position_norm", "is_lead_paragraph", "signal_present", "signal_relative", "signal_none", "has_timex_in_window", "nearest_timex_distance_norm", "person_status_known", "ocr_quality",
    "lang_en", "lang_fr", "lang_de", "has_pers_qid", "has_loc_qid", "n_pers_mentions", "n_loc_mentions", "n_temporal_expressions", "text_len_chars_norm", "context_len_chars_norm",
]


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, split, label and the handcrafted columns of every labelled instance: samples of test are never trained on."""
    t = enriched(spark, d).where("at is not null").join(document_split(spark, d), "document_id", "left")
    return kept(features(t, ["sample_id", F.when(F.col("split") == "test", "test").otherwise("train").alias("split"), F.col("at").alias("label")], handcrafted(t)))


def held_out(t: DataFrame, pipeline, weighted: bool = True) -> DataFrame:
    """label, n, recall of a model trained on train, over the rows of test."""
    train = t.where("split = 'train'")
    p = ml.predicted(pipeline.fit(ml.weighted(train, "label") if weighted else train), t.where("split = 'test'"), "label")
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("predicted")).cast("int")), 4).alias("recall"))


@query()
def m08_logistic(spark: SparkSession, d: str) -> DataFrame:
    """Held-out recall by class of the balanced logistic regression on standardised features."""
    return held_out(model_rows(spark, d), ml.logistic(MODEL_FEATURES, "label"))


@query()
def m09_forest(spark: SparkSession, d: str) -> DataFrame:
    """Held-out recall by class of a forest of 300 trees."""
    return held_out(model_rows(spark, d), ml.forest(MODEL_FEATURES, "label"))


@query()
def m10_perceptron(spark: SparkSession, d: str) -> DataFrame:
    """Held-out recall by class of the perceptron with layers of 128 and 64."""
    return held_out(model_rows(spark, d), ml.perceptron(MODEL_FEATURES, "label", classes=3), weighted=False)


@query()
def m11_projected_logistic(spark: SparkSession, d: str) -> DataFrame:
    """Held-out recall by class of the logistic regression on ten principal components."""
    return held_out(model_rows(spark, d), ml.logistic(MODEL_FEATURES, "label", pca=10))


@query()
def m16_grid(spark: SparkSession, d: str) -> DataFrame:
    """Macro recall out of fold of models over named sets of features."""
    sets = {"time": MODEL_FEATURES[:9], "counts": MODEL_FEATURES[12:], "all": MODEL_FEATURES}
    makes = {"logistic": ml.logistic, "forest": lambda f, label: ml.forest(f, label, trees=50)}
    return ml.grid(model_rows(spark, d), "sample_id", "label", sets, makes, AT, folds=3)


@query()
def m17_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    """A prediction for every labelled instance by a model that hasn't seen its fold."""
    return ml.out_of_fold(model_rows(spark, d), "sample_id", "label", lambda: ml.logistic(MODEL_FEATURES, "label"), folds=5).select("sample_id", "fold", "label", "predicted")


@query()
def m19_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Macro recall per target and mean latency of a run of the stand-in client over every instance."""
    from ..functions import parse as P

    def predict(t: DataFrame) -> DataFrame:
        answered = predictors.answered(t.withColumn("prompt", F.concat_ws(" ", "sample_id", "context")), "prompt", predictors.HashClient()).withColumn("p", P.combined(F.col("raw_output")))
        return answered.select("sample_id", "at", "isAt", "latency_ms", F.col("p.at").alias("at_predicted"), F.col("p.isAt").alias("isAt_predicted"))

    t = table(spark, d, "relation_instance").dropDuplicates(["sample_id"]).select("sample_id", "context", "at", "isAt")
    return predictors.experiment(t, "stand-in", predict, {"at": "at", "isAt": "isAt"})[1]
