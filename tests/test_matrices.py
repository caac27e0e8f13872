"""Feature matrices, messages, gates, stability and experiments on hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from quirewell.functions import prompts as M
from quirewell.operators import matrices as B, mining, ml, predictors
from quirewell.sources import files


def test_question_block(spark):
    class Fixed:
        def ask(self, question, context):
            if "Failing" in question:
                raise OSError("model")
            return (0.9 if question.startswith("Was") else 0.05, "Bern", context.index("Bern"))

    ddl = "k string, person string, place string, language string, context string, text string, location_is_dateline double"
    rows = [("a", "Jo", "Bern", "en", "x in Bern", "Bern. 3 May. x in Bern", 1.0), ("b", None, "Bern", "en", "x", "x", 0.0), ("c", "Failing", "Bern", None, "in Bern", "in Bern", 1.0), ("d", "Jo", "Bern", "en", "", "", 0.0)]
    got = {r.k: r for r in B.question_block(spark.createDataFrame(rows, ddl), "person", "place", "language", "context", "text", "location_is_dateline", Fixed()).collect()}
    a = got["a"]
    assert (a.qa_at_score, a.qa_at_has_answer, a.qa_isAt_has_answer, a.qa_at_span_position, a.qa_evidence_is_dateline) == (0.9, 1.0, 0.0, 5 / 9, 1.0)
    assert a.qa_at_isAt_score_gap == pytest.approx(0.85) and a.qa_max_score == 0.9
    assert all(got[k][n] == 0 for k in "bd" for n in B.QA_NAMES)
    assert got["c"].qa_at_span_position == 0.5 and got["c"].qa_at_score == 0


def test_padding_and_configurations(spark):
    cache = spark.createDataFrame([("a", *[0.5] * 14)], "k string, " + ", ".join(f"{n} double" for n in B.QA_NAMES[:-1]))
    full = B.padded_block(cache, "k")
    assert full.columns == ["k", *B.QA_NAMES] and full.first()[B.QA_NAMES[-1]] == 0.0
    assert B.padded_block(full, "k").columns == full.columns
    for bad in (cache.drop(B.QA_NAMES[0]), cache.withColumn("other", F.lit(1))):
        with pytest.raises(ValueError):
            B.padded_block(bad, "k")
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double")
    wide = B.configured(base, "k", {"qa": lambda: full}, "SD-HQ")
    assert wide.count() == 2 and len(wide.columns) == 17
    for name in ("SD-X", "SD-HS"):
        with pytest.raises(ValueError):
            B.configured(base, "k", {}, name)


def test_principal_components_are_centred(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(10)], "k long, v array<double>")
    got = B.projected(df, "k", "v", 1).collect()
    assert abs(sum(r.MASK_PC1 for r in got)) < 1e-9 and len({round(r.MASK_PC1, 6) for r in got}) == 10


def test_messages(spark):
    c = lambda v, t="string": F.lit(v).cast(t)
    row = spark.range(1).select(
        M.justification(c("Jo"), c(None), c("TRUE"), c(None), c(0.756, "double"), c(None, "double"), c(""), c("1843"), c("en"), c("text"), M.facts(label=c("x"), born=c(None), died=c("1850")), M.facts(), c("P937")).alias("j"),
        M.escalation(c("TRUE"), c("FALSE"), c(None), c(0.5, "double"), c("why"), F.lit(True), c("weak"), F.array(c("f1"), c("f2")), c("story"), c("")).alias("e"),
        M.escalation(c(None), c(None), c(None), c(None), c(None), F.lit(False), c("weak"), F.array(c("f1")), c("story"), c("reason")).alias("f"),
    ).first()
    assert row.j.split("\n")[:5] == ["[CLASSIFIED RELATION]", "Person: 'Jo'  Location: ''", "at = TRUE (confidence: 0.76)", "isAt = None (confidence: n/a)", "Classifier reasoning: (none provided)"]
    assert "Person: label=x; died=1850\nLocation: (none)\nKnown links: P937\n\nProduce" in row.j
    assert row.e.split("\n")[1:9] == ["at=TRUE, isAt=FALSE", "conf_at=None, conf_isAt=0.5", "reasoning: why", "", "[JUSTIFICATION AGENT FINDINGS]", "evidence_strength: weak", "flags: ['f1', 'f2']", "narrative: story"]
    assert row.f.split("\n")[1:5] == ["at=None, isAt=None", "", "[VALIDATOR FLAGS]", "reason"] and "FINDINGS" not in row.f


def test_overrides_append_to_a_history(spark):
    ddl = "k string, label string, history array<struct<from:string,to:string,run:string>>"
    df = spark.createDataFrame([("a", "FALSE", [("TRUE", "FALSE", "one")]), ("b", "FALSE", None), ("c", "PROBABLE", None), ("d", "TRUE", None)], ddl)
    got = {r.k: (r.label, [tuple(h) for h in r.history]) for r in mining.overridden(df, "label", "history", F.col("k") != "d", "PROBABLE", run="two").collect()}
    assert got == {"a": ("PROBABLE", [("TRUE", "FALSE", "one"), ("FALSE", "PROBABLE", "two")]), "b": ("PROBABLE", [("FALSE", "PROBABLE", "two")]), "c": ("PROBABLE", []), "d": ("TRUE", [])}


def test_a_planted_subgroup_is_stable(spark):
    rnd = random.Random(1)
    rows = [(str(i), x, rnd.random(), rnd.random() < (0.9 if 0.4 < x < 0.6 else 0.05)) for i, x in ((i, rnd.random()) for i in range(600))]
    df = spark.createDataFrame(rows, "k string, x double, z double, y boolean")
    strings, clusters = mining.fold_stability(df, ["x", "z"], "y", "k", folds=3, least_precision=0.4, least_folds=3, alike=0.4, chains=4, steps=150)
    best = clusters.first()
    assert best.folds_stable == 3 and best.precision >= 0.4 and strings.columns == ["pattern", "folds_stable", "folds_seen", "precision", "recall"]
    p = [{"x": (0.4, 0.6)}, {"x": (0.4, 0.5)}, {"x": (2.0, 3.0)}]
    near = mining.overlaps(df, p)
    a, b = sum(0.4 <= r[1] <= 0.6 for r in rows), sum(0.4 <= r[1] <= 0.5 for r in rows)
    assert near[0, 1] == pytest.approx(b / a) and near[0, 2] == 0 and near[2, 2] == 1


def test_grid_and_experiment(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(str(i), x, rnd.random(), "TRUE" if x > 0.5 else "FALSE") for i, x in ((i, rnd.random()) for i in range(200))], "k string, x double, z double, label string")
    got = {r.feature_set: r.macro_recall for r in ml.grid(df, "k", "label", {"good": ["x"], "bad": ["z"]}, {"logistic": ml.logistic}, ("TRUE", "FALSE"), folds=2).collect()}
    assert got["good"] > 0.9 > 0.7 > got["bad"]
    run = lambda t: t.select("k", F.col("label").alias("at"), F.col("label").alias("at_predicted"), F.lit(2.0).alias("latency_ms"))
    done, report = predictors.experiment(df, "e1", run, {"at": "at"})
    r = report.first()
    assert done.count() == 200 and (r.experiment, r.target, r.latency_ms) == ("e1", "at", 2.0) and r.macro_recall == 1.0


def test_submission_folders(spark, tmp_path):
    docs = spark.createDataFrame([("d1", None), ("d2", None)], "document_id string, note string")
    files.write_jsonl(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    for name in ("team_run1.jsonl", "team_predictions.jsonl", "notes.txt"):
        (tmp_path / name).write_text('{"document_id": "d1"}\n')
    got = files.read_submissions(spark, str(tmp_path)).select("document_id", "run").collect()
    assert [tuple(r) for r in got] == [("d1", "team_run1")]
