"""Files in and out, and the stream that equals its batch."""

import json
import os

from pyspark.sql import functions as F

from quirewell.sources import files, submission
from quirewell.streaming import enrich

DOCS = [
    {"document_id": "a", "language": "fr", "date": "1850", "text": "Jean est à Paris. Fin.", "sampled_pairs": [{"pers_entity_id": "p1", "loc_entity_id": "l1", "pers_mentions_list": ["Jean"], "loc_mentions_list": ["Paris"]}, {"pers_entity_id": "p2", "loc_entity_id": "l1"}], "unknown": 1},
    {"document_id": "b", "language": "en", "date": None, "text": "", "sampled_pairs": None},
]


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_nested_and_flat_scans(spark, tmp_path):
    p = write(tmp_path / "docs.jsonl", ["", *map(json.dumps, DOCS), "  "])
    docs = files.read_jsonl(spark, p, files.DOCUMENT_DDL)
    assert docs.count() == 2 and files.detect_format(spark, p) == "nested"
    pairs = files.unnest(docs).orderBy("pair_no").collect()
    assert [(r.document_id, r.pers_entity_id, r.context) for r in pairs] == [("a", "p1", DOCS[0]["text"]), ("a", "p2", DOCS[0]["text"])]
    flat = write(tmp_path / "flat.jsonl", [json.dumps({"document_id": "a", "at": "TRUE"})])
    assert files.detect_format(spark, flat) == "flat"


def test_config_scan_and_reports(spark, tmp_path):
    write(tmp_path / "one_predictions.jsonl", [json.dumps({"document_id": str(i), "at_predicted": "TRUE"}) for i in range(3)])
    write(tmp_path / "two_predictions.jsonl", [json.dumps({"document_id": "x"})])
    got = files.read_configs(spark, str(tmp_path), least_rows=2)
    assert {r.config for r in got.collect()} == {"one_predictions"}
    (tmp_path / "exp.json").write_text('{"global": 0.5, "name": "x"}')
    (tmp_path / "compare_a.json").write_text('{"global": 0.9}')
    assert [tuple(r) for r in files.read_reports(spark, str(tmp_path)).collect()] == [("exp", "global", 0.5)]


def test_confidences_and_splits(spark, tmp_path):
    c = write(tmp_path / "c.csv", ["document_id,pers_entity_id,loc_entity_id,pred_label,confidence,prob_TRUE,prob_FALSE", "d,p,l,TRUE,0.5,0.5,0.5", "e,p,l,FALSE,1.0,,"])
    assert [r.ambiguity for r in files.read_confidences(spark, c).orderBy("document_id").collect()] == [1.0, 0.0]
    s = write(tmp_path / "s.csv", ["sample_id,task,split", "x,at,Train ", "x,isAt,test"])
    assert [tuple(r) for r in files.read_splits(spark, s, "at").collect()] == [("x", "train")]


def test_hierarchy_and_validation(spark, tmp_path):
    h = write(tmp_path / "h.json", [json.dumps({"Q142": {"Q456": ["Lyon"], "_parents": ["Europe"]}})])
    children, parents = files.read_hierarchy(spark, h)
    assert [tuple(r) for r in children.collect()] == [("Q142", "Q456", "Lyon")] and [tuple(r) for r in parents.collect()] == [("Q142", "Europe")]
    bad = dict(DOCS[0], sampled_pairs=[{"pers_entity_id": "p", "loc_entity_id": "l", "at": "MAYBE"}])
    raw = spark.createDataFrame([(1, json.dumps(DOCS[0])), (2, "{broken"), (3, json.dumps(bad)), (4, json.dumps(DOCS[1]))], "line int, value string")
    assert {(r.line, r.problem) for r in files.validated(raw).collect()} == {(2, "not JSON"), (3, "unknown at"), (4, "sampled_pairs missing")}


def test_submission_round_trip(spark, tmp_path):
    p = write(tmp_path / "docs.jsonl", map(json.dumps, DOCS))
    docs = files.read_jsonl(spark, p, files.DOCUMENT_DDL).withColumn("loaded_at", F.lit(1))
    preds = spark.createDataFrame([("a", "p1", "l1", "FALSE", "TRUE")], "document_id string, pers_entity_id string, loc_entity_id string, at_predicted string, isAt_predicted string")
    submission.write_submission(docs, preds, str(tmp_path / "out"))
    back = files.read_jsonl(spark, str(tmp_path / "out"), files.DOCUMENT_DDL).collect()
    assert [(x["pers_entity_id"], x["at"], x["isAt"]) for x in back[0].sampled_pairs] == [("p1", "FALSE", "FALSE"), ("p2", "FALSE", "FALSE")]
    assert submission.stats(docs, preds).collect()[0].asDict() == {"documents": 1, "pairs": 2, "missing": 1, "fixed": 1, "at_true": 0, "isat_true": 0}


def test_names_and_packages(tmp_path):
    assert files.submission_filename("t", "/x/test_en.jsonl", 2) == "t_test_en_run2.jsonl"
    assert files.choose_by_language(["a_de.jsonl", "b_en.jsonl"], "test-en.jsonl") == "b_en.jsonl"
    write(tmp_path / "f.txt", ["x"])
    assert os.path.getsize(files.package(str(tmp_path / "z.zip"), [str(tmp_path / "f.txt")])) > 0


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "1.jsonl", map(json.dumps, DOCS))
    write(tmp_path / "in" / "2.jsonl", [json.dumps(dict(DOCS[0], document_id="c"))])
    enrich.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = enrich.enriched(files.read_jsonl(spark, str(tmp_path / "in"), files.DOCUMENT_DDL))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())
