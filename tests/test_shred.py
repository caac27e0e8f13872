"""Nested records into linked tables: shapes, positions, keys, odd input."""

import json

from quirewell.operators.shred import Naming, analyse, as_table, parse, plan_tables, shred, typed_tables
from quirewell.plans.nested import DELIVERY

DOC = {"document_id": "d", "sampled_pairs": [{"pers_mentions_list": ["a", None, {"surface": "b"}], "loc_mentions_list": "c"}, None, {"person": {"mentions": [""]}, "location": {"mentions": {"surface": "e"}}}]}
WANT = {("d", 0, "pers", 0, "a"), ("d", 0, "pers", 2, "b"), ("d", 0, "loc", 0, "c"), ("d", 2, "pers", 0, ""), ("d", 2, "loc", 0, "e")}


def mentions(spark, payloads):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "record_id long, payload string, position string")
    t = as_table(shred(df, "record_id", "payload", DELIVERY), "mention", ["value", "surface"], ["document_id"])
    out = {}
    for r in t.collect():
        pair = int(r.parent_id.rsplit("/pair", 1)[1].split("~")[0])
        out.setdefault(int(r.record_key), set()).add((r.parent_document_id, pair, r.role, r.position, r.value if r.value is not None else r.surface))
    return out


def test_all_shapes_give_the_same_rows(spark):
    text = dict(DOC, sampled_pairs=json.dumps(DOC["sampled_pairs"]))
    camel = {"document_id": "d", "sampledPairs": DOC["sampled_pairs"]}
    got = mentions(spark, [json.dumps(x) for x in (DOC, [DOC], {"document": DOC}, {"batch": {"id": 1, "documents": [DOC]}}, text, camel, {"meta": {"run": {"deep": 1}}, "document": [[DOC]]})])
    assert got == {i: WANT for i in range(7)}


def test_odd_payloads_give_no_rows(spark):
    whole = json.dumps(DOC)
    assert mentions(spark, [None, "", "  ", "null", whole[:-3], whole + "}", '{"a": NaN}', "[]", "{}", '{"document_id": "d", "sampled_pairs": []}', '{"document_id": "d", "sampled_pairs": [null]}']) == {}


def test_lone_pair_and_repeats(spark):
    lone = {"document_id": "d", "sampled_pairs": DOC["sampled_pairs"][0]}
    got = mentions(spark, [json.dumps(lone), json.dumps(lone)])
    assert got[0] == got[1] == {x for x in WANT if x[1] == 0}


def test_parents_exist_and_keys_are_unique(spark):
    df = spark.createDataFrame([(1, json.dumps([DOC, DOC]))], "record_id long, payload string")
    rows = shred(df, "record_id", "payload", DELIVERY).collect()
    keys = [r.row_id for r in rows]
    assert len(keys) == len(set(keys))
    assert {r.parent_id for r in rows if r.parent_id} <= set(keys)


def test_lists_of_mixed_kinds_lose_nothing(spark):
    naming = Naming(signatures={"a": "x", "b": "y"})
    payloads = ['{"items":[{"a":1},{"b":2},{"b":3}]}', '{"items":[{"b":4},{"a":5},null,7,[{"a":6}]]}']
    df = spark.createDataFrame(list(enumerate(payloads)), "id long, payload string")
    graph = analyse(df, "payload", naming)
    assert {k: v["objects"] for k, v in graph.items() if k[1] in "xy"} == {("$", "x"): 3, ("$", "y"): 3}
    got = sorted((r.record_key, r.table_name, r.position, *sorted(r["columns"].items())) for r in shred(df, "id", "payload", naming).collect() if r.table_name in "xy")
    assert got == [("0", "x", 0, ("a", "1")), ("0", "y", 1, ("b", "2")), ("0", "y", 2, ("b", "3")), ("1", "x", 0, ("a", "6")), ("1", "x", 1, ("a", "5")), ("1", "y", 0, ("b", "4"))]


def test_plan_inlines_singletons_and_splits_the_rest(spark):
    records = [{"a": {"b": {"c": 1}}, "kids": [{"kids": [{"n": 1}]}], "x": {"s": {"v": 1}}, "y": {"s": {"v": 2}}}]
    df = spark.createDataFrame([(1, json.dumps(records[0]))], "id long, payload string")
    plan = plan_tables(analyse(df, "payload", Naming()))
    assert plan.reasons["kids"] == "repeated" and plan.reasons["s"] == "shared" and "b" not in plan.tables


def test_deep_recursion_and_empty_table(spark):
    deep = {"n": 0}
    for i in range(200):
        deep = {"n": i, "child": deep}
    df = spark.createDataFrame([(1, json.dumps({"child": deep}))], "id long, payload string")
    assert shred(df, "id", "payload", Naming()).where("table_name = 'child'").count() == 201
    assert shred(df.where("false"), "id", "payload", Naming()).count() == 0
    assert parse("[" * 100_000) is None


def test_typed_columns_become_linked_tables(spark):
    ddl = "k string, a struct<b:int,c:array<struct<d:string,e:array<string>>>>, position int"
    df = spark.createDataFrame([("r", (1, [("x", ["p", None, "q"]), None, ("y", None)]), 5), ("s", None, None), ("t", (None, []), 5)], ddl)
    t = typed_tables(df, "k", "root", {"a_c": "part"})
    assert sorted(t) == ["e", "part", "root"]
    assert sorted(map(tuple, t["root"].fillna(-1).collect())) == [("r", 1, 5), ("s", -1, -1), ("t", -1, 5)]
    assert sorted(map(tuple, t["part"].collect())) == [("r/part0", "r", 0, "x"), ("r/part2", "r", 2, "y")]
    assert sorted(map(tuple, t["e"].collect())) == [("r/part0/e0", "r/part0", 0, "p"), ("r/part0/e2", "r/part0", 2, "q")]
