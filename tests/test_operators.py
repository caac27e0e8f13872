"""Hand-made cases of the operators, and properties that hold for any input."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirewell.functions import parse as P, text as T
from quirewell.operators import labels as L, metrics as M, mining as G, ml, predictors, retrieval, rules as R, sampling as S, votes as V


def frame(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def value(df):
    return df.collect()[0][0]


# ---- labels and metrics


def test_unknown_label_is_an_error(spark):
    df = frame(spark, [("MAYBE",)], "x string")
    with pytest.raises(Exception, match="MAYBE"):
        df.select(L.checked(F.col("x"), L.AT)).collect()


def test_last_wins_and_missing_keys(spark):
    df = frame(spark, [("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "k string, t int, v string")
    assert [r.v for r in L.last_wins(df, ["k"], [F.col("t")]).collect()] == ["y"]


def test_macro_recall_skips_labels_without_support(spark):
    df = frame(spark, [("TRUE", "TRUE"), ("TRUE", "FALSE"), ("FALSE", "FALSE"), (None, None)], "g string, p string")
    r = M.macro_recall(df, "g", "p", L.AT, []).collect()[0]
    assert (r.macro_recall, r.n, r.n_gold_null) == (0.75, 4, 1)


def test_macro_recall_of_nothing(spark):
    df = frame(spark, [], "g string, p string")
    r = M.macro_recall(df, "g", "p", L.AT, []).collect()[0]
    assert (r.macro_recall, r.n) == (0.0, 0)


def test_bootstrap_brackets_its_point_and_keeps_its_seed(spark):
    rnd = random.Random(1)
    df = frame(spark, [(rnd.choice(L.AT), rnd.choice(L.AT), "m") for _ in range(120)], "g string, p string, m string")
    a, b = (M.bootstrap(df, "g", "p", L.AT, ["m"], replicates=300).collect()[0] for _ in range(2))
    assert a == b and a.lo <= a.point <= a.hi


# ---- votes


def brute_loo(rows):
    out = []
    for i, (v, g) in enumerate(rows):
        c = Counter(h for j, (w, h) in enumerate(rows) if j != i and w == v and h is not None)
        if c:
            best = max(c.values())
            tied = sorted(k for k, n in c.items() if n == best)
            med = sorted(v, key=L.ORDINAL.get)[len(v) // 2]
            out.append(tied[0] if len(tied) == 1 else med if med in tied else tied[0])
        else:
            m, n = Counter(v).most_common(1)[0]
            out.append(m if n >= 2 else "FALSE")
    return out


def test_leave_one_out_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [([rnd.choice(L.AT) for _ in range(3)], rnd.choice([*L.AT, None])) for _ in range(150)]
    df = frame(spark, [(i, *r) for i, r in enumerate(rows)], "i int, votes array<string>, gold string")
    got = [r.stacked for r in V.leave_one_out(df, "votes", "gold").orderBy("i").collect()]
    assert got == brute_loo(rows)


@pytest.mark.parametrize("votes,tied,every,false,first", [(["TRUE", "FALSE"], "TRUE", "TRUE", "FALSE", "TRUE"), (["FALSE", "TRUE", "PROBABLE"], "PROBABLE", "PROBABLE", "FALSE", "FALSE"), (["TRUE", "TRUE", "FALSE", "FALSE"], "TRUE", "TRUE", "FALSE", "TRUE"), (["PROBABLE"], "PROBABLE", "PROBABLE", "PROBABLE", "PROBABLE")])
def test_plurality_ties(spark, votes, tied, every, false, first):
    df = frame(spark, [(votes,)], "v array<string>")
    got = df.select(*[V.plurality(F.col("v"), t) for t in ("median_of_tied", "median_of_all", "prefer_false", "first")]).collect()[0]
    assert tuple(got) == (tied, every, false, first)


def test_top_share_ranks_globally(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0.1, 0.2, 0.5, None, rnd.random()])) for i in range(400)]
    df = frame(spark, rows, "k int, s double")
    want = {k for k, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:80]}
    for most in (1000, 30):  # the second finds the border by counts between samples
        assert {r.k for r in V.top_share(df, "s", 0.2, ["k"], most_local=most, splits=7).where("routed").collect()} == want
    tied = frame(spark, [(i, 0.5) for i in range(300)], "k int, s double")
    assert {r.k for r in V.top_share(tied, "s", 0.5, ["k"], most_local=20, splits=5).where("routed").collect()} == set(range(150))
    same = frame(spark, [(1, 0.5)] * 50, "k int, s double")
    assert V.top_share(same, "s", 0.5, ["k"], most_local=5).where("routed").count() == 50  # equal rows can't be parted
    assert V.top_share(df.where("false"), "s", 0.5, ["k"]).count() == 0


def test_disagreement_of_unanimous_votes(spark):
    df = frame(spark, [(["TRUE"] * 3,)], "v array<string>")
    f = {k: df.select(c).collect()[0][0] for k, c in V.disagreement(F.col("v"), 3).items()}
    assert f["unanimous"] == 1 and f["vote_entropy"] == 0 and f["ordinal_range"] == 0 and f["modal_count"] == 1


# ---- text


CASES = [("John in Paris was happy.", ["John"], ["Paris"])]


def one(spark, ctx, pers, locs, column):
    return frame(spark, [(ctx, pers, locs)], "c string, p array<string>, q array<string>").select(column(F.col("c"), F.col("p"), F.col("q"))).collect()[0][0]


def test_preposition_and_gap(spark):
    assert one(spark, *CASES[0], T.preposition_link) is True
    assert one(spark, *CASES[0], T.char_gap) == 4
    assert one(spark, "Paris. Nothing.", ["John"], ["Paris"], T.char_gap) is None
    assert one(spark, None, ["a"], ["b"], T.preposition_link) is False


def test_mentions_are_taken_literally(spark):
    assert one(spark, "M. X\\E (a.b) in [Y]", ["X\\E (a.b)"], ["[Y]"], T.preposition_link) is True


@pytest.mark.parametrize("text,loc,expect", [("Berlin, 14. Oktober. Es war einmal ein langer Text.", "Berlin", "opening"), ("LONDON, Dec. 31. It was said.", "London", "opening"), ("Es war so.\nWien, den 3. Mai 1848.", "Wien", "closing"), ("Lange Rede. Frankfurt. Am 14. Oktober kam er.", "Frankfurt", "mid"), ("He lived in Rome for years.", "Rome", None)])
def test_datelines(spark, text, loc, expect):
    df = frame(spark, [(text, [loc])], "t string, q array<string>")
    got = T.datelines(df, "t", "q").collect()[0].asDict()
    assert got["location_is_dateline"] == float(expect is not None)
    if expect:
        assert got[f"location_is_{expect}_dateline"] == 1.0


def test_signals_of_accented_words(spark):
    df = frame(spark, [("Il est À PRÉSENT à Paris, autrefois à Lyon.",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in df.select(T.signal_category(F.col("t"))).collect()][:2] == ["negation", "no_signal"]
    found = df.select(T.temporal_signals(F.col("t"))).collect()[0][0]
    assert {(x.surface, x.category) for x in found} == {("autrefois", "negation"), ("À PRÉSENT", "present"), ("autrefois", "relative_only")}


def test_nearest_timex_takes_the_first_of_equals(spark):
    e = [("", "1900-01-05", ""), ("", "1899-12-28", ""), ("", "1900", ""), ("", "x", "")]
    df = frame(spark, [(e, "1900-01-01"), (e, "1900"), ([], "1900-01-01"), (None, None)], "e array<struct<surface:string,value:string,type:string>>, d string")
    assert [r[0] for r in df.select(T.nearest_timex(F.col("e"), F.col("d"))).collect()] == [4, None, None, None]


def test_markers(spark):
    got = one(spark, "In Ajaccio, napoleon was born.", ["Napoleon", "Nap"], ["Ajaccio"], T.marked)
    assert got == "In [E2] Ajaccio [/E2], [E1] napoleon [/E1] was born."
    assert one(spark, "x", ["A"], ["B"], T.marked) == "[E2] B [/E2] . [E1] A [/E1] . x"
    assert one(spark, "x", ["A"], ["B"], lambda c, p, q: T.marked(c, p, q, joint=True)) == "[E1] A [/E1] [E2] B [/E2] . x"
    assert one(spark, "at Myrtle\nBeach now", ["Myrtle Beach"], [], lambda c, p, q: T.tagged(c, p, "<P>", "</P>")) == "at <P>Myrtle\nBeach</P> now"


def test_count_is_non_overlapping(spark):
    df = frame(spark, [("aaaa aa",)], "t string")
    assert value(df.select(T.occurrences(F.col("t"), F.lit("aa")))) == 3


# ---- parsers and rules


@pytest.mark.parametrize("raw,at,is_at,status", [
    ("at=TRUE isAt=FALSE | conf_at=0.9 conf_isAt=0.7", "TRUE", "FALSE", "ok"), ("at = probable, hence isAt = true", "PROBABLE", "TRUE", "partial"),
    ("at: yes. is at: not present", "TRUE", "FALSE", "partial"), ("", None, None, "fail"), (None, None, None, "fail"), ("LABEL LABEL", None, None, "fail"), ("at: prob", "PROBABLE", None, "partial"),
])
def test_combined_parser(spark, raw, at, is_at, status):
    r = frame(spark, [(raw,)], "t string").select(P.combined(F.col("t")).alias("p")).collect()[0].p
    assert (r["at"], r.isAt, r.status) == (at, is_at, status)


def test_single_parser(spark):
    df = frame(spark, [("PROBABLE | confidence=0.4",), ("I say TRUE, confidence: 1.5",), ("maybe",)], "t string")
    got = [tuple(r[0]) for r in df.select(P.single(F.col("t"), "at")).collect()]
    assert got == [("PROBABLE", 0.4, "ok"), ("TRUE", None, "partial"), ("PROBABLE", None, "partial")]


@pytest.mark.parametrize("raw,want", [('x {"a": "}"} y', '{"a": "}"}'), ("```json\n{\"b\": 1}\n```", '{"b": 1}'), ('{"a": {"b": 1}', None), ("none", None), (None, None), ('{"a": "\\"}"}', '{"a": "\\"}"}')])
def test_json_extraction(raw, want):
    assert P.extract_json(raw) == want


def test_justification_coercions(spark):
    raw = '{"evidence_strength": "Strong", "narrative_justification": "n", "evidence_spans": [{"text": "t", "supports": "AT"}, {"text": ""}], "wikidata_corroboration": {"supports": "yes"}, "temporal_assessment": {"within_isat_window": "maybe"}, "flags": ["a", ""]}'
    r = frame(spark, [(raw,), ("[1]",)], "t string").select(P.parsed_justification(F.col("t")).alias("j")).collect()
    assert r[0].j.strength == "strong" and r[0].j.supports is True and r[0].j.within_window == "uncertain" and r[0].j.flags == ["a"] and len(r[0].j.spans) == 1 and r[0].j.status == "ok"
    assert r[1].j.status == "fail"


@pytest.mark.parametrize("at,is_at,conf,strength,within,escalate", [("FALSE", "TRUE", 0.9, "strong", None, True), ("TRUE", "FALSE", 0.9, "contradictory", None, True), ("TRUE", "FALSE", 0.5, "strong", None, False), ("TRUE", "TRUE", 0.5, "weak", "false", True), ("TRUE", "FALSE", None, None, None, False)])
def test_rules(spark, at, is_at, conf, strength, within, escalate):
    df = frame(spark, [(at, is_at, conf, strength, within)], "at string, i string, c double, s string, w string")
    none = F.lit(None)
    r = df.select(R.checks(F.col("at"), F.col("i"), F.col("c"), F.col("c"), none.cast("string"), F.col("s"), none.cast("array<string>"), none.cast("boolean"), F.col("w")).alias("r")).collect()[0].r
    # both confidences share the value, so one low confidence is two soft flags
    assert r.escalate is (escalate or conf == 0.5)


# ---- mining, sampling, retrieval, models


def test_hidden_box_is_found(spark):
    rnd = random.Random(7)
    rows = [(rnd.uniform(4, 6), rnd.uniform(4, 6), True) for _ in range(60)]
    rows += [(x, y, False) for x, y in ((rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(180)) if not (4 <= x <= 6 and 4 <= y <= 6)]
    df = frame(spark, rows, "x0 double, x1 double, y boolean")
    best = G.discover(df, ["x0", "x1"], "y", chains=4, steps=300).orderBy(F.desc("nwracc")).first()
    assert best.support_pos / best.support >= 0.9 and best.support_pos >= 30


def test_patterns_with_unknown_values(spark):
    df = frame(spark, [(1.0, "R"), (None, "R"), (5.0, None)], "x double, y string")
    r = G.evaluate(df, [{"x": (0.0, 2.0)}, {"x": (9.0, 9.0)}], F.col("y") == "R").orderBy("pattern_id").collect()
    assert (r[0].support, r[0].precision, r[0].recall) == (1, 1.0, 0.5) and (r[1].support, r[1].nwracc) == (0, 0.0)


def test_leaders_and_redundancy():
    assert G.leaders([{1, 2}, {1, 2, 3}, {9}], 0.5) == [0, 0, 1]
    assert G.non_redundant([("a", 0.9, {1, 2}), ("b", 0.8, {1, 2}), ("c", 0.7, {5}), ("a", 0.6, {7})]) == [0, 2]


def test_folds_are_even_in_each_stratum(spark):
    df = frame(spark, [(str(i), "a" if i % 3 else None) for i in range(100)], "k string, s string")
    c = Counter((r.s, r.fold) for r in S.stratified_folds(df, "k", ["s"], 5).collect())
    for s in ("a", None):
        n = [c[(s, f)] for f in range(5)]
        assert max(n) - min(n) <= 1


def test_balanced_sampler_fills_short_classes(spark):
    df = frame(spark, [(str(i), "a" if i < 3 else "b") for i in range(50)], "k string, y string")
    assert {r.y: r["count"] for r in S.balanced(df, "k", "y", 10).groupBy("y").count().collect()} == {"a": 10, "b": 10}


def test_retrieval_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    got = {}
    for most in (1 << 20, 300):  # broadcast, and blocks of both sides
        got = {}
        for r in retrieval.fetched(df.where("id < 10"), df.repartition(4), "id", "v", 5, most_bytes=most).collect():
            got.setdefault(r.q_id, {})[r["rank"]] = r.id
        assert all([got[i][k + 1] for k in range(5)] == np.argsort(-s[i])[:5].tolist() for i in range(10))


def test_hashed_embedding_equals_brute_force(spark):
    texts = [None, "", " .-! ", "one", "One one, ONE two", "à peine l'été 1872 à_b", " ".join(f"w{i % 700}" for i in range(20_000))]
    df = frame(spark, list(enumerate(texts)), "id int, t string")
    words = [[w for w in re.split(r"\W+", (t or "").lower(), flags=re.ASCII) if w] for t in texts]
    each = frame(spark, [(w,) for w in sorted({w for x in words for w in x})], "w string")
    slot = {r.w: r.s for r in each.select("w", F.expr("pmod(xxhash64(w), 16)").alias("s")).collect()}
    got = {r.id: r.embedding for r in predictors.hashed_embedding(df, "t", 16).collect()}
    for i, x in enumerate(words):
        n = Counter(slot[w] for w in x)
        norm = math.sqrt(sum(c * c for c in n.values())) or 1.0
        assert got[i] == pytest.approx([n[k] / norm for k in range(16)], abs=1e-6)


def test_hashed_embedding_reads_each_text_once(spark):
    e = predictors.hashed_embedding(frame(spark, [("x " * 50_000,)], "t string"), "t").select("embedding")
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # it stood in the plan twice, within lambdas: 4,096 times a row
    began = time.time()
    assert sorted(value(e))[-2:] == [0.0, 1.0] and time.time() - began < 60


def test_spectral_map_separates_blobs(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    centres = ((5, 0), (0, 5), (-5, -5))
    rows = [(i, (np.array(centres[i % 3]) + rng.normal(scale=0.3, size=2)).tolist()) for i in range(90)]
    df = frame(spark, rows, "id long, v array<double>")
    m = ml.SpectralMap(components=2, near=10).fit(df, "v", "id")
    assert all(np.diff(m.eigenvalues) >= -1e-9)
    z = {r.id: np.array(r.v) for r in m.transform(df, "id", "v").collect()}
    same = np.mean([np.linalg.norm(z[i] - z[i + 3]) for i in range(0, 80)])
    other = np.mean([np.linalg.norm(z[i] - z[i + 1]) for i in range(0, 80)])
    assert same * 3 < other


def test_separable_data_is_learned(spark):
    rows = [(float(i % 10), float(i // 10), "P" if i % 10 > 5 else "N", str(i)) for i in range(200)]
    df = frame(spark, rows, "a double, b double, y string, k string")
    p = ml.out_of_fold(df, "k", "y", lambda: ml.logistic(["a", "b"], "y"), folds=2)
    assert p.count() == 200 and p.where("y = predicted").count() >= 180


def test_client_retries_then_falls_back():
    class Broken:
        calls = 0

        def chat(self, prompt):
            Broken.calls += 1
            raise OSError

    pauses = []
    got = predictors.asked(Broken(), "x", attempts=3, fallback=predictors.HashClient(), sleep=pauses.append)
    assert got.startswith("at=") and Broken.calls == 3 and pauses == [1.0, 2.0]
    assert predictors.asked(Broken(), "x", attempts=1, sleep=pauses.append) == ""


def test_entropy_of_ambiguity(spark):
    df = frame(spark, [(0.5,), (1.0,), (0.0,), (0.9,)], "p double")
    got = [r[0] for r in df.select(V.binary_ambiguity(F.col("p"))).collect()]
    h = -(0.9 * math.log(0.9) + 0.1 * math.log(0.1)) / math.log(2)
    assert got[:3] == [1.0, 0.0, 0.0] and abs(got[3] - h * 0.2) < 1e-9


def test_discovered_boxes_are_counted_on_all_rows(spark):
    rnd = random.Random(6)
    rows = [(rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(3000)]
    rows = [(x, y, 3 <= x <= 6 and rnd.random() < 0.9) for x, y in rows] + [(None, 1.0, True), (4.0, 4.0, None)]
    got = G.discover(frame(spark, rows, "x0 double, x1 double, y boolean"), ["x0", "x1"], "y", chains=3, steps=60, most_rows=200).collect()
    whole = rows[:-2]
    share = sum(r[2] for r in whole) / len(whole)
    assert len(got) == 3
    for g in got:
        inside = [r for r in whole if all(not on or lo <= v <= hi for v, lo, hi, on in zip(r, g.lo, g.hi, g.active))]
        positive = [r for r in inside if r[2]]
        assert (g.support, g.support_pos) == (len(inside), len(positive)) and g.support > 200
        assert abs(g.nwracc - len(inside) / len(whole) * (len(positive) / len(inside) - share) / (share * (1 - share))) < 1e-5
        assert all(not on or (min(r[j] for r in positive), max(r[j] for r in positive)) == (g.lo[j], g.hi[j]) for j, on in enumerate(g.active))
    assert G.discover(frame(spark, [(1.0, 1.0, True)], "x0 double, x1 double, y boolean"), ["x0", "x1"], "y", chains=2).collect() == []


def test_every_vector_has_a_subtype_and_all_components_count(spark):
    import numpy as np
    from conftest import SF
    from quirewell.operators.retrieval import nearest_of_all
    from quirewell.plans.registry import QUERIES
    from quirewell.session import table

    e = table(spark, SF, "embeddings").select("vec_id", "embedding", "label")
    rows = e.orderBy("vec_id").collect()
    assert {r.id for r in QUERIES["g12_subtypes"](spark, SF).collect()} == {r.vec_id for r in rows}
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    d, y = ((x[:, None] - x[None]) ** 2).sum(2), np.array([r.label for r in rows])
    values = []
    for i, label in enumerate(y):
        same = (y == label).sum()
        own = d[i, y == label].sum() / max(same - 1, 1)
        other = min(d[i, y == k].mean() for k in set(y.tolist()) - {label})
        values.append((other - own) / max(own, other) if same > 1 else 0.0)
    assert abs(QUERIES["m20_silhouette"](spark, SF).first()[0] - np.mean(values)) < 1e-4
    few = e.where("vec_id < 60")
    sets = [{(r.q_id, r.vec_id, r["rank"]) for r in nearest_of_all(few, "vec_id", "embedding", 3, n).collect()} for n in (1 << 20, 9000)]
    assert sets[0] == sets[1] and len(sets[0]) == 3 * few.count()
