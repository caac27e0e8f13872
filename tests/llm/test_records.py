"""Neighbours, groups and splits, overlaps: brute force and odd input."""

import random

import numpy as np

from pyspark.sql import functions as F

from quirewell.llm import neighbours as N, overlap as O, scans, splits as S


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, emb array<float>, node int, cell string")


def brute(x, ids, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-round(s[i, j], 6), ids[j]))[:k]
        out |= {(ids[i], ids[j]) for j in order if s[i, j] >= least}
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(150, 16))
    near = base[rng.integers(0, 150, 450)] + rng.normal(scale=0.08, size=(450, 16))
    x = np.concatenate([base, near]).astype(np.float32)
    df = vectors(spark, [(int(i), v.tolist()) for i, v in enumerate(x)])
    want = brute(x.astype(float), list(range(len(x))), 5, 0.9)
    for options in ({"shard": 150, "most_shard": 120}, {"shard": 60, "most_shard": 60, "most_fit": 40}):  # the second divides cells once more
        got = {(r.id, r.other) for r in N.neighbours(df, "vec_id", "emb", 16, **options).collect()}
        assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_samples_are_bounded(spark):
    df = N.usable(spark.range(5000).selectExpr("id", "array(float(id), float(1)) as e"), "id", "e", 2)
    assert len(N._sample(df, 5000, 100, 2)) <= 100 and len(N._sample(df, 5000, 9000, 2)) == 5000


def test_copies_ties_and_bad_vectors(spark):
    v, w = [1.0, 0.0, 0.1, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(i, v) for i in range(1, 10)] + [(20, w), (21, None), (22, [0.0] * 4), (23, [1.0, 0.0]), (24, [float("nan"), 0.0, 0.0, 1.0]), (25, [1.0, 0.01, 0.1, 0.0]), (None, v)]
    got = {}
    for r in N.neighbours(vectors(spark, rows), "vec_id", "emb", 4).collect():
        got.setdefault(r.id, []).append(r.other)
    assert sorted(got) == [*range(1, 10), 25]
    assert sorted(got[9]) == [1, 2, 3, 4, 5] and sorted(got[1]) == [2, 3, 4, 5, 6] and sorted(got[25]) == [1, 2, 3, 4, 5]
    empty = vectors(spark, [(1, None)])
    assert N.neighbours(empty, "vec_id", "emb", 4).count() == 0


def test_beam_finds_all_on_a_full_graph():
    x = N.unit(np.random.default_rng(1).normal(size=(40, 8)))
    g = N.Graph(x, degree=39, width=40)
    ids, _ = g.query(x)
    assert all(set(r) == set(range(40)) for r in ids.tolist())


def union_find(n, edges):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        p[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    for most in (1_000_000, 3):
        edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 340)] + [(0, 0)]
        df = spark.createDataFrame(edges, "u long, v long")
        got = {r.u: r.label for r in S.components(df, most_local=most).collect()}
        root = union_find(341, edges)
        seen = {x for e in edges if e[0] != e[1] for x in e}
        assert set(got) == seen
        by = {}
        for x in seen:
            by.setdefault(root[x], set()).add(got[x])
        assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def test_groups_share_keys_and_nulls_never_match(spark):
    rows = [("a", "s1", None, ["p1", None]), ("b", "s1", "c", None), ("c", None, "c", []), ("d", None, None, ["p1"]), ("e", None, None, None), ("f", None, None, [None]), ("a", "s9", None, None), ("g", "s9", None, None), (None, "s1", None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "document_id string, s string, c string, p array<string>, u int")
    g = {r.document_id: r["group"] for r in S.group_records(df, "document_id", [(F.col("s"), False), (F.col("c"), False), (F.col("p"), True)]).collect()}
    assert len({g[x] for x in "abcdg"}) == 1 and len({g["a"], g["e"], g["f"]}) == 3
    assert S.group_records(df.where("false"), "document_id", [(F.col("s"), False)]).count() == 0


def test_a_key_on_half_the_records_is_split(spark):
    rows = [(f"d{i}", "hot" if i % 2 else f"s{i % 50}", None if i % 3 else f"c{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "document_id string, s string, c string")
    keys = [(F.col("s"), False), (F.col("c"), False)]
    whole = {r.document_id: r["group"] for r in S.group_records(df, "document_id", keys).collect()}
    parts = {r.document_id: r["group"] for r in S.group_records(df, "document_id", keys, per_task=100, most_local=50).collect()}
    assert len(set(zip(whole.values(), (parts[k] for k in whole)))) == len(set(whole.values())) == len(set(parts.values()))


def test_splits_keep_groups_whole_and_shares_close(spark):
    rnd = random.Random(1)
    rows = [(str(i), f"g{rnd.randrange(400)}", "old") for i in range(3000)]
    got = S.assign_splits(spark.createDataFrame(rows, "k string, name string, split string"), "k", {"train": 0.7, "val": 0.15, "test": 0.15}).collect()
    by, n = {}, {}
    names = {k: g for k, g, _ in rows}
    for r in got:
        by.setdefault(names[r.k], set()).add(r.split)
        n[r.split] = n.get(r.split, 0) + 1
    assert len(got) == 3000 and all(len(v) == 1 for v in by.values())
    assert abs(n["train"] / 3000 - 0.7) < 0.03 and abs(n["val"] / 3000 - 0.15) < 0.03


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_bit_parallel_lcs():
    rnd = random.Random(8)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(70))] for _ in range(2))
        assert O.lcs(a, b) == slow_lcs(a, b)


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    stock = " ".join(vocabulary[:12])
    rows = []
    for i in range(40):
        body = stock.split() + [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 20, 60]))]
        rows.append((f"d{i:02}", " ".join(body), None, rnd.choice(["train", "val", "test"])))
        for k in range(rnd.randrange(3)):
            copy = [rnd.choice(vocabulary) if rnd.random() < 0.1 else w for w in body]
            rows.append((f"d{i:02}{k}", " ".join(copy).upper().replace(" ", ", "), None, rnd.choice(["train", "val", None])))
    rows += [("x", None, None, "train"), ("y", "", None, "val"), ("z", "stop", None, "val"), ("zz", "Stop!", None, "train")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, x string, h string, split string, n int")
    words = {k: scans.continuous_words(x, h) for k, x, h, s in rows if x and s}
    side = {k: s for k, x, h, s in rows if x and s}
    want = set()
    for a in words:
        for b in words:
            if side[a] != "train" and side[b] == "train" and O.lcs(words[a], words[b]) >= 0.75 * max(len(words[a]), len(words[b])):
                want.add((a, b))
    got = {(r.eval_key, r.train_key) for r in O.overlaps(df, scans.continuous_words).collect()}
    assert got <= want and len(got) >= 0.995 * len(want) and want
    assert O.overlaps(df.where("false"), scans.continuous_words).count() == 0


def test_large_family_of_near_copies_at_the_very_bound(spark):
    rnd = random.Random(5)
    body = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    rows = [(f"d{i:03}", " ".join(f"w{rnd.randrange(5000)}" if rnd.random() < 0.12 else w for w in body), None, "train" if i % 3 else "val") for i in range(240)]
    rows += [(f"u{i:03}", " ".join(body[:12] + [f"w{rnd.randrange(5000)}" for _ in range(100)]), None, "train" if i % 3 else "val") for i in range(60)]
    words = [(k, x.split(), s) for k, x, _, s in rows]
    want = {(a, b) for a, x, s in words for b, y, t in words if s == "val" and t == "train" and O.lcs(x, y) >= 0.75 * max(len(x), len(y))}
    df = spark.createDataFrame(rows, "k string, x string, h string, split string")
    got = {(r.eval_key, r.train_key) for r in O.overlaps(df, scans.continuous_words).collect()}
    assert got <= want and len(got) >= 0.998 * len(want) and len(want) > 5000


def test_planted_variants_are_all_found_however_many(spark):
    rnd = random.Random(2)
    body = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    for n in (10, 30, 300):
        variants = [(f"t{i:03}", " ".join(f"x{rnd.randrange(9999)}" if (j + i) % 9 == 0 else w for j, w in enumerate(body)), None, "train") for i in range(n)]
        df = spark.createDataFrame([("e", " ".join(body), None, "test"), *variants], "k string, x string, h string, split string")
        assert O.overlaps(df, scans.continuous_words).count() == n


def test_recall_at_faults_every_five_to_nine_words(spark):
    rnd = random.Random(7)
    rows, want = [], 0
    for i in range(300):
        body = [f"w{rnd.randrange(8000)}" for _ in range(rnd.randrange(60, 400))]
        copy, at = list(body), rnd.randrange(5)
        while at < len(copy):
            copy[at] = f"x{rnd.randrange(9999)}"
            at += i % 5 + 5 if i % 2 else rnd.randrange(5, 10)
        rows += [(f"e{i}", " ".join(body), None, "val"), (f"t{i}", " ".join(copy), None, "train")]
        want += O.lcs(body, copy) >= 0.75 * len(body)
    got = {(r.eval_key[1:], r.train_key[1:]) for r in O.overlaps(spark.createDataFrame(rows, "k string, x string, h string, split string"), scans.continuous_words).collect()}
    assert all(a == b for a, b in got) and len(got) >= 0.99 * want and want == 300


def test_report_counts_copies_without_expanding(spark):
    rnd = random.Random(3)
    body = [f"w{rnd.randrange(900)}" for _ in range(80)]
    near = " ".join(["other", *body[1:]])
    rows = [(f"t{i}", " ".join(body), None, "train") for i in range(5)] + [(f"n{i}", near, None, "train") for i in range(3)] + [(f"v{i}", " ".join(body), None, "val") for i in range(4)] + [("x", "alone", None, "test"), ("y", None, None, "test")]
    df = spark.createDataFrame(rows, "k string, x string, h string, split string")
    by = spark.createDataFrame([(k, "s1" if k in ("v0", "v1") else "s2") for k, *_ in rows], "k string, source string")
    got = sorted(map(tuple, O.report(df, scans.continuous_words, by).select("split", "source", "n_pairs", "n_exact", "n_records").collect()))
    assert got == [("val", "s1", 16, 10, 2), ("val", "s2", 16, 10, 2)]
    assert len(O.overlaps(df, scans.continuous_words).collect()) == 32
    members, found = O.links(df, scans.continuous_words)
    assert found.count() == 2 and members.count() == 13
