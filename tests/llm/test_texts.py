"""Leaks, look-alike pairs, scans and packing: cases, odd input, brute force."""

import random

import numpy as np
import pytest

from quirewell.llm import canonical as C, fold, leaks, packing, scans

WORDS = [f"word{i}" for i in range(40)]


def texts(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, k string")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, lang string")


# ---- leaks


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


@pytest.mark.parametrize("most", [5_000_000, 0])
def test_leaks_equal_brute_force_either_way(spark, most):
    rnd = random.Random(4)
    held = [[rnd.choice(WORDS) for _ in range(25)] for _ in range(6)]
    docs = []
    for i in range(60):
        body = [rnd.choice(WORDS) for _ in range(20)]
        if i % 2:
            h = rnd.choice(held)
            a = rnd.randrange(10)
            body[5:5] = h[a : a + rnd.randrange(9, 16)]
        docs.append(body)
    want = {(i, j) for i, d in enumerate(docs) for j, h in enumerate(held) if longest(d, h) >= 12}
    noisy = lambda w: " \n".join(x.upper() + "," if k % 3 == 0 else x.replace("o", "о") for k, x in enumerate(w))
    got = leaks.leaks(texts(spark, [(i, noisy(d)) for i, d in enumerate(docs)]), items(spark, [(j, " ".join(h), "en") for j, h in enumerate(held)]), most_windows=most)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want


def test_leaks_of_unspaced_text_and_odd_rows(spark):
    zh = "最近镇长柏敬石在众人面前在启霖岭公布了轮船时刻表据悉前公证人"
    docs = texts(spark, [(1, "甲，" + "。".join(zh[:24]) + "乙"), (2, zh[:23]), (3, None), (4, ""), (1, zh), (5, "ﬁ" * 50)])
    held = items(spark, [(7, zh, "zh"), (8, zh, None), (9, None, "zh"), (10, "short", "en"), (11, "", None)])
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaks(docs, held).collect())
    assert got == [(1, 7), (1, 8)]
    assert leaks.leaks(docs.where("false"), held).count() == 0 and leaks.leaks(docs, held.where("false")).count() == 0


def test_removed_spans(spark):
    passage = " ".join(WORDS[:14])
    docs = texts(spark, [(1, f"Before. {passage} after."), (2, "nothing")])
    got = leaks.remove_leaks(docs, items(spark, [(1, passage, "en")])).collect()
    assert [(r.doc_id, r.clean_text) for r in got] == [(1, "Before.  after.")]


# ---- look-alikes


def test_pairs_equal_brute_force(spark):
    rnd = random.Random(6)
    swap = {"o": "о", "e": "е", "a": "ａ", "f": "f​", " ": " ", "х": "x", "о": "o"}
    base = ["see the fine ore", "весьма хорошо", "το μέλλον", "see the fine Ore", "a c"]
    rows = []
    for i in range(80):
        t = rnd.choice(base)
        rows.append((i, "".join(swap.get(c, c) if rnd.random() < 0.2 else c for c in t)))
    rows += [(100, None), (101, ""), (102, " "), (103, " "), (104, " ")]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and x != y and fold.skeleton(x) == fold.skeleton(y)}
    got = C.alike_pairs(texts(spark, rows), "doc_id", "text")
    assert {(r.doc_id_a, r.doc_id_b) for r in got.collect()} == want and len(want) > 50


def test_alike_classes_count_copies(spark):
    rows = [(i, "see ore") for i in range(40)] + [(100 + i, "see οre") for i in range(30)] + [(200, "sее ore"), (300, "other"), (301, "other"), (400, None), (401, "")]
    members, links = C.alike_classes(texts(spark, rows), "doc_id", "text")
    got = {r.doc_id: r.n_alike for r in members.collect()}
    assert got == {**{i: 31 for i in range(40)}, **{100 + i: 41 for i in range(30)}, 200: 70}
    assert links.count() == 3
    pairs = [{tuple(r) for r in C.alike_pairs(texts(spark, rows), "doc_id", "text", per_task=n).collect()} for n in (2_000_000, 9)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 40 * 30 + 70


def test_canonical_text(spark):
    docs = texts(spark, [(1, "conocer вечер"), (2, "cοnοcer вeчeр"), (3, None), (4, ""), (5, "conocer"), (2, "cοnοcer вeчeр")])
    got = sorted((r.doc_id, r.canonical_text) for r in C.canonical(docs, "doc_id", "text").collect() if r.canonical_text)
    assert got == [(1, "conocer вечер"), (2, "conocer вечер"), (2, "conocer вечер"), (5, "conocer")]
    assert C.canonical(docs.where("false"), "doc_id", "text").count() == 0


def test_automaton_counts_edits():
    t = C.Trie([("conocer", 5), ("conoce", 9), ("cancer", 1)])
    assert [x[2] for x in t.walk("cοnο​cer")] == ["conocer"]
    assert [(c, w) for c, _, w in t.walk("conocer", most=1)] == [(0, "conocer"), (1, "conoce")]
    assert t.walk("xyz") == []


# ---- scans


TITLE = "Le Petit Canton"
PAGE = ["LE PETIT CANTON.", "Le vapeur est arrivé à Vieux-", "Courtigny avec les voya-", "", "- 288 -", "Le Pctit Canton            87", "", "geurs et le tarif du sel.", "1815 ?", "[12]", "Est-", "il vrai ?"]


NOISY = [["Karl Holten", "Holten", "Holten", "Hoiten"], ["Verlinel", "Verlincl", "Verlinel"], ["Tau- ner", "Tauner", "Tauner"], ["Saint-Val", "Mme Val"], ["Le-\nroux", "Leroux"], ["Pelcnet", "Pelenet", "Pelenet"], None, [None]]
SCHEMA = "document_id string, text string, language string, title string, names array<array<string>>"


def corpus():
    rnd = random.Random(1)
    words = "le vapeur est arrivé avec les voyageurs et tarif du sel Est-il vrai selon une dépêche particulière pour la somme convenue malgré pluies récentes".split()
    swap = [("c", "e"), ("u", "n"), ("rn", "m"), ("1", "l"), ("f", "s")]
    out = []
    for i in range(400):
        ws = [rnd.choice(words) for _ in range(60)]
        for k, w in enumerate(ws):
            if rnd.random() < 0.04 and len(w) > 4:
                read, meant = rnd.choice(swap)
                at = w.find(meant, 1)
                if at > 0:
                    ws[k] = w[:at] + read + w[at + len(meant) :]
        lines = [" ".join(ws[j : j + 8]) for j in range(0, 60, 8)]
        for j in range(1, 7):  # words divided, and hyphens that stay
            w = lines[j].split()[0]
            if "-" in w:
                lines[j - 1 : j + 1] = [f"{lines[j - 1]} {w.split('-')[0]}-", w.split("-")[1] + lines[j][len(w) :]]
            elif len(w) > 5 and (i + j) % 3:
                lines[j - 1 : j + 1] = [f"{lines[j - 1]} {w[:3]}-", w[3:] + lines[j][len(w) :]]
        if i % 4:
            lines[5:5] = [["", f"        {i}", ""], [f"— {i % 300} —", TITLE.upper() + "."], [f"[{i}]"]][i % 4 - 1]
        if i % 3 == 0:
            lines.insert(0, [TITLE, f"{TITLE.upper()}, 1843-01-02.", f"{TITLE}            {i}"][i % 9 // 3])
        out.append((str(i), "\n".join(lines), "fr", TITLE, [["Jean Brafivaux", "Brafivaux", "Brafivaux"], NOISY[i % len(NOISY)]]))
    return out


def test_line_kinds_and_divisions():
    kinds = scans.line_kinds(PAGE, TITLE)
    assert [i for i, k in enumerate(kinds) if k == "running_header"] == [0, 5]
    assert [i for i, k in enumerate(kinds) if k == "page_number"] == [4, 9]
    assert [(i, j) for i, j, *_ in scans.divisions(PAGE, kinds)] == [(1, 2), (2, 7), (10, 11)]
    assert "running_header" not in scans.line_kinds(PAGE, None)


def trained(spark, rows=None):
    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    return df, scans.train(df, "text", "language", "title", "names")


def found(df, made, keys=("document_id", "text", "language", "title")):
    return {(r.record_key, r.pos, r.defect) for r in scans.defects(df, *keys, made).collect()}


def test_editor_on_held_out_misreadings(spark):
    df, made = trained(spark)
    page = spark.createDataFrame([("p", "\n".join(PAGE), "fr", TITLE)], "document_id string, text string, language string, title string")
    got = {(i, d) for _, i, d in found(page, made)}
    assert {(2, "broken_word"), (0, "running_header"), (5, "running_header"), (4, "page_number"), (9, "page_number")} <= got
    assert (1, "broken_word") not in got and (10, "broken_word") not in got and (8, "page_number") not in got
    text = scans.repaired(page, "document_id", "text", "language", "title", made).first().clean_text
    assert "voyageurs et le tarif" in text and "288" not in text
    editor, right, total = made.editor, 0, 0
    for w in ["voyageurs", "particulière", "convenue", "récentes", "vapeur", "malgré", "selon"]:
        for read, meant in (("c", "e"), ("u", "n"), ("f", "s"), ("1", "l")):
            at = w.find(meant, 1)
            if at > 0:
                total += 1
                fixed = editor.correct("fr", w[:at] + read + w[at + 1 :])
                right += fixed is not None and fixed[0] == w
    assert total >= 8 and right / total >= 0.8
    assert all(editor.correct("fr", w) is None for w in ("voyageurs", "Brafivaux", "xyzzy"))


def test_without_weights_nothing_is_changed(spark):
    df, made = trained(spark)
    before = found(df, made)
    lists = [["Verlonet", "Verlonet", "Vcrlonet", "Verl- onet"]]
    assert len({d for *_, d in before}) >= 2 and scans.Editor.mentions(made.editor, lists[0])[0]
    for ranker in ("furniture", "joining", "editing", "name_joining", "name_editing"):
        getattr(made.editor, ranker).weight = {}
    forms = scans.statistics(df, "text", "language", "title", "names").where("kind = 'w'")
    made.fixes = scans.judged(forms, made.editor)
    assert found(df, made) == set() and made.editor.mentions(lists[0]) == ([], lists[0])


def test_spurious_letters_are_deleted_where_the_corpus_shows_them():
    rnd = random.Random(4)
    good = ["".join(rnd.choice("abdeghklmnoprstu") for _ in range(7)) for _ in range(60)]
    rows = [("de", w, 400, 0, 0) for w in good]
    sample = [("de", w[:3] + "j" + w[3:], 1, 0) for w in good[:50]]
    editor = scans.Editor(rows + [(*r, 0) for r in sample], {"de": 1000}, sample, [], [], [])
    assert ("j", "") in [x for v in editor.starts.values() for x in v] or any(m == "" or len(m) < len(r) for v in editor.starts.values() for r, m in v)
    assert all(editor.correct("de", w[:3] + "j" + w[3:]) == (w, 3) for w in good[50:])
    assert all(editor.correct("de", w, 400) is None for w in good)


def test_rare_words_are_treated_alike_at_every_size(spark):
    rows = corpus()
    for n in (1, 3):
        many = [(f"{r[0]}x{k}", *r[1:]) for r in rows for k in range(n)]
        many += [(f"r{k}", "la sémaphorie du sel", "fr", TITLE, None) for k in range(8 * n)] + [("m", "la sémaphoric du sel", "fr", TITLE, None)]
        df, made = trained(spark, many)
        assert [(i, d) for k, i, d in found(df.where("document_id = 'm'"), made)] == [(0, "misread")]


def test_mentions_and_odd_rows(spark):
    _, made = trained(spark)
    names = ["Jean Verlonet", "Verlonet", "Vcrlonet", "Verl- onet", None, "Ver­\nlonet", "St.-Rat X", ""]
    got, fixed = made.editor.mentions(names)
    assert got == [(2, "misread"), (3, "broken_word"), (5, "broken_word")]
    assert fixed[2] == fixed[3] == fixed[5] == "Verlonet"
    odd = spark.createDataFrame([("a", None, None, None), ("b", "", "fr", TITLE), ("c", "x\n\n\n        7\n", "xx", None), ("c", "x\n\n\n        7\n", "xx", None)], "document_id string, text string, language string, title string")
    assert found(odd, made) == {("c", 3, "page_number")}
    assert found(odd.where("false"), made) == set()
    assert {r.document_id: r.clean_text for r in scans.repaired(odd, "document_id", "text", "language", "title", made).collect()} == {"a": None, "b": "", "c": "x"}


def test_training_on_nothing(spark):
    df, made = trained(spark, [])
    assert made.fixes.count() == 0 and found(df, made) == set()
    assert scans.repair("a-\nb 1'x", "fr", None, made.editor, {}) == "a- b 1'x"


# ---- packing


def test_packing_is_whole_and_tight():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 800, size=4000)
    bins = packing.pack(sizes, 2048)
    load = np.bincount(bins, sizes)
    assert load.max() <= 2048 and sizes.sum() / (len(load) * 2048) > 0.98


def test_sum_of_squares_choice_equals_brute_force():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 12, size=120)
    cap = 12
    gaps: list[int] = []
    for s, b in zip(sizes, packing.pack(sizes, cap)):
        def cost(g):
            return sum(gs.count(x) ** 2 for gs in [g] for x in set(g) if 0 < x < cap)

        options = [sorted(gaps[:i] + [g - s] + gaps[i + 1 :]) for i, g in enumerate(gaps) if g >= s] + [sorted([*gaps, cap - s])]
        before = list(gaps)
        if b == len(gaps):
            gaps.append(cap - s)
        else:
            gaps[b] -= s
        assert gaps[b] >= 0 and cost(sorted(gaps)) == min(cost(o) for o in options), before


def test_containers_cover_every_token(spark):
    rows = [(i, int(n)) for i, n in enumerate(np.random.default_rng(2).integers(0, 5000, size=300))] + [(7, 2048), (7, 4096)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, n_tokens long, container int")
    got = packing.containers(df, "doc_id", per_shard=50).toPandas()
    assert (got.token_end - got.token_start).sum() == sum(n for _, n in rows)
    assert (got.token_end - got.token_start).groupby(got.container).sum().max() <= 2048
    whole = got[got.doc_id == 3].sort_values("token_start")
    assert whole.token_start.tolist() == [0, *whole.token_end.tolist()[:-1]]
    assert all(len(g) == 1 for k, g in got.groupby("doc_id") if dict(rows)[k] <= 2048 and k != 7)
    assert packing.containers(df.where("false"), "doc_id").count() == 0


def test_measured_by_a_public_tokenizer(spark):
    df = texts(spark, [(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")])
    assert {r.doc_id for r in packing.measured(df, "doc_id", "text").collect()} == {1, 4}


def test_clean_mentions_and_contexts(spark):
    from conftest import SF
    from quirewell.llm.queries import QUERIES
    from quirewell.session import table

    _, made = trained(spark)
    rows = spark.createDataFrame([("a", ["Jean Verlonet", "Verlonet", "Vcrlonet", "Verl- onet", None], "fr"), ("b", None, "fr"), ("c", [], None)], "k string, m array<string>, l string")
    got = {r.k: r.clean_mentions for r in scans.repaired_mentions(rows, "k", "m", made).collect()}
    assert got == {"a": ["Jean Verlonet", "Verlonet", "Verlonet", "Verlonet", None], "b": None, "c": []}
    samples = table(spark, SF, "relation_instance")
    assert QUERIES["p4_mentions"](spark, SF).count() == samples.count()
    clean = [r.clean_text for r in QUERIES["p4_context"](spark, SF).collect()]
    assert len(clean) == samples.count() and not any("\n" in x.replace("\n\n", "") for x in clean if x)
    spans = QUERIES["p3_context"](spark, SF)
    assert spans.columns == ["sample_id", "start_char", "end_char"]
    assert spans.select("sample_id").distinct().count() == samples.where("trim(context) <> ''").select("sample_id").distinct().count()


def test_spans_are_the_same_on_both_paths(spark):
    item = " ".join(f"alpha{i}" for i in range(60))
    far = " ".join(item.split()[:15]) + " own words between " + " ".join(f"beta{i}" for i in range(50)) + " " + " ".join(item.split()[-15:])
    hanzi = "".join(chr(0x4E00 + 7 * i) for i in range(80))
    rows = [(1, far, None), (2, "x " + item + " y", None), (3, far, None), (3, far, None), (3, "z " + item, None), (4, hanzi[:30] + "".join(chr(0x6E00 + i) for i in range(60)) + hanzi[-30:], None), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    items = spark.createDataFrame([(7, item, "en"), (8, hanzi, "zh")], "item_id long, text string, lang string")
    spans = [sorted(set(map(tuple, leaks.leaked_spans(docs, items, most_windows=n).collect()))) for n in (5_000_000, 0)]
    assert spans[0] == spans[1] and len([s for s in spans[1] if s[0] == 1]) == 2 and {s[0] for s in spans[1]} == {1, 2, 3, 4}
    one = docs.where("doc_id in (1, 2, 4)")
    clean = [{r.doc_id: r.clean_text for r in leaks.remove_leaks(one, items, most_windows=n).collect()} for n in (5_000_000, 0)]
    assert clean[0] == clean[1] and "beta49" in clean[1][1]
