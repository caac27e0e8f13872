"""Folding of look-alikes, and sentence boundaries by the transducer."""

import random

import numpy as np
import pytest

from quirewell.llm import fold, sentences as S


@pytest.mark.parametrize("a,b", [("Ｂrаԁԁｅ", "Bradde"), ("ﬁn", "fin"), ("ét​e", "éte"), ("a b c", "a b c"), ("⽂", "文"), ("й", "й"), ("", ""), ("­", "")])
def test_look_alikes_fold(a, b):
    assert fold.skeleton(a) == fold.skeleton(b)


@pytest.mark.parametrize("a,b", [("a", "A"), ("e", "é"), ("1", "l"), ("²", "2"), ("a b", "a  b"), ("a\nb", "a b")])
def test_visible_differences_stay(a, b):
    assert fold.skeleton(a) != fold.skeleton(b)


def test_array_fold_equals_fold_by_strings():
    rnd = random.Random(2)
    chars = "aеоé ﬁ́​ｂ漢Ωж\n.ำ"
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randrange(30))) for _ in range(300)]
    assert fold.skeletons(texts) == [fold._by_strings(x) if not x.isascii() else x for x in texts]


CASES = [
    ("en", "Mr. Smith left at 10.30 a.m. with 7,592 dols. in hand. Who knows? \"Is it so?\" asked he.", ["Mr. Smith left at 10.30 a.m. with 7,592 dols. in hand.", "Who knows?", "\"Is it so?\" asked he."]),
    ("en", "He said, \"It is over. I go.\" She left (sic!) and wept ... then came back. Tickets, etc. The end", ["He said, \"It is over. I go.\"", "She left (sic!) and wept ... then came back.", "Tickets, etc.", "The end"]),
    ("en", "HEAD\n\nOne line\nbreak here.Next one", ["HEAD", "One line\nbreak here.", "Next one"]),
    ("fr", "M. X répondit : « le tarif est prêt. » Le vapeur part. « Qui donc ? » demanda-t-il, v. p. 12.", ["M. X répondit : « le tarif est prêt. »", "Le vapeur part.", "« Qui donc ? » demanda-t-il, v. p. 12."]),
    ("de", "Am 18. April 1843 kam Dr. K. Holl, vgl. Nr. 14, S. 3. „Wer da?“ fragte er. Es geschah am 6. 10. 1837 in Bern.", ["Am 18. April 1843 kam Dr. K. Holl, vgl. Nr. 14, S. 3.", "„Wer da?“ fragte er.", "Es geschah am 6. 10. 1837 in Bern."]),
    ("es", "«¿Dónde está?», preguntó. ¡Qué asombro! ¿Quién sabe?", ["«¿Dónde está?», preguntó.", "¡Qué asombro!", "¿Quién sabe?"]),
    ("ru", "12 июня 1826 г. Ф. Савиков ушёл. «Кто там?» — спросил он.", ["12 июня 1826 г. Ф. Савиков ушёл.", "«Кто там?» — спросил он."]),
    ("el", "Είναι αλήθεια; Ο δρ. Καλός ήρθε με 5 δρχ. χθες.", ["Είναι αλήθεια;", "Ο δρ. Καλός ήρθε με 5 δρχ. χθες."]),
    ("zh", "“谁在那里？”女教师问道。葛说：“都好。”“走吧！”他说。", ["“谁在那里？”女教师问道。", "葛说：“都好。”", "“走吧！”他说。"]),
    ("ja", "「誰だ？」と尋ねた。彼は「行く。」と述べた。終わり！", ["「誰だ？」と尋ねた。", "彼は「行く。」と述べた。", "終わり！"]),
    ("hi", "प्रो. राम ने 94.3 रु. दिए। क्या सच?", ["प्रो. राम ने 94.3 रु. दिए।", "क्या सच?"]),
    ("th", "สวัสดี 94.3 บาท  ลาก่อน\nครับ", ["สวัสดี 94.3 บาท", "ลาก่อน\nครับ"]),
    ("fr", "PUIS IL DIT ... PUIS IL REPARTIT. FIN", ["PUIS IL DIT ... PUIS IL REPARTIT.", "FIN"]),
]


@pytest.mark.parametrize("lang,text,want", CASES)
def test_boundaries(lang, text, want):
    _, a, b = S.split([text], [lang])
    assert [text[x:y] for x, y in zip(a, b)] == want


def test_batches_equal_single_texts():
    texts = [c[1] for c in CASES] + ["", " \n ", "\x00x. Y"]
    langs = [c[0] for c in CASES] + [None, "en", None]
    n, a, b = S.split(texts, langs)
    for i, (t, lang) in enumerate(zip(texts, langs)):
        if t:
            _, x, y = S.split([t], [lang])
            assert a[n == i].tolist() == x.tolist() and b[n == i].tolist() == y.tolist()


def test_scan_equals_sequential_run():
    move, emit = S.transducer()
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, S.N_EVENTS * 2 - 2, size=1000)
    state, want = 0, []
    for x in symbols:
        want.append(bool(emit[state, x]))
        state = int(move[state, x])
    for chunk in (1, 7, 64, 5000):
        assert S.run(symbols, chunk).tolist() == want


def test_long_text_and_odd_rows(spark):
    long = "A word here. " * 200_000
    df = spark.createDataFrame([(1, None, "en", 5), (2, "", None, 5), (3, "  \n", "", 5), (4, long, "xx", 5), (4, "One. Two.", "EN", 5)], "doc_id long, text string, lang string, k int")
    got = S.sentences(df, "doc_id", "text", "lang").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {4: 200_002}
    assert S.sentences(df.where("false"), "doc_id", "text", "lang").count() == 0


def test_language_is_guessed_in_every_stretch():
    from quirewell.llm.sentences import split

    english = "The mayor of the town has read the long letter to the people. " * 100
    german = "Der Bürgermeister und die Räte der Stadt und die Bürger. Sie kamen am 3. Januar und am 14. Infanterie an. " * 60
    own = [german[a:b] for _, a, b in zip(*split([german], [None]))]
    for text, at in ((english + german, len(english)), (german, 0)):
        got = [text[a:b] for _, a, b in zip(*split(["One. Two.", text], ["en", None])) if _ == 1 and a >= at]
        assert got == own and not any(x.startswith("Infanterie") for x in got)
    dated = "He was 25. Then he left. "
    text = dated * 300 + german
    assert [text[a:b] for _, a, b in zip(*split([text], [None]))][:4] == ["He was 25.", "Then he left."] * 2
