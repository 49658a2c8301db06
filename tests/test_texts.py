"""Repair, emotions, intents, titles and boilerplate against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from corvida.functions import emotions
from corvida.functions import encoding as E
from corvida.functions import text as T
from corvida.operators import boilerplate as B
from corvida.operators import intents as I


def one(spark, text, f, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


CLEAN = [
    "Größe, Öl und Übermaß: „Das Ä“ – 5 °C", "déjà vu à Besançon, « ÇA » où ?", "¿Qué? ¡Año Ñandú! 20 €", "plain ASCII text", "Жизнь", "日本語 naïve", "", None,
    "Â und Ã allein", "«\xa0l’été\xa0» dit-il", "“the café…” – “naïve”—", "it’s “fine” — really…",
]
BROKEN = [
    ("GrÃ¶ÃŸe", "Größe"), ("dÃ©jÃ\xa0 vu", "déjà vu"), ("itâ€™s â€œfineâ€\x9d", "it’s “fine”"), ("20 â‚¬ und Ã–l", "20 € und Öl"),
    ("Å\x81Ã³dÅº", "Łódź"), ("Ð–Ð¸Ð·Ð½ÑŒ", "Жизнь"), ("æ—¥æœ¬èªž", "日本語"), ("ðŸ˜€", "😀"), ("Â©", "©"), ("日本 cafÃ©", "日本 café"),
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(spark, text):
    assert one(spark, text, E.repaired) == text


@pytest.mark.parametrize("text", [c for c in CLEAN if c])
def test_misread_once_and_twice_comes_back(spark, text):
    assert one(spark, text, lambda x: E.repaired(E.misread(x))) == text
    assert one(spark, text, lambda x: E.repaired(E.misread(E.misread(x)))) == text


def test_lone_letters_of_other_scripts_stay_misread(spark):
    # a lone pair such as Ñ before a closing quote is more often clean text
    assert one(spark, "«ESPAÑ”", E.repaired) == "«ESPAÑ”"
    assert one(spark, "Ж", lambda x: E.repaired(E.misread(x))) == "Ð–"


def test_broken_by_hand(spark):
    rows = spark.createDataFrame([(b, w) for b, w in BROKEN], "broken string, want string").withColumn("got", E.repaired(F.col("broken"))).collect()
    assert [(r["broken"], r["got"]) for r in rows] == BROKEN


def test_emotions_by_any_hook(spark):
    docs = spark.createDataFrame([(1, "Pure JOY and rage, joy"), (2, "love of bored people"), (3, None), (4, ""), (5, "no such thing")], "doc_id long, text string")
    want = {(1, "Emotion 2", "A:Joy"), (1, "Emotion 1", "G:Rage"), (2, "Emotion 4", "Love")}
    names = {"joy", "rage", "love"}
    only = lambda t: F.filter(emotions.HOOKS["lexicon"](t), lambda w: w.isin(*names))
    assert {tuple(r) for r in emotions.placed(docs, only).collect()} == want
    assert {tuple(r) for r in emotions.placed(docs, only, words=2).collect()} == {(1, "Emotion 2", "A:Joy"), (2, "Emotion 4", "Love")}
    emotions.hook("fixed")(lambda t: F.when(t.isNotNull(), F.array(F.lit("Awe"), F.lit(None), F.lit(""), F.lit("a"))))
    assert {tuple(r) for r in emotions.placed(docs, "fixed").collect()} == {(i, "Emotion 4", "Awe") for i in (1, 2, 4, 5)}
    both = [sorted(map(tuple, emotions.placed(docs, h).collect())) for h in ("lexicon", "lexicon_arrow")]
    assert both[0] == both[1] and want <= set(both[0])
    assert emotions.placed(docs.limit(0)).count() == 0


def test_intents_kept_and_labelled(spark):
    rows = [("same", 1, [1.0, 0.0]), ("same", 2, [1.0, 0.0]), ("apart", 1, [1.0, 0.0]), ("apart", 2, [0.0, 1.0]), ("single", 1, [1.0, 0.0]), ("near", 1, [1.0, 0.0]), ("near", 2, [0.8, 0.6]), ("apart", 2, [0.0, 1.0]), (None, 1, [1.0, 0.0]), ("gone", 1, None)]
    kept = I.kept(spark.createDataFrame(rows, "intent string, part int, vector array<double>"))
    assert sorted((r["intent"], r["part"]) for r in kept.collect()) == [("apart", 1), ("apart", 2), ("near", 1), ("near", 2), ("single", 1)]
    scored = [(1, "a", 0.6), (1, "b", 0.7), (2, "a", 0.5), (3, "b", 0.9), (3, "a", 0.9), (4, "other", 1.0), (None, "a", 1.0), (5, "a", None)]
    got = I.labelled(spark.createDataFrame(scored, "doc_id long, intent string, score double"), ["a", "b"], prefix="is_")
    assert got.columns == ["doc_id", "intent", "score", "is_a", "is_b"]
    assert sorted(map(tuple, got.collect())) == [(1, "b", 0.7, 0.6, 0.7), (3, "a", 0.9, 0.9, 0.9)]
    assert I.labelled(got.select("doc_id", "intent", "score").limit(0), []).count() == 0
    named = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [1.0, 0.001]), (3, "z", [0.9, 0.4359])], "n int, name string, vector array<double>")
    assert [r["name"] for r in I.different(named, ["n"]).orderBy("n").collect()] == ["x", "z"]
    assert I.different(named.limit(0), ["n"]).count() == 0


def test_titles_names_and_highlights(spark):
    assert tuple(one(spark, "Former Employee - Sales-Manager", T.employee)) == ("Former Employee", "Manager", "Manager")
    assert tuple(one(spark, "Current Employee - Anonymous Employee", T.employee)) == ("Current Employee", "Anonymous Employee", "Employee")
    assert one(spark, "Current Employee - Anonymous Employee", lambda x: T.rating_title(x, F.lit(4))) == "Current Employee gave 4 Stars"
    assert one(spark, None, T.employee) is None or tuple(one(spark, None, T.employee)) == (None, None, None)
    assert one(spark, ["a", None, "b"], T.joined_texts, "array<string>") == "a ¶ b"
    assert [one(spark, q, T.question_name) for q in ("QID5", "x_QID12_3", "Q5", None)] == ["Q5", "Q12", None, None]
    red = lambda s: f'<span style="color:red">{{{s}}}</span>'
    assert one(spark, "ab ü cd", lambda x: T.highlighted(x, F.expr("array(array(0, 2), array(3, 4))"))) == f"{red('ab')} {red('ü')} cd"
    assert one(spark, "ab", lambda x: T.highlighted(x, F.lit(None))) == "ab"


def test_repeats_by_hand(spark):
    assert one(spark, "good!!!!!!!!", T.shorten_repeats) == "good!!!!"
    assert one(spark, "hahahahahaha ok", T.shorten_repeats) == "hahahaha ok"
    assert one(spark, "aaaa", T.shorten_repeats) == "aaaa"
    assert one(spark, None, T.shorten_repeats) is None


def test_boilerplate_by_hand(spark):
    # the same eight words in six documents; one document has a word exchanged
    line = "please do not reply to this mail ever"
    texts = [(i, f"start{i} {line} end{i}") for i in range(6)] + [(6, "start6 please do not REPLY to this mail ever end6"), (7, None), (8, "please do not answer to this mail ever"), (9, "a b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    grams = B.ngram_rows(docs)
    found = {r["doc_id"]: (r["first_token"], r["end_token"]) for r in B.spans(grams, B.weights(grams, use_gaps=False)).collect()}
    assert found == {i: (1, 9) for i in range(7)}
    cut = {r["doc_id"]: (r["text"], r["removed"]) for r in B.removed(docs, B.spans(grams, B.weights(grams, use_gaps=False))).collect()}
    assert cut[0] == ("start0  end0", [[7, 7 + len(line)]]) and cut[7] == ("", []) and cut[9] == ("a b", []) and cut[8][1] == []
    assert B.spans(grams.limit(0), B.weights(grams)).count() == 0
