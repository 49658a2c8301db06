"""Values worked out by hand from the rules themselves, not from another engine's copy of them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvida.functions import colors, slices, text
from corvida.operators import lexicon


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("p, u, n, net", [(0.5, 0.2, 0.3, 0.2), (0.3, 0.6, 0.1, 0.0), (0.1, 0.0, 0.9, -0.8), (0.05, 0.2, 0.75, -0.65)])
def test_net_value(spark, p, u, n, net):
    assert one(spark, colors.net_value(*map(F.lit, (p, u, n)))) == pytest.approx(net)


@pytest.mark.parametrize("net, color", [(-1.0, "#ff0000"), (-0.75, "#ff0000"), (-0.74, "#ff7f7f"), (0.0, "#f0f0f0"), (0.25, "#f0f0f0"), (0.26, "#009dff"), (1.0, "#0000ff")])
def test_net_color(spark, net, color):
    assert one(spark, colors.net_color(F.lit(net))) == color


@pytest.mark.parametrize("polar, color", [(0.39, "#000000"), (0.4, "#ca79fc"), (0.79, "#ca79fc"), (0.8, "#8000ff")])
def test_polar_color(spark, polar, color):
    assert one(spark, colors.polar_color(F.lit(polar))) == color


@pytest.mark.parametrize("net, polar, color", [(-0.3, 0.1, "#ff8000"), (-0.25, 0.1, "#808080"), (0.25, 0.1, "#808080"), (0.3, 0.1, "#00cc22"), (0.1, 0.5, "#0000ff"), (0.0, 0.5, "#ff0000"), (0.0, 0.9, "#8000ff")])
def test_story_color(spark, net, polar, color):
    assert one(spark, colors.story_color(F.lit(net), F.lit(polar))) == color


@pytest.mark.parametrize("given, at", [("2023-05-17T12:02:48Z", datetime(2023, 5, 17, 12, 2, 48)), ("2013-01-07T00:00:00.000Z", datetime(2013, 1, 7)), ("2013-01-07T00:00:00.25Z", datetime(2013, 1, 7, 0, 0, 0, 250000)), ("1/2/2023", datetime(2023, 1, 2)), ("01/02/23", datetime(2023, 1, 2)), ("1/2/69", datetime(1969, 1, 2)), ("01/02/23 10:30", datetime(2023, 1, 2, 10, 30)), ("2023-05-17", datetime(2023, 5, 17)), ("2023-05-17 10:00:00", None), ("soon", None), ("", None)])
def test_dates(spark, given, at):
    seconds = one(spark, F.unix_micros(slices.parsed(F.lit(given))))
    assert seconds == (at and round((at - datetime(1970, 1, 1)).total_seconds() * 1e6))


@pytest.mark.parametrize("word, place", [("joy", ("Emotion 2", "A:Joy")), ("RAGE", ("Emotion 1", "G:Rage")), ("dis", ("Emotion 2", "F:Disgust")), ("love", ("Emotion 4", "Love")), ("xyz", None), ("", None)])
def test_emotions(spark, word, place):
    got = one(spark, text.emotion_of(F.lit(word)))
    assert (got and tuple(got)) == place


def test_lexicon_scores(spark):
    seen = spark.createDataFrame([(1, "good", "positive"), (2, "good", "positive"), (2, "good", "negative"), (3, "bad", "negative"), (3, "new", None), (4, "odd", "neutral")], "doc_id long, term string, sentiment string")
    known = spark.createDataFrame([("good", -3.0), ("bad", -2.0)], "term string, known_score double")
    rows = {r["term"]: r for r in lexicon.beside_known(lexicon.linear_scores(seen), known).collect()}
    assert set(rows) == {"good", "bad", "odd"}  # without a sentiment there is no score
    assert (rows["good"]["total_doc_count"], rows["good"]["axis_score"], rows["good"]["linear_score"]) == (2, 0.333333, 1.666665)
    assert rows["good"]["conflict"] and not rows["bad"]["conflict"]
    assert (rows["bad"]["change"], rows["odd"]["change"], rows["odd"]["novel"]) == (3.0, 0.0, True)
