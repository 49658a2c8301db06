"""Numbers, search, term vectors, flushes and replays against plain versions and values worked out by hand."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvida.operators import boilerplate, numbering, search
from corvida.operators import term_vectors as TV
from corvida.plans.texts import stream_flushes
from corvida.streaming import jobs, replay


@pytest.mark.parametrize("within", [(), ("k",)])
def test_numbers_and_sums_as_of_a_window(spark, within):
    rows = [(i, [None, "hot", "hot", "b"][i % 4], i * 7919 % 1000, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, k string, o int, v long").repartition(5)
    w = Window.partitionBy(*within).orderBy("o", "id")
    want = {r["id"]: (r["n"], r["s"]) for r in df.select("id", F.row_number().over(w).alias("n"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s")).collect()}
    got = numbering.numbered(df, "o", "id", within=within, parts=7)
    assert got.columns == [*df.columns, "number"]
    assert {r["id"]: r["number"] for r in got.collect()} == {i: n for i, (n, _) in want.items()}
    assert {r["id"]: r["before"] for r in numbering.running(df, "v", "o", "id", within=within, parts=3).collect()} == {i: s for i, (_, s) in want.items()}
    assert numbering.numbered(df.limit(0), "o", within=within).count() == 0


def test_budget_by_hand(spark):
    # 8, 0 (shorter than 7), 10 (crosses 15 and counts), then nothing
    texts = [(1, "a b c d e f g h"), (2, "one two"), (3, "a b c d e f g h i j"), (4, "a b c d e f g"), (5, None)]
    got = boilerplate.budgeted(spark.createDataFrame(texts, "doc_id long, text string"), 15).orderBy("doc_id").collect()
    assert [(r["tokens"], r["before"], r["counted"]) for r in got] == [(8, 0, True), (0, 8, True), (10, 8, True), (7, 18, False), (0, 25, False)]
    many = spark.createDataFrame([(i, "x a b c d e f y") for i in range(10)], "doc_id long, text string")
    assert boilerplate.trained(many, use_gaps=False, threshold=5, budget=16).count() == 0  # two documents
    assert boilerplate.trained(many, use_gaps=False, threshold=5, budget=None).count() == 2


def some_texts():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(vocab, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 40)))) for i in range(400)] + [(400, None), (401, ""), (402, "w59 " * 50), (403, "W1 w1. w1")]


def scanned(rows, texts, related, match, limit):
    words = {i: Counter(re.findall(r"[\w]{2,}", (t or "").lower())) for i, t in rows}
    idf = lambda t: math.log((1 + len(rows)) / (1 + sum(t in w for w in words.values()))) + 1
    out = []
    for i, w in words.items():
        hit, near = any(t in w for t in texts), any(t in w for t in related)
        score = sum(w[t] * idf(t) for t in texts) + (sum(w[t] * idf(t) * x for t, x in related.items()) if match != "exact" else 0)
        if {"exact": hit, "conceptual": near and not hit, "both": hit or near}[match]:
            out.append((i, "exact" if hit else "conceptual", round(score, 6)))
    out.sort(key=lambda x: (-x[2], x[0]))
    return out[:limit]


@pytest.mark.parametrize("block, first", [(16, 1), (16, 3), (1000, 8)])
def test_search_equals_a_full_scan(spark, monkeypatch, block, first):
    monkeypatch.setattr(search, "FIRST", first)
    rows = some_texts()
    built = search.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block)
    again = search.Index(spark, built.path)  # as another session would
    for texts, related in ((["w1"], {"w3": 0.5, "w40": 0.25}), (["w50", "w59", "nothing"], {"w58": 0.9}), ([], {"w20": 1.0})):
        for match in search.MATCH_TYPES:
            for limit in (1, 10, None):
                got = [tuple(r) for r in again.search(texts, related, limit, match).collect()]
                want = scanned(rows, texts, related, match, limit)
                assert (got if limit else sorted(got, key=lambda x: (-x[2], x[0]))) == want
    with pytest.raises(ValueError):
        again.search(["w1"], match_type="other")


def test_search_reads_no_block_that_cannot_win(spark):
    rows = some_texts()
    index = search.build(spark.createDataFrame(rows, "doc_id long, text string"), block=8)
    asked = []
    scored = index._scored
    index._scored = lambda gain, exact, match, blocks: (asked.append(blocks), scored(gain, exact, match, blocks))[1]
    best = index.search(["w59"], limit=1).collect()
    assert best[0]["doc_id"] == 402 and asked[-1].count() < index.maxima.where("term = 'w59'").count()


def test_search_of_an_empty_table_and_copies(spark):
    empty = search.build(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.search(["a"], limit=3).count() == 0 and empty.search(["a"]).count() == 0
    docs = spark.createDataFrame([(1, "one word", "en"), (2, "two words", "de"), (None, "no id word", "en")], "doc_id long, text string, lang string")
    path = search.scratch_path(spark, "copied")
    hits = search.build(docs).search(["word"])
    assert sorted(map(tuple, search.copied(docs, path, F.col("lang") == "en", hits).collect()), key=str) == [(1, "one word", "en"), (None, "no id word", "en")]
    assert search.copied(docs, path, hits=None, where=F.col("doc_id") == 2, mode="append").count() == 3
    assert search.copied(docs, path).count() == 3


def test_term_vectors(spark):
    """Words that stand in the same places come near each other; products of vectors come near the PPMI."""
    rng = random.Random(2)
    places = [("the {} sat on the mat and slept", ("cat", "kitty")), ("we drove the {} along a road to work", ("car", "auto")), ("she ate a {} with cheese for lunch", ("bread", "loaf"))]
    rows = []
    for i in range(300):
        shape, words = places[i % 3]
        rows.append((i, shape.format(rng.choice(words))))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").repartition(4)
    built = TV.build(docs, dim=16)
    near = {(r["query"], r["term"]): r["score"] for r in TV.nearest(built, built.where("term in ('cat', 'car', 'bread')"), n=40).collect()}
    assert min(near["cat", "kitty"], near["car", "auto"], near["bread", "loaf"]) > 0.8, near
    assert max(near.get(("cat", t), 0) for t in ("auto", "loaf", "cheese", "road")) < 0.5, near
    again = {r["term"]: r["vector"] for r in TV.build(docs.repartition(2), dim=16).collect()}
    assert all(np.allclose(r["vector"], again[r["term"]], atol=1e-4) for r in built.collect())
    of = TV.of_documents(docs, built).collect()
    assert len(of) == 300 and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-9 for r in of)
    assert TV.build(docs.limit(0)).count() == 0


def test_ppmi_and_factors_by_hand(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa bb"), (3, "cc dd")], "doc_id long, text string")
    terms = TV.vocabulary(docs, least=1)
    assert [(r["term"], r["id"], r["df"]) for r in terms.orderBy("id").collect()] == [("aa", 0, 2), ("bb", 1, 2), ("cc", 2, 1), ("dd", 3, 1)]
    matrix = TV.ppmi(TV.neighbours(docs, terms))
    assert {(r["a"], r["b"]): (r["n"], round(r["ppmi"], 6)) for r in matrix.collect()} == {k: v for a, b, v in ((0, 1, (2, round(math.log(3), 6))), (2, 3, (1, round(math.log(6), 6)))) for k in ((a, b), (b, a)) for v in (v,)}
    u = TV.factors(matrix, 4, dim=4)
    dense = np.zeros((4, 4))
    dense[0, 1] = dense[1, 0] = math.log(3)
    dense[2, 3] = dense[3, 2] = math.log(6)
    value, vector = np.linalg.eigh(dense)
    assert np.allclose(u @ u.T, (vector * np.maximum(value, 0)) @ vector.T, atol=1e-6)


def events(spark, folder, name, ids):
    rows = [(i, f"2024-01-01 00:{i % 3600 // 60:02d}:{i % 60:02d}", 1, "click", 1.0, None) for i in ids]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_flushes_over_batches_and_a_restart(spark, tmp_path):
    def run():
        stream = jobs.flushed(jobs.source(spark, f"{tmp_path}/in/*", name="*.parquet", files_per_trigger=1), 10)
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination()
        return {r["event_id"]: (r["flush"], r["full"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    events(spark, f"{tmp_path}/in", "a", range(0, 17))
    assert run() == {i: (0, True) for i in range(10)}
    events(spark, f"{tmp_path}/in", "b", range(17, 25))
    events(spark, f"{tmp_path}/in", "c", range(25, 43))
    got = run()  # started again: what the buffer held is still there
    assert len(got) == 40 and Counter(f for f, _ in got.values()) == {0: 10, 1: 10, 2: 10, 3: 10} and all(full for _, full in got.values())
    assert {i for i, (f, _) in got.items() if f <= 1} >= set(range(17))


def test_every_event_has_its_flush(spark, tmp_path):
    """What waits in the buffer at the end is there too, and events without a time come last."""
    rows = [(i, None if i % 50 == 7 else f"2024-01-01 00:00:{i % 60:02d}", 1, "click", 1.0, None) for i in range(417)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/written")
    (part,) = (tmp_path / "written").glob("*.parquet")
    part.rename(tmp_path / "events.parquet")
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))]
    got = stream_flushes(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((i, k // 201) for k, i in enumerate(order))


def test_flushes_by_ranges_over_batches_and_restarts(spark, tmp_path):
    def run():
        stream = jobs.source(spark, f"{tmp_path}/in/*", name="*.parquet", files_per_trigger=1)
        return {r["event_id"]: (r["flush"], r["full"]) for r in jobs.flushes(stream, 10, f"{tmp_path}/kept").collect()}

    (tmp_path / "in" / "a").mkdir(parents=True)
    assert run() == {}
    events(spark, f"{tmp_path}/in", "a", range(0, 4))
    assert run() == {i: (0, False) for i in range(4)}
    events(spark, f"{tmp_path}/in", "b", range(4, 20))
    assert run() == {i: (i // 10, True) for i in range(20)}
    events(spark, f"{tmp_path}/in", "c", range(20, 23))
    events(spark, f"{tmp_path}/in", "d", [])
    assert run() == {i: (i // 10, i < 20) for i in range(23)}
    events(spark, f"{tmp_path}/in", "e", range(23, 45))
    assert run() == {i: (i // 10, i < 40) for i in range(45)}


def test_replay_goes_round_and_on(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"e{i}") for i in range(12)], "event_id long, name string")
    first = replay.replayed(rows, ["event_id"], seed=3, batches=2, path=f"{tmp_path}/r").collect()
    both = replay.replayed(rows, ["event_id"], seed=3, batches=6, path=f"{tmp_path}/r").collect()
    whole = replay.replayed(rows.repartition(3), ["event_id"], seed=3, batches=6).collect()
    key = lambda r: (r["batch"], r["place"])
    assert sorted(map(tuple, both)) == sorted(map(tuple, whole)) and {key(r) for r in first} == {key(r) for r in both if r["batch"] < 2}
    order = [r["event_id"] for r in sorted(whole, key=key)]
    assert all(b == (a + 1) % 12 for a, b in zip(order, order[1:])) and len(order) > 12  # it went round
    assert all(1 <= n <= 15 for n in Counter(r["batch"] for r in whole).values()) and {r["batch"] for r in whole} == set(range(6))
    assert [r["event_id"] for r in sorted(replay.replayed(rows, ["event_id"], seed=3, batches=1, start=5).collect(), key=key)][0] == 5
    assert replay.replayed(rows.limit(0), ["event_id"], batches=2).count() == 0
