"""What grows with the tables: scratch space, rows met twice, passes over the input; the rows stay the same."""

import os

import pytest
from pyspark.sql import functions as F

from corvida import catalogue
from corvida.operators import boilerplate as B
from corvida.session import shared_dir

SMALL = "/root/testdata/sf0.001"


def scratch_bytes(spark):
    top = shared_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(top) for f in files if f.endswith(".parquet"))


def same(a, b):
    return a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


# -- boilerplate ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["a b ___ d e ___ g h ¶ i j k l m n"] * 7 + ["a b c d e ___ g h"] * 3 + ["a b ___ d e q g h ¶ a"] * 4 + ["\n" * 30, None, "", "x\x1cy a b ___ d e z g h ¶ i j k l m n o", "Straße ΣΑΣ " * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return rows.union(spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id") + 1000, "text"))


@pytest.mark.parametrize("held", [B.HELD, 50])
def test_frequent_runs_are_those_of_all_rows(spark, odd, held, monkeypatch):
    """Also with literal gaps, edges inside, repeated newlines, and in several passes."""
    monkeypatch.setattr(B, "HELD", held)
    monkeypatch.setattr(B, "GROUP", 2_000)
    monkeypatch.setattr(B, "SORTED", 5_000)
    grams = B.ngram_rows(odd)
    for gaps in (False, True):
        assert same(B.weights(grams, use_gaps=gaps), model := B.frequent(odd, use_gaps=gaps))
    assert same(B.spans(grams, model), B.matched(odd, model).select("doc_id", F.inline("spans")))
    cut = B.removed(odd, B.spans(grams, model)).select("doc_id", "text", F.col("removed").cast("string"))
    assert same(cut, B.spliced(B.matched(odd, model)).select("doc_id", "text", F.col("removed").cast("string")))


def test_no_runs_in_nothing(spark, odd):
    assert B.frequent(odd.limit(0)).count() == 0
    assert B.matched(odd.limit(0), B.frequent(odd)).count() == 0
    assert B.matched(odd, B.frequent(odd.limit(0))).where("size(spans) > 0").count() == 0


def test_control_characters_are_parts_of_words(spark):
    """Tokens are found alike where they are counted and where they are cut out."""
    docs = spark.createDataFrame([(i, f"x\x1cy{i} please do not reply to this mail end{i}") for i in range(6)], "doc_id long, text string")
    assert [r["text"] for r in B.spliced(B.matched(docs, B.frequent(docs))).orderBy("doc_id").collect()] == [f"x\x1cy{i}  end{i}" for i in range(6)]


@pytest.mark.parametrize("name", ["boilerplate_gapped", "boilerplate_highlighted", "boilerplate_ngrams", "boilerplate_removed", "boilerplate_spans"])
def test_boilerplate_leaves_no_row_for_each_run(spark, name):
    before = scratch_bytes(spark)
    catalogue.QUERIES[name](spark, SMALL).count()
    assert scratch_bytes(spark) - before < 2 * os.path.getsize(f"{SMALL}/documents.parquet")


# -- near duplicates --------------------------------------------------------------------------


def test_similar_pairs_are_those_of_all_pairs(spark, monkeypatch):
    """Long documents with many shared words, groups of near copies cut in blocks, copies, short ones, and batches that end inside a term."""
    import math
    import random
    from collections import Counter

    from corvida.operators import similarity as S

    rng = random.Random(5)
    common, rare = [f"w{i}" for i in range(40)], [f"r{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(common) for _ in range(60)] + rng.sample(rare, 60)
        for k in range(10):
            texts.append(" ".join(base[: len(base) - k] + rng.sample(rare, k // 2)))
    texts += texts[:5] + ["aa", "aa bb", "bb aa aa", "aa bb cc", "", None, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(S, "WORDS", 500)
    got = {(r["a"], r["b"]): r["cosine"] for r in S.similar_pairs(docs, S.classes(docs).cache()).collect()}
    bags = {}
    for i, t in enumerate(texts):
        words = [w for w in (t or "").split() if len(w) > 1]
        if words:
            bags.setdefault(tuple(sorted(words)), []).append(i)
    n, df = sum(map(len, bags.values())), Counter()
    for bag, ids in bags.items():
        df.update(dict.fromkeys(set(bag), len(ids)) | {})
    vectors = {}
    for bag, ids in bags.items():
        x = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(bag).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        vectors[min(ids)] = {t: v / norm for t, v in x.items()}
    want = {}
    for a, x in vectors.items():
        for b, y in vectors.items():
            if a < b and (c := sum(v * y.get(t, 0) for t, v in x.items())) > S.THRESHOLD:
                want[a, b] = c
    assert len(want) > 20 and got.keys() == want.keys(), (len(want), len(got))
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("name", ["dedupe_groups", "dedupe_keep_first", "dedupe_keep_longest", "dedupe_keep_shortest", "dedupe_pairs"])
def test_dedupe_leaves_no_row_for_each_term(spark, name):
    before = scratch_bytes(spark)
    catalogue.QUERIES[name](spark, SMALL).count()
    assert scratch_bytes(spark) - before < os.path.getsize(f"{SMALL}/documents.parquet")


def test_no_pairs_in_nothing(spark):
    from corvida.operators import similarity as S

    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.duplicate_groups(docs).count() == 0
    assert S.similar_pairs(docs, S.classes(docs)).count() == 0


# -- term vectors -----------------------------------------------------------------------------


def test_neighbours_are_those_of_all_pairs(spark, monkeypatch):
    """Also for equal words, unknown ones between, and pairs sent in several pieces and groups."""
    import random
    from collections import Counter

    from corvida.operators import term_vectors as TV

    monkeypatch.setattr(TV, "SORTED", 97)
    monkeypatch.setattr(TV, "WORDS", 50)
    monkeypatch.setattr(TV, "GROUP", 64)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", f"u{i}"]) for _ in range(rng.randrange(40))) for i in range(60)] + [None, "aa aa aa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = TV.vocabulary(docs, least=3).cache()
    ids = {r["term"]: r["id"] for r in terms.collect()}
    want = Counter()
    for t in texts:
        w = (t or "").split()
        for i in range(len(w)):
            for x in w[i + 1 : i + 6]:
                if w[i] in ids and x in ids:
                    want[ids[w[i]], ids[x]] += 1
                    want[ids[x], ids[w[i]]] += 1
    assert {(r["a"], r["b"]): r["n"] for r in TV.neighbours(docs, terms).collect()} == want
    assert TV.neighbours(docs.limit(0), terms).count() == 0


def test_products_take_all_partitions_at_once(spark):
    """A job for each product, not one for each partition after another."""
    from corvida.operators import term_vectors as TV

    n = 60
    matrix = spark.range(n * n).select((F.col("id") % n).cast("int").alias("a"), (F.col("id") / n).cast("int").alias("b")).withColumn("ppmi", F.lit(1.0) / (1 + F.abs(F.col("a") - F.col("b"))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("products", "")
    try:
        TV.factors(matrix.repartition(20), n, dim=4)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("products")) < 10
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# -- concepts ---------------------------------------------------------------------------------


def test_intents_bring_a_document_together_once(spark):
    """Of the rows by document only one shuffle, and none for related terms."""
    plan = catalogue.QUERIES["intent_doc_scores"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id#") == 1


@pytest.mark.parametrize("name", ["volume_over_time_clusters", "volume_subsets_all_clusters", "volume_subsets_clusters"])
def test_clusters_count_volume_once(spark, name):
    """What comes after the clusters reads the counts, not the lines again."""
    files = catalogue.QUERIES[name](spark, SMALL).inputFiles()
    assert files and not any("lineitem" in f for f in files)


# -- vectors ----------------------------------------------------------------------------------


def test_near_queries_hold_the_nearest(spark):
    """Equal vectors stay for the tie by id; few pairs besides the nearest go on; a missing vector is near nothing."""
    import numpy as np

    from corvida.functions import vectors as V

    x = np.random.default_rng(4).normal(size=(400, 8)).astype(np.float32)
    x[50:60] = x[0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, vector array<float>").repartition(3)
    queries = rows.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q"))
    got = V.near_queries(rows, queries, 10, block=2).select("query_id", "vec_id").collect()
    assert len(got) == len(set(got)) < 5 * 3 * 14
    for q in range(5):
        score = np.round(x.astype(float) @ x[q].astype(float), 5)
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:10]
        assert {(q, i) for i in best} <= {tuple(r) for r in got}
