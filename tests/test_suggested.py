"""Clusters by key and outliers of lists against plain versions and values worked out by hand."""

import random

import numpy as np
from pyspark.sql import functions as F

from corvida.operators import clusters
from corvida.operators import concepts as C
from corvida.plans.suggested import outliers_of_lists

ROW = "k string, concept string, vector array<double>, weight double"


def plain_clusters(rows, k, nearest, rounds):
    rows = [(c, np.array(v) / np.linalg.norm(v), w or 0.0) for c, v, w in rows if c is not None and v is not None and np.linalg.norm(v) > 0]
    like = lambda v, c: round(float(v @ c / np.linalg.norm(c)), 9)
    centres = [(0, min(rows, key=lambda r: (-r[2], r[0]))[1])] if rows else []
    for i in range(1, k):
        far = [(max(like(v, c) for _, c in centres), name, v) for name, v, _ in rows]
        far = [x for x in far if x[0] < 1]
        if far:
            centres.append((i, min(far, key=lambda x: x[:2])[2]))
    place = lambda: [(min((-like(v, c), i) for i, c in centres), name, v) for name, v, _ in rows]
    for _ in range(rounds):
        placed = place()
        centres = [(i, np.mean([v for (_, j), _, v in placed if j == i], 0)) for i, _ in centres if any(j == i for (_, j), _, _ in placed)]
    out = []
    for i, _ in centres:
        members = sorted((s, name) for (s, j), name, _ in place() if j == i)[:nearest]
        out += [(i, members[0][1], n + 1, name, round(-s, 5)) for n, (s, name) in enumerate(members)]
    return sorted(out)


def test_clusters_as_of_a_plain_version(spark):
    rng = random.Random(3)
    rows = []
    for key, n in (("hot", 150), ("small", 5), ("one", 1)):
        for i in range(n):
            base = [0.0] * 6
            base[i % 6] = 3.0
            rows.append((key, f"c{i}", [b + rng.random() for b in base], float(rng.randrange(50))))
    rows += [("small", "twin", rows[150][2], 1.0), ("small", None, [1.0] * 6, 1.0), ("small", "null", None, 9.0), ("small", "zero", [0.0] * 6, 9.0), ("one", "weightless", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], None), (None, "keyless", [1.0] * 6, 1.0)]
    got = clusters.suggested(spark.createDataFrame(rows, ROW).repartition(6), ("k",))
    assert got.columns == ["k", "cluster", "cluster_label", "rank", "concept", "score"]
    found = {}
    for r in got.collect():
        found.setdefault(r["k"], []).append(tuple(r)[1:])
    assert set(found) == {"hot", "small", "one"}
    for key in found:
        assert sorted(found[key]) == plain_clusters([r[1:] for r in rows if r[0] == key], clusters.K, clusters.NEAREST, clusters.ROUNDS)


def test_clusters_planted_and_empty(spark):
    rows = [(None, f"{g}{i}", [float(g == "a"), float(g == "b"), i / 100], 1.0) for g in "ab" for i in range(5)]
    df = spark.createDataFrame(rows, ROW).drop("k")
    got = clusters.suggested(df, k=2, nearest=9).collect()
    assert sorted(sorted(r["concept"] for r in got if r["cluster"] == c) for c in (0, 1)) == [[f"{g}{i}" for i in range(5)] for g in "ab"]
    assert {r["cluster_label"] for r in got} == {"a2", "b2"}  # the middle ones
    assert clusters.suggested(df.limit(0)).count() == 0


def test_outside_by_hand(spark):
    found = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, "x", 0), (3, "y", 1), (4, "y", 1)], "doc_id long, concept string, exact int")
    listed = spark.createDataFrame([(1, "l", 1), (1, "l", 1), (3, "l", 0), (9, "l", 1)], "doc_id long, list string, exact int")
    names = spark.createDataFrame([("l",), ("l",), ("unmet",)], "list string")
    docs = spark.range(1, 6).withColumnRenamed("id", "doc_id")
    scope = docs.select("doc_id", F.lit("s").alias("k"))
    got = {(r["list"], r["concept"]): tuple(r)[3:] for r in C.outside(found, listed, names, scope, ("k",)).collect()}
    # l covers 1 and 3 of five documents
    assert got == {("l", "x"): (5, 3, 1, 1), ("l", "y"): (5, 3, 1, 1), ("unmet", "x"): (5, 5, 3, 2), ("unmet", "y"): (5, 5, 2, 2)}
    both = {(r["list"], r["concept"]): (r["filter_count"], r["coverage"]) for r in outliers_of_lists(found, listed, names, scope, docs, 5, ("k",)).collect()}
    exact = {(r["list"], r["concept"]): (r["filter_count"], r["coverage"]) for r in outliers_of_lists(found, listed, names, scope, docs, 5, ("k",), "exact").collect()}
    # both: x 1 of 3 and y 1 of 3 against 2 of 5 each: neither is more frequent. exact: only 1 is covered, y has 2 of 4 against 2 of 5
    assert both == {} and exact == {("l", "y"): (4, 20.0)}
    assert outliers_of_lists(found.limit(0), listed.limit(0), names, scope, docs, 5, ("k",)).count() == 0
