"""Operator 11 against its SQL, by hand, and over small tables."""

from collections import Counter, defaultdict

import pytest
from comparing import of_duckdb, of_spark
from pyspark.sql import functions as F

from corvida.llm import mixing, queries
from corvida.session import stored

SCHEMA = "doc_id long, text string, source string, rank int, slot long, size double, block string, n long, place string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, 0.5, "b", 9, "p") for r in rows], SCHEMA)


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert of_spark(queries.op11_mixing(spark, sf)) == of_duckdb(queries.SQL["op11_mixing"], sf)


def test_ranks_of_points(spark):
    """The closed form against counting, for several intervals."""
    bits = 7
    point = [int(f"{i:07b}"[::-1], 2) for i in range(128)]
    for low, high in ((0, 128), (0, 1), (3, 90), (127, 128), (64, 64)):
        slots = spark.range(128).select("id", mixing.reversed_bits(F.col("id"), bits).alias("p"))
        got = slots.select("id", "p", mixing.earlier(F.col("p"), F.col("id"), F.lit(low).cast("long"), F.lit(high).cast("long"), bits).alias("n")).collect()
        assert {r["id"]: (r["p"], r["n"]) for r in got} == {i: (point[i], sum(low <= p < high for p in point[:i])) for i in range(128)}


def test_targets_by_hand(spark):
    # weights 3, 1, 2, 3: 1.5 * 1000 = 1500 over 9; a is over 2 * 100, then d over 2 * 200, and b and c share 900 by 1 and 2
    rows = [(1, "w " * 100, "a"), (2, "w " * 300, "b"), (3, "w " * 400, "c"), (4, "w " * 200, None)]
    got = {r["source"]: (r["weight"], r["target"]) for r in mixing.targets(mixing.sized(table(spark, rows))).collect()}
    assert got == {"a": (3, 200.0), "b": (1, 300.0), "c": (2, 600.0), None: (3, 400.0)}


@pytest.mark.parametrize("block", [7, 5000])
def test_mix_takes_what_it_should(spark, block):
    rows = [(i if i % 9 else None, " ".join(f"d{i}w{k}" for k in range(i * 7 % 83)), ["hot", "b", "", None][min(3, i % 6)]) for i in range(120)]
    rows += [(500, "a b c", "b")] * 3 + [(501, None, "b"), (502, "", "nothing"), (503, " \n", None), (504, " ".join(f"long{k}" for k in range(4000)), "hot")]
    docs = table(spark, rows).repartition(5)
    out = mixing.mix(docs, block=block).collect()
    sizes = stored(mixing.sized(docs), "sizes")
    goal = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    slots, by_source, words = defaultdict(int), Counter(), Counter()
    source = {w: s for _, t, s in rows for w in (t or "").split()}
    for r in out:
        assert len(r["words"]) == r["length"] > 0
        slots[r["slot"]] += r["length"]
        by_source[source[r["words"][0]]] += r["length"]
        words.update(r["words"])
    assert max(slots.values()) <= block
    assert {s: n for s, n in by_source.items()} == {s: int(t) for s, t in goal.items() if t >= 1}
    assert max(n for w, n in words.items() if w not in "abc") <= 2 and max(words[w] for w in "abc") <= 6
    per = mixing.taken(docs, block=block).collect()
    assert len(per) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in per)
    assert sorted((r["doc_id"] or 0, r["taken"]) for r in per) == sorted((r["doc_id"] or 0, r["taken"]) for r in mixing.taken(docs.repartition(3), block=block).collect())


def test_schedule_is_even(spark):
    rows = [(i, "w " * 50, "abc"[i % 3] if i % 2 else "a") for i in range(400)]
    sizes = mixing.sized(table(spark, rows))
    plan = mixing.schedule(stored(mixing.targets(sizes), "t"), block=32).orderBy("slot").collect()
    total, seen = Counter(r["rank"] for r in plan), Counter()
    assert [sorted(r["turn"] for r in plan if r["rank"] == k) for k in total] == [list(range(n)) for n in total.values()]
    for i, r in enumerate(plan[: int(len(plan) * 0.9)], 1):
        seen[r["rank"]] += 1
        assert all(abs(seen[k] - i * n / len(plan)) < 7 for k, n in total.items())


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "one", "a")], [(None, None, None), (None, "a b", "x"), (None, "a b", "x")]])
def test_few_rows(spark, rows):
    got = mixing.taken(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
