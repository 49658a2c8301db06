"""Operator 13 against its SQL and a plain version with whole numbers of any size."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from comparing import of_duckdb, of_spark

from corvida.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, number int, value string, size double, v long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, "x", 0.5, 3) for r in rows], SCHEMA)


def audited(rows, least=3, top=200):
    n, seen, groups = defaultdict(Counter), defaultdict(set), defaultdict(set)
    for i, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            n[lang, source][t] += 1
            seen[lang, t].add(i)
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), docs in seen.items() if x == lang and len(docs) >= least]
        def p(count, total):
            return 1 + 10**9 * (count + 1) // (total + len(kept))
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        whole = sum(total.values())
        for s in sources:
            found = []
            for o in sources - {s}:
                values = [(p(n[lang, s][t], total[s]), p(n[lang, o][t], total[o])) for t in kept]
                found.append((o, sum((a - b) ** 2 // b for a, b in values)))
            terms = []
            for t in kept:
                a, b = p(n[lang, s][t], total[s]), p(sum(n[lang, x][t] for x in sources), whole)
                if n[lang, s][t] and a > b:
                    terms.append((t, (a - b) ** 2 // b))
            for part, items in (("pair", found), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, k) for k, (t, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def some():
    rng = random.Random(8)
    terms = [f"{a}{b}{c}" for a in "abcdefghij" for b in "lmnopqrstu" for c in ("", "é", "中")]
    rows = []
    for i in range(300):
        source = rng.choice(["hot", "hot", "hot", "web", "news", None, "x", "y", "z", "w"])
        text = " ".join(rng.choice(terms[: 40 + 20 * (i % 13)]) for _ in range(rng.randrange(60)))
        rows.append((i if i % 7 else None, text.upper() if i % 5 == 0 else text + "1'2-3", rng.choice(["en", "de", None]), source))
    return rows + [(1, None, "en", "empty"), (2, "", "fr", "alone"), (3, " \x00 12 ", "fr", "other"), (4, "once", "fr", "other"), (5, "same same", "en", "copies")] + [(5, "same same", "en", "copies")] * 4


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert of_spark(queries.op13_divergence(spark, sf)) == of_duckdb(queries.SQL["op13_divergence"], sf)


@pytest.mark.parametrize("cost, light, side", [(16, 64, 128), (0, 64, 128), (10**6, 64, 3), (1, 2, 2), (1, 3, 4)])
def test_plain_version(spark, cost, light, side):
    """All terms light, all heavy, some of each; one block of groups and several."""
    rows = some()
    assert rows_of(divergence.audit(table(spark, rows).repartition(3), cost=cost, light=light, side=side)) == audited(rows)


def test_shares_of_large_numbers(spark):
    for n, total in ((10**15 - 3, 10**15), (0, 9 * 10**15), (123456789012345, 987654321098765), (0, 1), (5, 7)):
        want = 1 + 10**9 * (n + 1) // total
        assert spark.sql(f"select {divergence.share(f'{n}L', f'{total}L')} as p").first()[0] == want
        assert divergence._share(np.array([n]), np.array([total]))[0] == want


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "a a a", "en", "s"), (2, "b", "en", "t")], [(None, "a b", "en", "s")] * 3])
def test_few_rows(spark, rows):
    assert rows_of(divergence.audit(table(spark, rows))) == audited(rows)
