"""Operators against plain Python on small fixtures."""

import random
from pathlib import Path
from urllib.parse import urlparse

from corvida.operators.components import connected_components, roots
from corvida.session import shared_dir


def _components(edges):
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        of[y] = x
    return {x: find(x) for x in of}


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (3, 4), (3, 4)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in _components([e for e in edges if e[0] != e[1]]).items()}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_take_no_round(spark):
    """Edges that tie every node to the smallest of its component are the result; a chain takes rounds."""
    folder = Path(urlparse(shared_dir(spark)).path, "corvida")
    before = set(folder.glob("least-*"))
    edges = [(1, i) for i in range(2, 50)] + [(i, 60) for i in range(61, 70)] + [(5, 1)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == _components(edges) and not set(folder.glob("least-*")) - before
    chain = [(i, i + 1) for i in range(20)]
    assert set(_components(chain).values()) == {r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(folder.glob("least-*")) - before


def test_roots(spark):
    parents = [(i, i - 1) for i in range(1, 30)] + [(51, 50), (52, 50)]
    got = {r["node"]: r["component"] for r in roots(spark.createDataFrame(parents, "node long, parent long")).collect()}
    assert got == {**{i: 0 for i in range(30)}, 50: 50, 51: 50, 52: 50}
