"""Vectors as arrays, positions kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def centroids(rows: DataFrame, keys: list[str], vector: str = "vector", weight: Column | None = None) -> DataFrame:
    """keys..., n, centroid: the (weighted) mean at each position."""
    weight = F.lit(1.0) if weight is None else weight
    flat = rows.select(*keys, weight.alias("w"), F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    mean = flat.groupBy(*keys, "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), F.count(F.lit(1)).alias("n"))
    return mean.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / norm(a))


def near_queries(rows: DataFrame, queries: DataFrame, n: int, margin: float = 2e-5, block: int = 512) -> DataFrame:
    """query_id, q, vec_id, vector: of (vec_id, vector) and (query_id, q), float vectors of one size and about unit length, pairs that hold for
    each query its n nearest others by rounded dot product, and some more. Queries are broadcast, products are of matrices;
    of what a task has seen only pairs within the margin of a query's n-th best go on."""
    found = queries.where("q is not null").toArrow()
    ids = found.column("query_id").to_numpy()
    q = np.stack(found.column("q").to_numpy()).astype(np.float32) if len(ids) else np.zeros((0, 1), np.float32)
    sent = rows.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        best = np.full((len(ids), n), -np.inf, np.float32)
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            vec, x = batch.column("vec_id").to_numpy(), np.stack(batch.column("vector").to_numpy(zero_copy_only=False)).astype(np.float32)
            for i in range(0, len(ids), block):
                part = slice(i, i + block)
                score = q[part] @ x.T
                score[ids[part][:, None] == vec[None, :]] = -np.inf
                top = -np.partition(-score, min(n, score.shape[1]) - 1, axis=1)[:, :n]
                best[part] = -np.partition(-np.concatenate([best[part], top], axis=1), n - 1, axis=1)[:, :n]
                a, b = np.nonzero((score >= best[part].min(axis=1)[:, None] - margin) & (score > -np.inf))
                for k in range(0, len(a), 10_000):
                    c, d = a[k : k + 10_000], b[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part][c]), pa.array(list(q[part][c]), pa.list_(pa.float32())), pa.array(vec[d]), batch.column("vector").take(pa.array(d))], ["query_id", "q", "vec_id", "vector"])

    return rows.where("vector is not null").select("vec_id", "vector").mapInArrow(run, "query_id long, q array<float>, vec_id long, vector array<float>")
