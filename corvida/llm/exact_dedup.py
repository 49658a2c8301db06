"""Exact deduplication against a history, by a minimal perfect hash over its distinct digests.

The index is cut into buckets by digest, small enough for one task each. A bucket holds a
minimal perfect hash: levels of bit arrays, where a digest that is alone at its place in a
level ends there and the others go on to the next; its slot is the number of set bits
before it. A slot keeps the whole digest, the doc_id of the winner (smallest doc_id so far)
and the size of its group. A perfect hash gives some slot for any digest, so a lookup counts
only when all 32 bytes in the slot are equal. Digests that are not members form groups of
their own.

Only one row for each distinct digest is ever looked up: copies are counted before the
shuffle, so a digest that a third of all rows share is one row for each task.

Cases: a null text counts as empty, and all empty texts are one group; texts that differ in
white space only are equal; a group in which no row has a doc_id has a null keep_id, and kept is null
for rows without a doc_id and true for each repetition of the winner's row, as in the SQL
(``deduplicate`` keeps one row of every group); an empty table gives no rows; further columns are ignored here
and kept by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import ROW, numbered, one_each
from corvida.llm.words import mix
from corvida.session import ready, stored

BUCKET = 50_000
BATCHES = 2
_GAMMA, _LEVELS = 2.0, 40
#: Stands for the winner of a group without any doc_id.
_NONE = 2**63 - 1
_INDEX = "bucket long, sizes array<int>, levels binary, digests binary, winners array<long>, counts array<long>"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each 32-byte digest."""
    parts = digests.view("<u8").reshape(-1, 4)
    return parts[:, 0], parts[:, 1]


def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(a + b * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)


def _as_array(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8)


class PerfectHash:
    """A minimal perfect hash over distinct 32-byte digests."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(bits)])

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        a, b = _halves(digests)
        sizes, levels = [], []
        while len(a):
            if len(sizes) == _LEVELS:
                raise ValueError("digests repeat")
            size = max(1, int(_GAMMA * len(a)))
            at = _places(a, b, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            a, b = a[~alone[at]], b[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.empty(0, bool))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of every digest; -1 for some that are not members, any slot for the others of them."""
        a, b = _halves(digests)
        out, left, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = base + _places(a[left], b[left], level, size)
            found = self.bits[at]
            out[left[found]] = self.before[at[found]]
            left, base = left[~found], base + size
        return out


def _index_bucket(bucket: int, digests: list[bytes], winners: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    raw = _as_array(digests)
    hashed = PerfectHash.build(raw)
    order = np.empty(len(digests), np.int64)
    order[hashed.slots(raw)] = np.arange(len(digests))
    return pd.DataFrame({
        "bucket": [bucket], "sizes": [hashed.sizes], "levels": [np.packbits(hashed.bits).tobytes()],
        "digests": [raw.reshape(-1, 32)[order].tobytes()], "winners": [winners[order]], "counts": [counts[order]],
    })


def _groups(rows: DataFrame) -> DataFrame:
    """A row for each distinct digest: digest, winner, n."""
    return rows.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(_NONE)).alias("winner"), F.count(F.lit(1)).alias("n"))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """The index of distinct digests (digest, winner, n): a row for each bucket."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return _index_bucket(int(pdf["bucket"].iloc[0]), list(pdf["digest"]), pdf["winner"].to_numpy(), pdf["n"].to_numpy())

    return _bucketed(groups, buckets).groupBy("bucket").applyInPandas(build, _INDEX)


def look_up(groups: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Every digest of a new batch and of the index: digest, keep_id, group_size, member (was in the index)."""

    def probe(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        raw = _as_array(new["digest"]) if len(new) else np.empty(0, np.uint8)
        winner, n = new["winner"].to_numpy(np.int64), new["n"].to_numpy(np.int64)
        if not len(old):
            return pd.DataFrame({"digest": new["digest"], "keep_id": winner, "group_size": n, "member": False})
        held = old.iloc[0]
        sizes = [int(x) for x in held["sizes"]]
        hashed = PerfectHash(sizes, np.unpackbits(np.frombuffer(held["levels"], np.uint8), count=sum(sizes)).astype(bool))
        slots_hold = np.frombuffer(held["digests"], np.uint8).reshape(-1, 32)
        winners, counts = np.array(held["winners"], np.int64), np.array(held["counts"], np.int64)
        slot = hashed.slots(raw)
        member = slot >= 0
        member[member] = (slots_hold[slot[member]] == raw.reshape(-1, 32)[member]).all(axis=1)
        # a slot's winner may change: the new batch can have a smaller doc_id
        winners[slot[member]] = np.minimum(winners[slot[member]], winner[member])
        counts[slot[member]] += n[member]
        return pd.DataFrame({
            "digest": [x.tobytes() for x in slots_hold] + [x for x, m in zip(new["digest"], member, strict=True) if not m],
            "keep_id": np.concatenate([winners, winner[~member]]), "group_size": np.concatenate([counts, n[~member]]),
            "member": np.concatenate([np.ones(len(winners), bool), np.zeros(int((~member).sum()), bool)]),
        })

    new = _bucketed(groups, buckets)
    return new.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(probe, "digest binary, keep_id long, group_size long, member boolean")


def exact_groups(docs: DataFrame, batches: int = BATCHES, bucket: int = BUCKET, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Takes the table in batches: the first builds the index, each further one is looked up in it
    and the index is built anew with what it brought. Returns a row for each document:
    doc_id, keep_id, group_size, kept, text_sha256."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256)).alias("digest"))
    # every row is in one of the batches, and every batch is processed
    rows = stored(rows.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "digests")
    buckets = max(1, -(-rows.count() // bucket))
    state = _groups(rows.where(F.col("batch") == 0))
    for b in range(1, batches):
        index = stored(build_index(state, buckets), "digest-index")
        found = look_up(_groups(rows.where(F.col("batch") == b)), index, buckets)
        state = found.select("digest", F.col("keep_id").alias("winner"), F.col("group_size").alias("n"))
    final = stored(state, "digest-groups")
    out = rows.join(final, "digest")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull() | (F.col("winner") < _NONE), F.col("winner")).alias("keep_id"), F.col("n").alias("group_size"), (F.col("doc_id") == F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents of which each group keeps one, that with the smallest doc_id, with all their columns.
    A repeated row is kept once; rows without a doc_id are documents like others and come last."""
    docs = numbered(docs)
    return one_each(docs, exact_groups(docs, doc_id=ROW, **options).select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group")))
