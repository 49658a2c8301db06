"""Packing documents into training sequences: best-fit decreasing.

A document longer than the window is first cut into full windows; each of those is a
sequence of its own. The remainders go, largest first, into the tightest open window they
fit: a segment tree over remaining capacities finds the smallest capacity that is not less
than the remainder, in log(window) steps. Remainders are dealt evenly to groups of bounded
size and each group packs for itself, so one task never holds more than a group, and the
only loss is the last few windows of a group.

Cases: a null or empty text is one piece with its end id; an empty table gives no rows;
equal documents and those without doc_id are packed each for itself; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.llm import tokens
from corvida.session import ready, stored

WINDOW = 2048
#: Remainders a task packs together; at some hundreds of ids each, a group's last windows are under 0.1 % of it.
GROUP = 20_000
_SPLIT = 1 << 32


class CapacityTree:
    """A segment tree with a leaf for each remaining capacity; a leaf is set while some open window has it."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        """Opens a window, or puts one back with what it has left."""
        self.open[capacity].append(window)
        i = capacity + self.leaves
        while i and not self.any[i]:
            self.any[i] = True
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The open window with the smallest capacity of at least ``least``, or None."""
        i = least + self.leaves
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            self.any[i] = False
            while i > 1 and not self.any[i ^ 1]:
                i >>= 1
                self.any[i] = False
        return capacity, window


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset there) of every length; lengths are 1 to ``window`` and come largest first."""
    tree, opened = CapacityTree(window), 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        found = tree.take(length)
        if found is None:
            found, opened = (window, opened), opened + 1
        bins[i], offsets[i] = found[1], window - found[0]
        if found[0] > length:
            tree.put(found[0] - length, found[1])
    return bins, offsets


def pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Cuts every document: doc_id, start, length, ids_crc32, doc_tokens."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, got, offsets in tokens.encoded(batches, vocabulary):
            out: list[tuple] = []
            for doc_id, a, b in zip(rows.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = np.append(got[a:b], end_id).astype("<u4")
                out += [(doc_id, s, min(window, len(ids) - s), zlib.crc32(ids[s : s + window].tobytes()), len(ids)) for s in range(0, len(ids), window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    return docs.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, window: int = WINDOW, group: int = GROUP, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ready(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = stored(pieces(source, vocabulary or tokens.vocabulary(), end_id, window), "pieces")
    rest = cut.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group))
    # a hash of the piece deals even one hot document's copies evenly; a group's number leads its sequence numbers
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))

    def fit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        length, grp = table["length"].to_numpy(), table["grp"].to_numpy()
        order = np.lexsort((table["doc_id"].fill_null(-1).to_numpy(), -length))
        bins, offsets = best_fit(length[order], window)
        return table.take(pa.array(order)).drop_columns("grp").append_column("sequence_id", pa.array((grp + 1) * _SPLIT + bins)).append_column("offset", pa.array(offsets))

    columns = [*cut.columns, "sequence_id", "offset"]
    packed = rest.groupBy("grp").applyInArrow(fit, ", ".join(f"{c} long" for c in columns))
    full = cut.where(F.col("length") == window)
    # full windows: numbers below zero can't meet those of the groups, and need no count over the rows
    full = full.withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.select(columns).unionByName(full.select(columns))
