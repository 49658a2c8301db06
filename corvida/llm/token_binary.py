"""Token ids in binary files: patched frame-of-reference blocks.

File layout (little endian): magic ``PFR1``, u32 documents, u64 ids, u32 blocks, u32 ids a
block; then i64 doc_id and u32 id count of each document; then u64 start of each block,
counted from the first block; then the blocks. A block is u32 minimum, u8 width, u16 number
of exceptions; the ids less the minimum, packed at ``width`` bits (an exception packs as
zero); then u16 position and u32 value of each exception. The width is the smallest that a
set share of the block's ids fit into, so a few large ids don't widen the whole block.

A document without doc_id has ``NO_ID`` in the file; such documents come first.

Cases: a null text counts as empty, an empty text has the end id alone; an empty table
gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvida.llm import tokens
from corvida.llm.common import qualified
from corvida.session import ready, scratch_path

MAGIC = b"PFR1"
BLOCK = 1024
PERCENTILE = 0.95
#: Ids after which a file ends, so that no task holds more than a file and a batch.
FILE_IDS = 8_000_000
#: Files up to which their first positions (some 40 bytes each) are broadcast.
BROADCAST_FILES = 200_000
#: Stands for null; a doc_id of this value is refused.
NO_ID = -(1 << 63)
_HEAD = struct.Struct("<4sIQII")


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after another."""
    if not width:
        return b""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """The n values that ``pack`` put into data."""
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of at most 65,536 ids."""
    low = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(low)
    at = min(len(rest) - 1, int(percentile * len(rest)))
    width = int(np.partition(rest, at)[at]).bit_length()
    odd = np.flatnonzero(rest >> np.uint64(width)) if width < 32 else np.empty(0, np.int64)
    packed = rest.copy()
    packed[odd] = 0
    return struct.pack("<IBH", low, width, len(odd)) + pack(packed, width) + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()


def decode_block(data: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block that begins where data does."""
    low, width, odd = struct.unpack("<IBH", data[:7].tobytes())
    size = (n * width + 7) // 8
    out = unpack(data[7 : 7 + size], n, width)
    at = np.frombuffer(data[7 + size : 7 + size + 2 * odd].tobytes(), "<u2")
    out[at] = np.frombuffer(data[7 + size + 2 * odd : 7 + size + 6 * odd].tobytes(), "<u4")
    return out + np.uint32(low)


def encode_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A whole file: some documents and their ids, one after another."""
    blocks = [encode_block(ids[i : i + block]) for i in range(0, len(ids), block)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.empty(0)
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(blocks), block)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), *blocks])


class TokenFile:
    """Reads a file's documents; ``ids`` reads any run of ids through the index of block starts."""

    def __init__(self, content: bytes):
        magic, docs, self.total, blocks, self.block = _HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(content, "<i8", docs, at)
        self.counts = np.frombuffer(content, "<u4", docs, at + 8 * docs).astype(np.int64)
        self.starts = np.frombuffer(content, "<u8", blocks, at + 12 * docs).astype(np.int64)
        self.data = np.frombuffer(content, np.uint8, offset=at + 12 * docs + 8 * blocks)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop, both counted in this file."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = [decode_block(self.data[self.starts[b] :], min(self.block, self.total - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, ids before it in this file, its ids); decodes a bounded number of blocks at a time."""
        stop, at = np.cumsum(self.counts), 0
        while at < len(stop):
            start = int(stop[at] - self.counts[at])
            to = max(at + 1, int(np.searchsorted(stop, start + 512 * self.block, "right")))
            ids = self.ids(start, int(stop[to - 1]))
            for i in range(at, to):
                begin = int(stop[i] - self.counts[i])
                yield int(self.doc_ids[i]), begin, ids[begin - start : int(stop[i]) - start]
            at = to


def _put(path: str, content: bytes) -> None:
    """Writes a file in one step: a task that is lost or runs twice leaves no half-written file."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    temporary = f"{name}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(temporary) as out:
        out.write(content)
    where.move(temporary, name)


def write_token_files(docs: DataFrame, folder: str, end_id: int, vocabulary: str, *, text: str = "text", doc_id: str = "doc_id", partitions: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes every document's ids and an end id in ascending doc_id order. Each range of doc_ids
    is cut into files of about ``file_ids`` ids; a document stays whole. Returns a row for each
    file: part and number (their order), n_docs, n_tokens, n_bytes, path."""
    spark = ready(docs.sparkSession)
    folder = qualified(spark, folder)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ranged = ranged.select("doc_id", "text", F.spark_partition_id().alias("part"))

    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("path", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, doc_ids, counts, ids = None, 0, 0, [], [], []

        def put() -> pa.RecordBatch:
            content = encode_file(*map(np.concatenate, (doc_ids, counts, ids)))
            path = f"{folder}/part-{part:08d}-{number:08d}.pfr"
            _put(path, content)
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "n_docs": [sum(map(len, doc_ids))], "n_tokens": [held], "n_bytes": [len(content)], "path": [path]}, schema=schema)

        for rows, got, offsets in tokens.encoded(batches, vocabulary):
            part = rows.column(2)[0].as_py()
            own = rows.column(0)
            if own.null_count and NO_ID in own.to_pylist() or not own.null_count and (own.to_numpy() == NO_ID).any():
                raise ValueError(f"{NO_ID} is no doc_id of a token file")
            doc_ids.append(own.fill_null(NO_ID).to_numpy())
            counts.append(np.diff(offsets) + 1)
            ids.append(np.insert(got, offsets[1:], end_id).astype(np.uint32))
            held += len(ids[-1])
            if held >= file_ids:
                yield put()
                number, held, doc_ids, counts, ids = number + 1, 0, [], [], []
        if doc_ids:
            yield put()

    made = ranged.mapInArrow(write, "part int, number int, n_docs long, n_tokens long, n_bytes long, path string")
    manifest = f"{folder}/manifest"
    made.write.parquet(manifest)
    return spark.read.schema(made.schema).parquet(manifest)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads the files back, a row for each document: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    # a row for each file of millions of ids: the sum over the files before is small work
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select("part", "number", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfr").load(folder)
    name = r"part-(\d+)-(\d+)\.pfr$"
    files = files.select(F.regexp_extract("path", name, 1).cast("int").alias("part"), F.regexp_extract("path", name, 2).cast("int").alias("number"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = [(part, number, None if i == NO_ID else i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, start, ids in TokenFile(content.as_py()).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.int64()] * 4), strict=True)], names=["part", "number", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(read, "part int, number int, doc_id long, at long, n_tokens long, ids_crc32 long")
    if manifest.count() <= BROADCAST_FILES:
        base = F.broadcast(base)
    return rows.join(base, ["part", "number"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, end_id: int = 2, vocabulary: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes token files in ``folder`` (else in the shared scratch folder) and returns what they hold."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, end_id, vocabulary or tokens.vocabulary()), folder)
