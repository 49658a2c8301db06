"""Substring deduplication: repeated windows of 35 words, by a log-structured fingerprint index.

Fingerprints. A window of 35 words holds 25 runs of 11 words; the run with the smallest
hash is the window's fingerprint. Equal windows have equal fingerprints at equal places, and
neighbouring windows mostly share one, so about one position in thirteen enters the index.

Index. Each batch's fingerprints become an immutable run: a row for each hash with how often
it is there, in buckets by hash and sorted within them. Counting before the shuffle leaves one
row a task of a hash, however many documents have it. A new batch's run is merge-joined with
the older ones, bucket by bucket, without a shuffle; hashes met twice or more are candidates.
Once there are more runs than the fan-out, the two oldest are merged into one, again without a
shuffle. A manifest that is only appended to names the runs, so an index can be opened again
and go on with the next batch.

Places. The fingerprints of all documents are joined with the candidate hashes. The commonest
candidates (``HOT_HASHES`` at most, so they can be broadcast) are dealt by document over parts
of about ``PART`` places each.

Verification. For each document with a candidate its windows with candidate fingerprints are
hashed whole and dealt by fingerprint into bins. Two windows are equal if both 64-bit hashes
are, that of the fingerprint and that of the window: 128 bits, by which even 10^14 windows
have some two different ones taken for equal with a chance under 10^-10. Windows that repeat
within a task are settled there and send one entry, so a passage that a third of all documents
share costs each bin one entry a task.

Every word that a repeated window covers goes, in all documents that have it.

Cases: null and empty texts, and texts under 35 words, lose nothing; very long texts are
taken whole; a repeated row (same doc_id, same text) counts as another document and both lose
what they share; rows without a doc_id are told apart by their text; an empty table gives no
rows; other columns are ignored. A doc_id stands for one text: rows that share one must have
the same text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.llm import words
from corvida.llm.common import commonest
from corvida.session import ready, removed, scratch_path, stored

WINDOW, GRAM = 35, 11
BATCHES, FANOUT = 3, 2
#: Candidates whose places are dealt over several parts, and about how many places a part gets.
HOT_HASHES, PART = 100_000, 5_000
_PER = WINDOW - GRAM + 1
_NONE = np.uint64(2**64 - 1)
#: Candidate windows a task gathers before it sends them on.
_FLUSH = 400_000


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of ``width`` values, by doubling."""
    n, have, y = len(x) - width + 1, 1, x
    if n <= 0:
        return x[:0]
    while 2 * have <= width:
        y, have = op(y[:-have], y[have:]), 2 * have
    return op(y[:n], y[width - have : width - have + n]) if have < width else y[:n]


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of word hashes with rows that begin at ``first``: the hash of each run of 11 words, the
    fingerprint of each window (0 for windows that cross rows), and the row of each word."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), row
    grams = words.grams(hashes, GRAM)
    least = sliding(grams, _PER, np.minimum)
    least[row[:n] != row[WINDOW - 1 :]] = 0
    return grams, least, row


def anchors(docs: DataFrame) -> DataFrame:
    """The fingerprints of all windows of (doc_id, text): hash, doc_id, pos."""
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in words.pieces(batch):
                start, end, first = words.spans(data, offsets)
                grams, least, row = fingerprints(words.hashed(data, start, end), first)
                pad = np.zeros(_PER - 1, np.uint64)
                at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), _PER, np.maximum) == grams) if len(grams) else np.empty(0, np.int64)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), rows.column(0).take(pa.array(row[at])), pa.array((at - first[row[at]]).astype(np.int32))], schema=schema)

    return docs.mapInArrow(run, "hash long, doc_id long, pos int")


class FingerprintIndex:
    """Sorted immutable runs (hash, n) in a shared folder; given a folder that has a manifest, the index there goes on."""

    _MANIFEST = "version long, run string, buckets int"

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, path: str | None = None):
        self.spark, self.fanout, self.tables, self.compactions = spark, fanout, {}, 0
        self.path = path or scratch_path(spark, "fingerprints")
        # an empty append makes the folder, so that a new index reads like an old one
        spark.createDataFrame([], self._MANIFEST).write.mode("append").parquet(f"{self.path}/manifest")
        rows = spark.read.schema(self._MANIFEST).parquet(f"{self.path}/manifest").collect()  # a row for each run and version
        self.version = max((r["version"] for r in rows), default=0)
        now = sorted((r for r in rows if r["version"] == self.version), key=lambda r: r["run"])
        self.runs = [r["run"] for r in now]
        self.buckets = now[0]["buckets"] if now else int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _commit(self, runs: list[str]) -> None:
        self.version, self.runs = self.version + 1, runs
        rows = [(self.version, run, self.buckets) for run in runs]
        self.spark.createDataFrame(rows, self._MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _run(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = table = f"corvida_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} (hash BIGINT, n BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(self.tables[name])

    def _write(self, rows: DataFrame, name: str) -> str:
        self.tables[name] = table = f"corvida_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}")
        writer.bucketBy(self.buckets, "hash").sortBy("hash").saveAsTable(table)
        return name

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch; returns its hashes that are there twice or more by now, and how often (hash, n)."""
        name = f"run-{self.version + 1:012d}-{uuid.uuid4().hex[:8]}"
        self._write(anchors(docs).groupBy("hash").agg(F.count(F.lit(1)).alias("n")), name)
        met, n = self._run(name), F.col("n")
        for k, old in enumerate(self.runs):
            met = met.join(self._run(old).withColumnRenamed("n", f"n{k}"), "hash", "left")
            n = n + F.coalesce(f"n{k}", F.lit(0))
        found = stored(met.select("hash", n.alias("n")).where("n > 1"), "repeated")
        self._commit([*self.runs, name])
        if len(self.runs) > self.fanout:
            self.compact()
        return found

    def compact(self) -> None:
        """Merges the two oldest runs into one that takes their place."""
        old, new, *rest = self.runs
        both = self._run(old).join(self._run(new).withColumnRenamed("n", "m"), "hash", "outer")
        merged = self._write(both.select("hash", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")), f"{new}-{uuid.uuid4().hex[:8]}")
        self._commit([merged, *rest])
        self.compactions += 1
        for run in (old, new):
            self.spark.sql(f"DROP TABLE {self.tables.pop(run)}")
        removed(self.spark, f"{self.path}/{old}", f"{self.path}/{new}")

    def close(self) -> None:
        """Takes the names of the runs out of the session's catalog; the files stay."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE {table}")
        self.tables = {}


def places(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The places (doc_id, at: positions) of the candidate hashes (hash, n) in docs. Those of a hot hash are dealt over parts."""
    hot = commonest(repeated.where(F.col("n") > PART), "n", HOT_HASHES).select("hash", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    hot = F.broadcast(hot)
    one = F.coalesce("parts", F.lit(1))
    found = anchors(docs).join(hot, "hash", "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), one).cast("int")).drop("parts")
    wanted = repeated.join(hot, "hash", "left").select("hash", F.explode(F.sequence(F.lit(0), one - 1)).alias("part"))
    return found.join(wanted, ["hash", "part"]).groupBy("doc_id").agg(F.collect_list("pos").alias("at"))


def _merged(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (doc, start) as runs of neighbours: doc, start, length."""
    if not len(doc):
        return doc, start, start
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)]))
    stop = np.concatenate([begin[1:], [len(doc)]]) - 1
    return doc[begin], start[begin], start[stop] - start[begin] + 1


def _repeated(key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does another one have the same key and mark; is it the first of them."""
    order = np.argsort(key, kind="stable")
    k, m = key[order], mark[order]
    same = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
    again, lead = np.zeros(len(key), bool), np.ones(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    lead[order[1:][same]] = False
    return again, lead


_BLOCK = "bin int, known boolean, doc binary, start binary, mark binary, key binary"


def _entries(joined: DataFrame, bins: int) -> DataFrame:
    """The candidate windows of (doc_id, text, at: candidate positions), packed into a block for each bin and task."""
    schema = pa.schema([("bin", pa.int32()), ("known", pa.bool_()), *[(c, pa.binary()) for c in ("doc", "start", "mark", "key")]])

    def block(b: int, known: bool, *arrays: np.ndarray) -> list:
        return [b, known, *(x.tobytes() for x in arrays)]

    def flushed(parts: list[tuple]) -> pa.RecordBatch:
        doc, start, mark, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        again, lead = _repeated(key, mark)
        out = []
        where = (mark % np.uint64(bins)).astype(np.int32)
        d, s, n = _merged(doc[again], start[again])
        home = (words.mix(d.view(np.uint64)) % np.uint64(bins)).astype(np.int32)
        for ok, b_of, arrays in ((np.ones(len(d), bool), home, (d, s, n.astype(np.uint64))), (lead, where, (doc, start, mark, key))):
            at = np.flatnonzero(ok)
            at = at[np.argsort(b_of[at], kind="stable")]
            cuts = np.searchsorted(b_of[at], np.arange(bins + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                i = at[cuts[b] : cuts[b + 1]]
                known = len(arrays) == 3
                out.append(block(b, known, *(x[i] for x in arrays), *([np.empty(0, np.uint64)] * known)))
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        c = words.mix(np.arange(91, 96, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for rows, data, offsets in words.pieces(batch):
                begin, end, first = words.spans(data, offsets)
                grams, least, row = fingerprints(words.hashed(data, begin, end), first)
                if not len(least):
                    continue
                at = rows.column(2)
                n_at = np.diff(at.offsets.to_numpy())
                pos = at.flatten().to_numpy() + np.repeat(first[:-1], n_at)
                pos = pos[pos + GRAM <= np.repeat(first[1:], n_at)]
                wanted = np.full(len(grams), _NONE)
                wanted[pos] = grams[pos]
                s = np.flatnonzero((sliding(wanted, _PER, np.minimum) == least) & (least > 0))
                whole = words.mix(grams[s] * c[0] + grams[s + GRAM] * c[1] + grams[s + 2 * GRAM] * c[2] + grams[s + WINDOW - GRAM] * c[3] + least[s] * c[4])
                parts.append((rows.column(0).to_numpy()[row[s]], (s - first[row[s]]).astype(np.int32), least[s], whole))
                held += len(s)
                if held >= _FLUSH:
                    yield flushed(parts)
                    parts, held = [], 0
        if held:
            yield flushed(parts)

    return joined.mapInArrow(run, _BLOCK)


def _settled(blocks: DataFrame) -> DataFrame:
    """The repeated windows of all blocks as runs: doc_id, start, length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        def joined(rows: pd.DataFrame, column: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(rows[column]), kind)

        known, open_ = pdf[pdf["known"]], pdf[~pdf["known"]]
        doc, start, mark, key = (joined(open_, c, k) for c, k in (("doc", np.int64), ("start", np.int32), ("mark", np.uint64), ("key", np.uint64)))
        again, _ = _repeated(key, mark)
        d, s, n = _merged(doc[again], start[again])
        return pd.DataFrame({
            "doc_id": np.concatenate([d, joined(known, "doc", np.int64)]),
            "start": np.concatenate([s, joined(known, "start", np.int32)]).astype(np.int32),
            "length": np.concatenate([n, joined(known, "mark", np.uint64).astype(np.int64)]).astype(np.int32),
        })

    return blocks.groupBy("bin").applyInPandas(run, "doc_id long, start int, length int")


def _cut(joined: DataFrame, with_text: bool) -> DataFrame:
    """Takes the covered words out of (doc_id, text, cuts: array of (start, length))."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, ("kept_text", pa.string())] if with_text else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in words.pieces(batch):
                out = []
                cuts = rows.column(2).to_pylist()
                for i, (doc_id, cut) in enumerate(zip(rows.column(0).to_pylist(), cuts, strict=True)):
                    all_words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    n, kept = len(all_words), all_words
                    if cut:
                        at = np.array([(c["start"], c["start"] + c["length"] + WINDOW - 1) for c in cut])
                        step = np.bincount(at[:, 0], minlength=n + 1)[: n + 1] - np.bincount(at[:, 1], minlength=n + 1)[: n + 1]
                        kept = [all_words[k] for k in np.flatnonzero(np.cumsum(step)[:n] == 0).tolist()]
                    text = b" ".join(kept)
                    out.append((doc_id, n, n - len(kept), hashlib.sha256(text).hexdigest(), *([text.decode("utf-8", "replace")] * with_text)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def remove_repeats(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, with_text: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for."""
    spark = ready(docs.sparkSession)
    named = F.col(doc_id).cast("long")
    docs = docs.select(F.coalesce(named, F.xxhash64(text)).alias("doc_id"), F.col(text).alias("text"), named.isNull().alias("unnamed"))
    index, repeated = FingerprintIndex(spark, fanout), None
    for b in range(batches):  # every document is in one of the batches
        found = index.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
        repeated = found if repeated is None else repeated.union(found)
    index.close()
    # the last batch that has a hash knows how often all have it
    hits = places(docs, stored(repeated.groupBy("hash").agg(F.max("n").alias("n")), "repeated"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartition(n, "doc_id")  # both joins below read this one exchange
    blocks = _entries(dealt.join(hits, "doc_id").select("doc_id", "text", "at"), 2 * n)
    cuts = _settled(blocks).groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("cuts"))
    return _cut(dealt.join(cuts, "doc_id", "left").select(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "text", "cuts"), with_text)
