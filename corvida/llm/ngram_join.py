"""Similarity join on sets of 5-word shingles: links of Jaccard 0.75 or more and their components.

Prefixes. All shingles have one global order: rare ones by their hash, then frequent ones by
estimated frequency. A set of n shingles that links with another shares at least
o = ceil(0.75 n) with it, so the first n - o + l shingles of both share l or more. Each
document chooses its own l: a longer prefix reads more postings but asks for more shared
shingles, so it pays where the estimated number of candidates is high. A pair of documents
must share as many prefix shingles as the smaller of their l.

Estimates come from all documents: each task counts the shingles of its distinct sets, and the
counts of all tasks are added up by bin, four bytes a shingle. Those in more sets than a short
posting holds go, the commonest first, into a table of ``SLOTS`` bytes that every task gets; it
orders prefixes and never drops a shingle.

Equal sets have equal signatures (64-bit sums of their hashes); postings name signatures, so
copies meet as one and no text is shuffled to leave them out. Postings of up to
``PAIRS_UP_TO`` documents give their pairs; a pair counts if it shares as many as it must
(those it may share in longer postings included) and, at its first shared shingle, enough of
both sets is left to reach the overlap it needs. A longer posting gives the pairs that first
meet there. A few rounds of ties come first: each round compares all documents of a posting
with one of them, another one each time, and joins the components of those that link. Pairs
are made only for documents that the ties leave in different components, block by block. So a
group of near copies costs its size, not its square, and no link between components is lost.
Every candidate is verified on the whole sets.

Bins hold the shingles of a bounded amount of text: there are as many as the texts' bytes ask
for, and a shingle of very many documents is dealt by document over all of them.

Cases: texts without words (null, empty, white space) have an empty set and no link; with
one to four words the whole sequence is the one shingle; an empty table gives no rows;
repeated rows are equal sets; other columns are ignored here and kept by ``deduplicate``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm import words
from corvida.llm.common import ROW, commonest, numbered, one_each
from corvida.operators.components import connected_components, roots
from corvida.session import ready, removed, stored, written

SHINGLE = 5
#: The similarity, as a fraction of whole numbers.
NUMERATOR, DENOMINATOR = 3, 4
#: Bytes of the table of frequent shingles, a power of two.
SLOTS = 1 << 24
PAIRS_UP_TO = 4
#: Rounds of ties in longer postings; what they leave apart is compared pair by pair.
TIES = 3
MOST_SHARED = 8
#: Candidates up to which their ids (16 bytes each) are broadcast to pick out their texts.
BROADCAST_IDS = 2_000_000
#: Text whose shingles one bin gets, and sets from which on a shingle is dealt over many bins.
BIN_BYTES, HOT = 128_000_000, 2_000
#: Documents of a posting's size class that are compared in one block.
BLOCK = 500
_COUNTED = 3_000_000
#: Other documents taken to have a shingle that isn't in the table.
_RARE = 0.1
_FLUSH = 1_500_000
_LOW = np.uint64(0xFFFFFFFF)
#: Sets by level of the table.
_SETS = np.concatenate([[_RARE], 2 ** (np.arange(1, 256) / 4)])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for rows, data, offsets in words.pieces(batch):
            start, end, first = words.spans(data, offsets)
            yield rows, list(words.gram_sets(words.hashed(data, start, end, lower=True), first, SHINGLE))


def _signed(sets: list[np.ndarray]) -> np.ndarray:
    """The signature of each set: the sum of its hashes."""
    return np.array([int(s.sum()) & 0xFFFFFFFFFFFFFFFF for s in sets], np.uint64).view(np.int64)


def number_of_bins(docs: DataFrame) -> int:
    """Bins for the shingles of all texts, so that each gets those of about ``BIN_BYTES`` of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BIN_BYTES))


def _keys(shingles: np.ndarray, bins: int) -> np.ndarray:
    """A shingle's bin and, in the low half, its low 32 bits."""
    return ((shingles >> np.uint64(32)) % np.uint64(bins)) << np.uint64(32) | shingles & _LOW


def _cuts(bin_of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bin, begin, end) of each bin in a sorted column of bins."""
    at = np.flatnonzero(np.concatenate([[True], bin_of[1:] != bin_of[:-1]])) if len(bin_of) else np.empty(0, np.int64)
    return zip(bin_of[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bin_of)], strict=True)


def _signatures(docs: DataFrame, bins: int) -> DataFrame:
    """kind 0: a row for each document (id, n, two hashes of the whole set); kind 1: the shingles
    of a task by bin (id): their low 32 bits, those met once and those met again with how often."""
    fields = [("kind", pa.int32()), *((c, pa.int64()) for c in ("id", "n", "s1", "s2")), *((c, pa.binary()) for c in ("once", "again", "times"))]
    schema = pa.schema(fields)

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(_keys(np.concatenate(parts), bins))
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        x, times = x[at], np.diff(np.append(at, len(x))).astype(np.uint32)
        low, more, out = x.astype(np.uint32), times > 1, []
        for b, i, j in _cuts((x >> np.uint64(32)).astype(np.int64)):
            some = more[i:j]
            out.append((1, b, 0, 0, 0, low[i:j][~some].tobytes(), low[i:j][some].tobytes(), times[i:j][some].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, done = [], 0, set()
        for rows, sets in _sets(batches):
            n = np.array([len(s) for s in sets], np.int64)
            s1 = _signed(sets)
            s2 = np.array([int(words.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()) & 0xFFFFFFFFFFFFFFFF for s in sets], np.uint64)
            none = pa.array([None] * len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), rows.column(0), pa.array(n), pa.array(s1), pa.array(s2.view(np.int64)), none, none, none], schema=schema)
            for signature, s in zip(s1.tolist(), sets, strict=True):
                if len(s) and signature not in done:
                    done.add(signature)
                    parts.append(s)
                    held += len(s)
            if held >= _COUNTED:
                yield counted(parts)
                parts, held, done = [], 0, set()
        if held:
            yield counted(parts)

    return docs.mapInArrow(run, "kind int, id long, n long, s1 long, s2 long, once binary, again binary, times binary")


def _runs(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and how often each is there, or the sum of its n."""
    if n is None:
        x = np.sort(x)
    else:
        order = np.argsort(x)
        x, n = x[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(np.append(at, len(x))) if n is None else np.add.reduceat(n, at, dtype=np.int64) if len(x) else n.astype(np.int64)


def _frequencies(blocks: DataFrame) -> DataFrame:
    """slot (of the table of frequencies) and n (distinct sets that have it, those of several
    tasks added up) of every shingle in more sets than a short posting holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        once, again, times = (np.frombuffer(b"".join(pdf[c]), np.uint32) for c in ("once", "again", "times"))
        x, n = _runs(once)
        y, m = _runs(again, times)
        at = np.searchsorted(x, y)
        both = np.append(x, [0]).take(at) == y
        both &= at < len(x)
        n[at[both]] += m[both]
        x, n = np.concatenate([x, y[~both]]), np.concatenate([n, m[~both]])
        keep = n > PAIRS_UP_TO
        return pd.DataFrame({"slot": _slots(np.uint64(pdf["id"].iloc[0]) << np.uint64(32) | x[keep].astype(np.uint64)), "n": n[keep]})

    return blocks.select("id", "once", "again", "times").groupBy("id").applyInPandas(run, "slot int, n long")


def _slots(keys: np.ndarray) -> np.ndarray:
    return (words.mix(keys) & np.uint64(SLOTS - 1)).astype(np.int32)


def _table(frequencies: DataFrame) -> np.ndarray:
    """A byte for each slot: 0 for shingles that aren't frequent, else about 4 log2 of the number
    of sets. The commonest shingles that fill a quarter of the slots at most are in."""
    bits = 16
    counted = commonest(frequencies, "n", SLOTS // 4)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(1 << bits, np.uint8)
        np.maximum.at(part, pdf["slot"].to_numpy() & ((1 << bits) - 1), (4 * np.log2(pdf["n"].to_numpy())).astype(np.uint8))
        return pd.DataFrame({"part": [int(pdf["slot"].iloc[0]) >> bits], "bytes": [zlib.compress(part.tobytes(), 1)]})

    out = np.zeros((SLOTS >> bits, 1 << bits), np.uint8)
    parts = counted.withColumn("part", F.shiftright("slot", bits)).groupBy("part").applyInPandas(run, "part int, bytes binary")
    for row in parts.collect():  # SLOTS bytes in all before they are packed
        out[row["part"]] = np.frombuffer(zlib.decompress(row["bytes"]), np.uint8)
    return out.ravel()


def chosen_prefix(n: int, est: np.ndarray) -> tuple[int, int]:
    """(prefix length, shared shingles asked for) of a set of n shingles whose estimated
    frequencies, in the global order, are ``est``."""
    needed = -(-NUMERATOR * n // DENOMINATOR)
    most = min(MOST_SHARED, needed)
    reach = np.cumsum(est[: n - needed + most])[n - needed :]  # others met with l = 1, 2, ...
    shared = np.arange(1, most + 1)
    best = int(np.argmin(shared + reach + reach / shared * (n / 8)))
    return n - needed + best + 1, best + 1


def in_order(s: np.ndarray, table: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """A sorted set in the global order, and the estimated number of sets that have each shingle."""
    level = table[_slots(_keys(s, bins))]
    order = np.argsort(level, kind="stable")
    return s[order], _SETS[level[order]]


def _postings(docs: DataFrame, table: Broadcast, bins: int) -> DataFrame:
    """The prefix shingles of all distinct sets, packed into a block for each bin and task. Hot
    shingles are dealt by document over further bins, so none of them gathers in one."""
    schema = pa.schema([("bin", pa.int64()), *((c, pa.binary()) for c in ("token", "doc", "n", "asks", "rest"))])
    kind = np.min_scalar_type(2 * bins)  # numpy sorts small numbers by their digits

    def flushed(parts: list[tuple]) -> pa.RecordBatch:
        size = np.array([len(p[0]) for p in parts])
        token, hot = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        doc, n, asks = (np.repeat(np.array([p[k] for p in parts], t), size) for k, t in ((2, np.int64), (3, np.int32), (4, np.uint8)))
        rest = np.concatenate([p[3] - 1 - np.arange(len(p[0]), dtype=np.int32) for p in parts]).astype(np.int32)
        bin_of = ((token >> np.uint64(32)) % np.uint64(bins)).astype(kind)
        bin_of[hot] = words.mix(token[hot] ^ words.mix(doc[hot].view(np.uint64))) % np.uint64(bins) + np.uint64(bins)
        order = np.argsort(bin_of, kind="stable")
        columns = [c[order] for c in (token, doc, n, asks, rest)]
        out = [(b, *(c[i:j].tobytes() for c in columns)) for b, i, j in _cuts(bin_of[order])]
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, done = [], 0, set()
        for _, sets in _sets(batches):
            for signature, s in zip(_signed(sets).tolist(), sets, strict=True):
                if not len(s) or signature in done:
                    continue
                done.add(signature)
                ordered, est = in_order(s, table.value, bins)
                length, asks = chosen_prefix(len(s), est)
                parts.append((ordered[:length], est[:length] >= HOT, signature, len(s), asks))
                held += length
            if held >= _FLUSH:
                yield flushed(parts)
                parts, held, done = [], 0, set()
        if held:
            yield flushed(parts)

    return docs.mapInArrow(run, "bin long, token binary, doc binary, n binary, asks binary, rest binary")


def _reaches(n_x, n_y, rest_x, rest_y) -> np.ndarray:
    """Whether sets whose first shared shingle has so many after it can overlap enough."""
    return (NUMERATOR + DENOMINATOR) * (1 + np.minimum(rest_x, rest_y).astype(np.int64)) >= NUMERATOR * (n_x.astype(np.int64) + n_y)


def _pairs_within(token: np.ndarray, doc: np.ndarray, n: np.ndarray, asks: np.ndarray, rest: np.ndarray, short: int) -> tuple[list, list]:
    """Pairs (a, b, shared, asked, reaches) of the postings of up to ``short`` documents, and the
    rows of the longer ones as (token, doc, n, rest)."""
    order = np.lexsort((doc, token))
    order = order[np.concatenate([[True], (token[order][1:] != token[order][:-1]) | (doc[order][1:] != doc[order][:-1])])] if len(order) else order
    token, doc, n, asks, rest = (x[order] for x in (token, doc, n, asks, rest))
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
    size = np.diff(np.append(begin, len(token)))
    first, second = [], []
    for k in np.unique(size[(size > 1) & (size <= short)]).tolist():
        at = begin[size == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, 2_000_000 // len(i))
        for c in range(0, len(at), step):
            x, y = (at[c : c + step, None] + i).ravel(), (at[c : c + step, None] + j).ravel()
            small, large = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y]).astype(np.int64)
            fits = DENOMINATOR * small >= NUMERATOR * large
            first.append(x[fits])
            second.append(y[fits])
    i = np.flatnonzero(np.repeat(size > short, size))
    long_rows = token[i].view(np.int64), doc[i], *(x[i].astype(np.int64) for x in (n, rest))
    out = []
    if first:
        x, y = np.concatenate(first), np.concatenate(second)
        a, b, asked, reaches = doc[x], doc[y], np.minimum(asks[x], asks[y]), _reaches(n[x], n[y], rest[x], rest[y])
        order = np.lexsort((b, a))
        a, b, asked, reaches = a[order], b[order], asked[order], reaches[order]
        if len(a):
            at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            out.append((a[at], b[at], np.diff(np.append(at, len(a))), asked[at].astype(np.int64), np.maximum.reduceat(reaches, at).astype(np.int64)))
    return out, long_rows


def _candidates(blocks: DataFrame, bins: int) -> DataFrame:
    """kind 0: pairs (x, y, p = shared, q = asked, r = reaches); kind 1: long postings (x = token, y = doc, p = n, q = rest)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [np.frombuffer(b"".join(pdf[c]), t) for c, t in (("token", np.uint64), ("doc", np.int64), ("n", np.int32), ("asks", np.uint8), ("rest", np.int32))]
        pairs, long_rows = _pairs_within(*columns, PAIRS_UP_TO if pdf["bin"].iloc[0] < bins else 0)
        frames = [pd.DataFrame({"kind": 0, "x": a, "y": b, "p": p, "q": q, "r": r}) for a, b, p, q, r in pairs]
        return pd.concat([*frames, pd.DataFrame({"kind": 1, **dict(zip("xypq", long_rows, strict=True)), "r": 0})])

    return blocks.groupBy("bin").applyInPandas(run, "kind int, x long, y long, p long, q long, r long")


def _whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """signature and shingles (packed) of the documents with these ids."""
    schema = pa.schema([("signature", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_signed(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # then the texts aren't shuffled
    return docs.join(ids, "doc_id", "left_semi").mapInArrow(run, "signature long, shingles binary").dropDuplicates(["signature"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                p, q = (p, q) if len(p) < len(q) else (q, p)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(DENOMINATOR * both >= NUMERATOR * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("signature").alias("b"), F.col("shingles").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("signature").alias("a"), F.col("shingles").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component yet."""
    for end in ("a", "b"):
        of = components.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        pairs = pairs.join(of, end, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _mixed(long_rows: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of the long postings that lie in several components, and the component of each."""
    of = components.select(F.col("node").alias("doc"), "component")
    rows = long_rows.join(of, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    return rows.join(mixed, "token")


def _can_link(x: str, y: str) -> Column:
    """Whether two rows of a posting may link if its token is the first that they share."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    fits = F.least(n, m) * DENOMINATOR >= F.greatest(n, m) * NUMERATOR
    reaches = (NUMERATOR + DENOMINATOR) * (1 + F.least(f"{x}.rest", f"{y}.rest")) >= NUMERATOR * (n + m)
    return (F.col(f"{x}.component") != F.col(f"{y}.component")) & fits & reaches


def _round_of_ties(long_rows: DataFrame, components: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) of each document of a long posting with one document of it. That is one with
    many long postings, as a copy with few changes has, so that many documents are near it."""
    rows = stored(_mixed(long_rows, components).select("token", "weight", F.struct("doc", "n", "rest", "component").alias("x")), "mixed")
    chance = F.pmod(F.xxhash64("x.doc", F.lit(seed)), F.lit(1000)) / 1000 * min(1, seed)
    chosen = rows.groupBy("token").agg(F.max_by("x", F.struct(F.col("weight") * (2 - chance), F.col("x.doc"))).alias("y"))
    return rows.join(chosen, "token").where(_can_link("x", "y")).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def _across(long_rows: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs of the long postings between different components. Postings within one component,
    as those of near copies, are left out by a count before any pair is made. The others are
    cut into blocks of ``BLOCK`` documents or less, which are compared block by block, so no
    task gets all pairs of a posting."""
    # sizes that can link lie in the same or the next size class
    step = F.log(F.lit(DENOMINATOR / NUMERATOR))
    rows = stored(_mixed(long_rows, components).withColumn("cls", F.floor(F.log("n") / step + 1e-9).cast("int")), "mixed")
    sizes = rows.groupBy("token", "cls").agg(F.count(F.lit(1)).alias("size"))
    one = F.struct("doc", "n", "rest", "component")
    x = rows.select("token", "cls", one.alias("x"))
    y = rows.select("token", one.alias("y"), F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)).alias("cls"))
    # a side has about three times as many rows as the size; each block of one meets each of the other
    blocks = stored(sizes.select("token", "cls", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "blocks")

    def dealt(side: DataFrame, of: str, mine: str, other: str) -> DataFrame:
        side = side.join(blocks, ["token", "cls"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        side = side.withColumn(mine, F.pmod(F.xxhash64(f"{of}.doc"), "blocks").cast("int"))
        return side.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    met = dealt(x, "x", "i", "j").join(dealt(y, "y", "j", "i"), ["token", "cls", "i", "j"])
    met = met.where((F.col("x.doc") < F.col("y.doc")) & _can_link("x", "y"))
    return met.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def _grown(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components that further links make of these."""
    for end in ("a", "b"):
        of = components.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        links = links.join(of, end, "left").withColumn(end, F.coalesce(f"c{end}", end))
    joined = connected_components(links.select("a", "b"))
    grown = components.join(joined.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left")
    # a document that was in none yet may come in by a later link
    return grown.select("node", F.coalesce("c", "component").alias("component")).unionByName(joined.join(components, "node", "left_anti"))


def linked_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, n_shingles, class_id (smallest doc_id of its equal sets), component_id."""
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bins = number_of_bins(docs)
    seen, path = written(_signatures(docs, bins), "signatures", "kind")
    of_docs = seen.where("kind = 0").select(F.col("id").alias("doc_id"), "n", "s1", "s2")
    classes = of_docs.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("class_id"))
    classes = stored(classes.withColumnRenamed("s1", "signature"), "classes")
    table = spark.sparkContext.broadcast(_table(stored(_frequencies(seen.where("kind = 1")), "frequencies")))  # SLOTS bytes
    removed(spark, f"{path}/kind=1")  # the shingles of all texts, counted now; of_docs reads only kind 0

    found = stored(_candidates(_postings(docs, table, bins), bins), "candidates", "kind")
    table.destroy()  # neither the driver nor the executors hold it any longer
    pairs = found.where("kind = 0").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("p").alias("shared"), F.min("q").alias("asked"), F.max("r").alias("reaches"))
    long_rows = found.where("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("doc"), F.col("p").alias("n"), F.col("q").alias("rest"))
    weights = stored(long_rows.groupBy("doc").agg(F.count(F.lit(1)).alias("weight")), "weights")
    # what a pair shares in long postings isn't counted: as many as both have may be added
    pairs = pairs.where("reaches = 1")
    for end in ("a", "b"):
        pairs = pairs.join(weights.select(F.col("doc").alias(end), F.col("weight").alias(f"w{end}")), end, "left")
    pairs = stored(pairs.where(F.col("shared") + F.least(F.coalesce("wa", F.lit(0)), F.coalesce("wb", F.lit(0))) >= F.col("asked")).select("a", "b"), "pairs")
    # a first shared shingle lies in the prefix for l = 1
    long_rows = stored(long_rows.where(DENOMINATOR * (1 + F.col("rest")) >= NUMERATOR * F.col("n")).join(weights, "doc"), "long")

    met = pairs.select("a").union(pairs.select("b")).union(long_rows.select("doc")).distinct().withColumnRenamed("a", "signature")
    ids = stored(classes.join(met, "signature", "left_semi").select(F.col("class_id").alias("doc_id")), "ids")
    sets = stored(_whole_sets(docs, ids), "sets")
    # first one partner for each document, the smallest; those links are a forest
    tied = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    trees = stored(roots(_verified(tied, sets), "b", "a"), "trees")
    for seed in range(TIES):
        links = stored(_verified(_round_of_ties(long_rows, trees, seed), sets), "links")
        if not links.limit(1).count():
            break
        trees = stored(_grown(trees, links), "trees")
    # then only what is still apart
    rest = _apart(pairs.join(tied, ["a", "b"], "left_anti"), trees).union(_across(long_rows, trees)).distinct()
    components = _grown(trees, _verified(rest, sets))

    named = classes.join(components.withColumnRenamed("node", "signature"), "signature", "left").withColumn("component", F.coalesce("component", "signature"))
    named = stored(named, "named")
    least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "component").select("n", F.col("signature").alias("s1"), "s2", "class_id", "component_id")
    out = of_docs.join(stored(named, "named"), ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents of which each component keeps one, that with the smallest doc_id, with all their columns.
    A repeated row is kept once; rows without a doc_id are documents like others and come last."""
    docs = numbered(docs)
    return one_each(docs, linked_components(docs, doc_id=ROW).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group")))
