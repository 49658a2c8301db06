"""Aligning the tokens of two tokenizers: an event sweep over their end offsets.

Both tokenizers cut the same bytes, a space and the text. Every token of A and of B is an
event at the offset where it ends; runs of events of one document and one side travel
together in a row (``CHUNK`` ids, each of which tells how many bytes its token has), so that a
shuffle carries two bytes a token. The union of both sides' events is dealt by document and sorted by offset inside
each partition; a state machine reads it once. It holds the tokens since the last offset
where both sides end, and its counters:

* an offset where both end closes a group: A ids against B ids;
* each stretch between neighbouring ends of either side is one link, for it lies in exactly
  one token of A and one of B, and the next stretch changes one of them.

A task lays its documents one after another on one line, so a step of the machine is a few
numpy calls over a million tokens of many documents; what is behind the last common end
waits for the next step.

How often each pair of ids is linked is counted over all documents; the documents then look
their pairs up. The commonest pairs (a documented bound) are broadcast, all other pairs are
joined, so every link gets its count.

Cases: a null or empty text, or one whose ids don't give its bytes back, has no tokens and
gives zeros and ''. Repeated rows and rows without doc_id are aligned each for itself; an
empty table gives no rows; a very long text is swept in steps, a group that never closes is
held by its tokens (eight bytes each); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.llm import tokens, words
from corvida.llm.common import commonest, small_batches
from corvida.session import ready, stored

#: Events in a row.
CHUNK = 1024
#: Tokens a step of the machine takes.
STEP = 1 << 18
#: Pairs of ids that are broadcast, 17 bytes each; all others are joined.
COMMON = 1_000_000
#: Cuts of texts that a side keeps encoded, some 40 bytes each.
MOST_RUNS = 500_000
_BATCH = 500_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones
    themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteSide:
    """Side A: a byte-level vocabulary; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.encoder = tokens.Encoder(path, MOST_RUNS, plain=True)
        letters = byte_letters()
        vocab = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        raw = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            raw[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.width = np.array([len(x) for x in raw], np.int64)
        self.at = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.size = len(raw)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets of the rows in them, whether a row's ids give its bytes back)."""
        ids, first = self.encoder.encode(data, offsets)
        width = self.width[ids]
        stop = np.concatenate([[0], np.cumsum(width)])
        same = np.diff(stop[first]) == np.diff(offsets)
        if same.all():
            back = self.flat[np.repeat(self.at[ids] - stop[:-1], width) + np.arange(stop[-1])]
            wrong = np.flatnonzero(back != data)
            same[np.searchsorted(offsets, wrong, "right") - 1] = False
        else:
            for i in np.flatnonzero(same).tolist():
                mine = ids[first[i] : first[i + 1]]
                back = b"".join(self.flat[self.at[x] : self.at[x] + self.width[x]].tobytes() for x in mine.tolist())
                same[i] = back == data[offsets[i] : offsets[i + 1]].tobytes()
        return ids, first, same


class PieceSide:
    """Side B: a sentencepiece vocabulary. No piece has a space behind another letter, so
    a text is cut before each run of spaces and every distinct cut is encoded once."""

    def __init__(self, path: str, most: int = MOST_RUNS):
        import sentencepiece

        self.model, self.most = sentencepiece.SentencePieceProcessor(model_file=path), most
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("a piece of this vocabulary goes on behind a space")
        self.raw = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.width = np.array([len(x) for x in self.raw], np.int64)
        # the model gives an empty text no ids, so a lone space, as at the end of a text, is learned behind a letter
        self.space = self.model.encode("a ")[len(self.model.encode("a")) :]
        self._empty()

    def _empty(self) -> None:
        self.keys, self.exact = np.empty(0, np.uint64), np.empty(0, bool)
        self.at, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As the other side's; every row begins with a space."""
        gap = data == 0x20
        begins = gap.copy()
        begins[1:] &= ~gap[:-1]
        begins[offsets[:-1]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        key = words.hashed(data, start, end)
        found = words.distinct(key)
        which = np.searchsorted(found, key)
        seen = np.empty(len(found), np.int64)
        seen[which] = np.arange(len(key))
        where = self._learned(found, start[seen], end[seen], data)
        count = self.count[where][which]
        stop = np.cumsum(count)
        ids = self.flat[np.repeat(self.at[where][which] - (stop - count), count) + np.arange(int(stop[-1]))]
        first = np.searchsorted(start, offsets)
        return ids, np.concatenate([[0], stop])[first], np.logical_and.reduceat(self.exact[where][which], first[:-1])

    def _learned(self, found: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where the cuts are in the table; new ones are encoded first."""
        where = np.minimum(np.searchsorted(self.keys, found), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[where] != found) if len(self.keys) else np.arange(len(found))
        if len(new):
            if len(self.keys) + len(new) > self.most and len(self.keys):
                self._empty()
                new = np.arange(len(found))
            raw = [data[a:b].tobytes() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            got = self.model.encode([x[1:].decode("utf-8", "replace") for x in raw], num_threads=1)
            got = [self.space if x == b" " else g for g, x in zip(got, raw, strict=True)]
            exact = np.array([b"".join(map(self.raw.__getitem__, g)) == x for g, x in zip(got, raw, strict=True)])
            count = np.array([len(g) for g in got], np.int64)
            total = int(count.sum())
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(self.flat), total), np.uint32)])
            self.flat[self.used : self.used + total] = np.concatenate([np.array(g, np.uint32) for g in got])
            put = np.searchsorted(self.keys, found[new])
            self.at = np.insert(self.at, put, self.used + np.cumsum(count) - count)
            self.count, self.exact = np.insert(self.count, put, count), np.insert(self.exact, put, exact)
            self.keys, self.used = np.insert(self.keys, put, found[new]), self.used + total
        return np.searchsorted(self.keys, found)


_SIDES: dict[tuple, object] = {}


def _side(kind: type, path: str):
    """This Python worker's encoder."""
    if (kind.__name__, path) not in _SIDES:
        _SIDES[kind.__name__, path] = kind(path)
    return _SIDES[kind.__name__, path]


def _number(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


_EVENTS = pa.schema([("row", pa.int64()), ("at", pa.int64()), ("side", pa.int32()), ("doc_id", pa.int64()), ("good", pa.bool_()), ("size", pa.int64()), ("ids", pa.binary())])


def events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Of (row, doc_id, text) the ends of both sides' tokens: row, at (offset of the first
    token's beginning), side (0: A), doc_id, good (the ids give the bytes back), size (bytes)
    and ids (binary; an id tells how many bytes its token has). The first row of each side has ``at`` 0, with or without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _side(ByteSide, path_a), _side(PieceSide, path_b)
        for batch in batches:
            for rows, data, offsets in words.pieces(batch, "text", _BATCH):
                data = np.insert(data, offsets[:-1], 0x20)
                offsets = offsets + np.arange(len(offsets))
                size = np.diff(offsets)
                row, doc_id = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                for k, side in enumerate(sides):
                    ids, first, good = side.encode(data, offsets)
                    good &= size > 1
                    stop = np.concatenate([[0], np.cumsum(side.width[ids])])
                    narrow = ids.astype(_number(side.size))
                    out: list[tuple] = []
                    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                        if not good[i]:
                            out.append((row[i], 0, k, doc_id[i], False, 0, b""))
                            continue
                        for s in range(a, b, CHUNK):
                            e = min(b, s + CHUNK)
                            out.append((row[i], int(stop[s] - stop[a]), k, doc_id[i], True, int(size[i]), narrow[s:e].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _EVENTS, strict=True)], schema=_EVENTS)

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, at long, side int, doc_id long, good boolean, size long, ids binary")


def _joined(column: pa.Array, dtype: type) -> np.ndarray:
    """The numbers in all values of a binary column, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


_SWEPT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def _written(size: int, ends: tuple[bytes, bytes]) -> np.ndarray:
    """The ids below size in decimal with either end, eight bytes each, filled up with zeros."""
    return np.frombuffer(b"".join((b"%d%s" % (i, c)).ljust(8, b"\0") for i in range(size) for c in ends), np.uint64)


class Sweep:
    """The state machine: reads sorted events, gives a row for each document, or for a part of one that is longer than a step.
    ``widths`` are the bytes of each id of A and of B, of which there are below ten million."""

    def __init__(self, widths: tuple[np.ndarray, np.ndarray], texts: bool = False):
        self.widths, self.texts = widths, texts
        self.n_a, self.n_b = map(len, widths)
        self.names = np.concatenate([_written(self.n_a, (b",", b"|")), _written(self.n_b, (b",", b";"))])
        self.ends = [np.empty(0, np.int64), np.empty(0, np.int64)]  # of tokens that wait, on the line
        self.ids = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.last = [0, 0]  # where each side's tokens on the line end
        self.row, self.doc_id, self.stop = [], [], np.empty(0, np.int64)  # documents on the line, and their ends
        self.line = self.done = 0
        self.good, self.held = False, None
        self.digest = None

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([x for x in (self.held, batch) if x is not None]).combine_chunks()
        at, side = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        n = len(at)
        # a document's first two rows tell whether both sides give its bytes back: the first waits for the second
        self.held = None
        if n and at[-1] == 0 and side[-1] == 0:
            self.held, n = rows.slice(n - 1).to_batches()[0], n - 1
        if not n:
            return
        rows, at, side = rows.slice(0, n), at[:n], side[:n]
        good, size = rows.column(4).to_numpy(zero_copy_only=False), rows.column(5).to_numpy()
        head = np.flatnonzero((at == 0) & (side == 0))
        both = good[head] & good[head + 1]
        stop = self.line + np.cumsum(np.where(both, size[head], 0))
        take = np.concatenate([[self.good], both])[np.searchsorted(head, np.arange(n), "right")]
        if len(head):
            self.row += rows.column(0).take(pa.array(head)).to_pylist()
            self.doc_id += rows.column(3).take(pa.array(head)).to_pylist()
            self.stop, self.line, self.good = np.concatenate([self.stop, stop]), int(stop[-1]), bool(both[-1])
        for k in (0, 1):
            mine = rows.filter(pa.array(take & (side == k)))
            ids = _joined(mine.column(6), _number(len(self.widths[k]))).astype(np.int64)
            if len(ids):
                ends = self.last[k] + np.cumsum(self.widths[k][ids], dtype=np.int64)
                self.last[k] = int(ends[-1])
                self.ends[k] = np.concatenate([self.ends[k], ends])
                self.ids[k] = np.concatenate([self.ids[k], ids])
        if len(self.ends[0]) + len(self.ends[1]) >= STEP or len(self.row) >= STEP // 8:
            yield self.step()

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.row:
            yield self.step()

    def step(self) -> pa.RecordBatch:
        """Takes all tokens up to the last offset where both sides end."""
        (ea, eb), (ia, ib) = self.ends, self.ids
        n_docs = len(self.row)
        counts = np.zeros((4, n_docs), np.int64)
        pair, times, cut = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(n_docs + 1, np.int64)
        said, letters = np.empty(0, np.uint8), np.zeros(n_docs + 1, np.int64)
        # a mark for each byte of the line where a side ends; what both have marked is common
        span = min(self.last) - self.done
        na, nb = (int(np.searchsorted(e, self.done + span, "right")) for e in (ea, eb))
        marks = np.zeros((2, span + 1), bool)
        for mark, e, n in zip(marks, (ea, eb), (na, nb), strict=True):
            mark[e[:n] - self.done] = True
        common = np.flatnonzero(marks[0] & marks[1])
        if len(common):
            span = int(common[-1])
            na, nb = (int(np.searchsorted(e, self.done + span, "right")) for e in (ea, eb))
            self.ends, self.ids = [ea[na:], eb[nb:]], [ia[na:], ib[nb:]]
            ea, eb, ia, ib = ea[:na] - self.done, eb[:nb] - self.done, ia[:na], ib[:nb]
            marks = marks[:, : span + 1]
            upto = np.cumsum(marks, axis=1, dtype=np.int64)  # tokens that end up to each byte
            group = np.cumsum(marks[0] & marks[1], dtype=np.int64)
            ga, gb = group[ea] - (marks[0] & marks[1])[ea], group[eb] - (marks[0] & marks[1])[eb]
            every = np.flatnonzero(marks[0] | marks[1])
            left, right = (upto[k][every] - marks[k][every] for k in (0, 1))
            stops = np.concatenate([[-1], np.minimum(self.stop - self.done, span)])
            counts[:] = [np.diff(np.searchsorted(x, stops, "right")) for x in (ea, eb, common, every)]
            of = np.repeat(np.arange(n_docs), counts[3])
            key, times = np.unique(of * (self.n_a * self.n_b) + ia[left] * self.n_b + ib[right], return_counts=True)
            owner = key // (self.n_a * self.n_b)
            pair, cut = key - owner * (self.n_a * self.n_b), np.searchsorted(owner, np.arange(n_docs + 1))
            # where each token's id is written: behind all tokens of earlier groups, A before B
            code, before = np.empty(na + nb, np.int64), np.concatenate([[0], upto[1][common]])
            code[np.arange(na) + before[ga]] = 2 * ia + np.append(ga[1:] != ga[:-1], True)
            code[np.arange(nb) + upto[0][common][gb]] = 2 * self.n_a + 2 * ib + np.append(gb[1:] != gb[:-1], True)
            said = self.names[code].view(np.uint8)
            used = said != 0
            width = np.concatenate([[0], np.cumsum(used.reshape(-1, 8).sum(axis=1))])
            said, letters[1:] = said[used], width[np.cumsum(counts[0] + counts[1])]
            self.done += span
        whole = int(np.searchsorted(self.stop, self.done, "right"))  # documents that end up to here
        touched = whole + (whole < n_docs and bool(counts[2][whole]))
        texts, digests = [], []
        for i in range(touched):
            text = said[letters[i] : letters[i + 1]].tobytes()[:-1]
            goes_on = i == 0 and self.digest is not None
            digest = self.digest if goes_on else hashlib.sha256()
            digest.update(b";" + text if goes_on and text else text)
            self.digest = digest if i >= whole else None
            texts.append(text.decode() if self.texts else None)
            began = counts[2][i] or goes_on
            digests.append((digest.hexdigest() if began else "") if i < whole else None)
        pair, times = pair.astype("<u8").view(np.uint8), times.astype("<u4").view(np.uint8)
        out = [self.row[:touched], self.doc_id[:touched], *(c[:touched] for c in counts), texts, digests]
        out += [[x[w * a : w * b].tobytes() for a, b in zip(cut[:touched].tolist(), cut[1 : touched + 1].tolist(), strict=True)] for x, w in ((pair, 8), (times, 4))]
        self.row, self.doc_id, self.stop = self.row[whole:], self.doc_id[whole:], self.stop[whole:]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _SWEPT, strict=True)], schema=_SWEPT)


def swept(docs: DataFrame, path_a: str, path_b: str, texts: bool = False) -> DataFrame:
    """Of (row, doc_id, text): row, doc_id, n_a, n_b, n_groups, n_links, groups (where ``texts``), groups_sha256,
    pairs (A id * size of B + B id, unsigned 64 bits each) and times (unsigned 32 bits) of the links.
    A document of more tokens than a step has several rows, of which the last has the hash."""
    widths = tuple(_side(*x).width.astype(np.uint16) for x in ((ByteSide, path_a), (PieceSide, path_b)))
    dealt = events(docs, path_a, path_b).repartition("row").sortWithinPartitions("row", "at", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _SIDES.clear()  # this worker may have encoded before
        machine = Sweep(widths, texts)
        for batch in batches:
            yield from machine.add(batch)
        yield from machine.finish()

    return dealt.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs binary, times binary")


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """How often each pair of ids is linked in all documents: pair, n, best (no pair of its B id has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, fresh = np.empty(0, np.uint64), np.empty(0, np.int64), 0

        def summed(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(p)
            p, t = p[order], t[order]
            at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            return p[at], np.add.reduceat(t, at)

        held = []
        for batch in batches:
            held.append((_joined(batch.column(0), np.uint64), _joined(batch.column(1), np.uint32).astype(np.int64)))
            fresh += len(held[-1][0])
            if fresh >= 4 * STEP:
                pair, n = summed(*(np.concatenate(x) for x in zip((pair, n), *held, strict=True)))
                held, fresh = [], 0
                if len(pair) >= 4 * STEP:
                    yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], names=["pair", "n"])
                    pair, n = pair[:0], n[:0]
        if fresh or len(pair):
            pair, n = summed(*(np.concatenate(x) for x in zip((pair, n), *held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n)], names=["pair", "n"])

    pairs = found.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = stored(pairs.withColumn("b", F.col("pair") % F.lit(size_b)), "pairs")
    most = F.broadcast(pairs.groupBy("b").agg(F.max("n").alias("most")))  # a row for each id of B's vocabulary at most
    return pairs.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text", doc_id: str = "doc_id", common: int = COMMON) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = ready(docs.sparkSession)
    path_a, path_b = path_a or tokens.vocabulary(), path_b or tokens.vocabulary("piece_bpe_32k.model")
    size_b = _side(PieceSide, path_b).size
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(spark):
        found = stored(swept(rows, path_a, path_b).drop("groups"), "swept")
        pairs = stored(pair_counts(found, size_b), "pair-counts")
    top = commonest(pairs, "n", common).toPandas().sort_values("pair")
    table = spark.sparkContext.broadcast(tuple(top[c].to_numpy().copy() for c in ("pair", "n", "best")))
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), *((c, pa.int64()) for c in counts), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = table.value
        for batch in batches:
            pair, times = _joined(batch.column(7), np.int64), _joined(batch.column(8), np.uint32).astype(np.int64)
            size = np.array([len(x) // 4 for x in batch.column(8).to_pylist()], np.int64)
            of = np.repeat(np.arange(batch.num_rows), size)
            at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            value = np.zeros((2, batch.num_rows + 1), np.int64)
            stop = np.concatenate([[0], np.cumsum(size)])
            for k, gain in enumerate((best[at] * times, n[at] * times)) if len(keys) else ():
                value[k] = np.concatenate([[0], np.cumsum(np.where(hit, gain, 0))])[stop]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), batch.column(0), batch.column(1), none, *(batch.column(i) for i in range(2, 6)), *(pa.array(np.diff(v) if len(v) > batch.num_rows else v) for v in value), batch.column(6)], schema=schema)
            miss = np.flatnonzero(~hit)
            if len(miss):
                zero, rest = pa.array(np.zeros(len(miss), np.int64)), batch.column(0).to_numpy()[of[miss]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(miss), np.int32)), pa.array(rest), pa.nulls(len(miss), pa.int64()), pa.array(pair[miss]), pa.array(times[miss]), zero, zero, zero, zero, zero, pa.nulls(len(miss), pa.string())], schema=schema)

    looked = found.mapInArrow(look_up, "kind int, row long, doc_id long, key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    with small_batches(spark):
        looked = stored(looked, "looked-up", "kind")
    rest = looked.where("kind = 1").select("row", F.col("key").alias("pair"), F.col("n_a").alias("times")).join(pairs, "pair")
    rest = rest.select("row", F.lit(None).cast("long").alias("doc_id"), *(F.lit(0).cast("long").alias(c) for c in counts), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"), F.lit(None).cast("string").alias("groups_sha256"))
    head = looked.where("kind = 0").select(rest.columns)
    sums = [F.sum(c).alias(c) for c in (*counts, "n_best", "count_sum")]
    return head.unionByName(rest).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256")).drop("row")


def links(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The groups as text (``a1,a2|b1;a3|b2,b3``) and the linked ids of each document: doc_id, groups, and links,
    an array of (a, b, times). A document of more tokens than a step comes in parts, a row for each."""
    ready(docs.sparkSession)
    path_a, path_b = path_a or tokens.vocabulary(), path_b or tokens.vocabulary("piece_bpe_32k.model")
    size_b = _side(PieceSide, path_b).size
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("groups", pa.string()), ("links", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"a": p // size_b, "b": p % size_b, "times": t} for p, t in zip(np.frombuffer(p, np.uint64).tolist(), np.frombuffer(t, np.uint32).tolist(), strict=True)] for p, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, schema.field("links").type)], schema=schema)

    return swept(rows, path_a, path_b, True).select("doc_id", "groups", "pairs", "times").mapInArrow(run, "doc_id long, groups string, links array<struct<a: int, b: int, times: long>>")

