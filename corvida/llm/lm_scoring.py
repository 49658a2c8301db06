"""Language model scoring: the marginal likelihood of a text over all its segmentations.

The model. A word is written by pieces of an existing subword vocabulary, the first of which
begins with the space before the word; single bytes are pieces too. A word's probability is
the sum over all its segmentations of the products of their pieces' probabilities, computed
by a forward recursion in log space over the lattice of pieces. Words seen in training are
one more arc of their lattice, weighted by absolute discounting:

    P(w) = (c(w) - d)+ / n  +  d * v / n * sum over segmentations,

with n training words, v of them distinct, and d estimated from words seen once and twice.
So what the discounts leave goes to the lattice, and unseen words are spelt by pieces. The
document's probability is the product over its words and its end, which has its own share.

Piece probabilities start from the vocabulary's own scores. The vocabulary file at hand is a
BPE one whose scores are ranks, so they are read as a Zipf law, and a few rounds of
expectation-maximisation over the training words (forward-backward, by Spark over the table
of distinct words) fit them; the vocabulary itself is never changed. Each distinct word counts
once there: what the lattice has to spell is rare words, not the commonest again and again.

Scale. Counts come from all training documents: every task counts its words, then Spark adds
them up. The commonest words (a fixed number) are broadcast with their probabilities; the
others are joined by a shuffle of (document, word) rows, so no table is cut off.

Cases: null and empty texts are the end alone; without training rows every token is unseen;
repeated rows and rows without doc_id (never held out) are scored each for itself; an empty table gives no rows; other columns are
ignored. Letters A-Z are lower-cased, all else is as it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm import words
from corvida.llm.common import commonest
from corvida.llm.tokens import vocabulary
from corvida.session import ready, stored

ROUNDS = 2
#: Words that are broadcast, at 24 bytes each.
COMMON = 1 << 18
#: The share of all piece counts that the starting distribution keeps.
PRIOR = 0.001
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_FLUSH = 600_000
_LN10 = math.log(10)


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from; a row without doc_id isn't one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Pieces:
    """A subword vocabulary with log probabilities, found by the hash of their bytes."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.pieces = pieces
        self.log_p = np.log(weights / weights.sum())
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({len(p) for p in pieces}):
            at = np.array([i for i, p in enumerate(pieces) if len(p) == length])
            raw = np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(-1, length).astype(np.uint64)
            key = np.zeros(len(at), np.uint64)
            for j in range(length):
                key = key * _BASE + raw[:, j] + np.uint64(1)
            order = np.argsort(key)
            self.by_length[length] = key[order], at[order]

    @classmethod
    def load(cls, path: str) -> Pieces:
        """The normal pieces of a sentencepiece model, and all single bytes."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {bytes([b]): 1e-7 for b in range(256)}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:]:
                found[piece] = max(found.get(piece, 0), 1 / (10 - model.get_score(i)))
        return cls(list(found), np.array(list(found.values())))

    def arcs(self, text: np.ndarray, log_p: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For texts of one length (a row each): by piece length, the piece at each start (-1: none) and its log probability."""
        n, size = text.shape
        key, out = np.zeros((n, size), np.uint64), {}
        wide = text.astype(np.uint64) + np.uint64(1)
        for length in range(1, min(size, max(self.by_length)) + 1):
            key = key[:, : size - length + 1] * _BASE + wide[:, length - 1 :]
            if length not in self.by_length:
                continue
            keys, index = self.by_length[length]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            piece = np.where(keys[at] == key, index[at], -1)
            out[length] = piece, np.where(piece >= 0, log_p[piece], -np.inf)
        return out

    def forward(self, text: np.ndarray, arcs: dict) -> np.ndarray:
        """alpha[:, j]: the log of the sum over all segmentations of the first j bytes."""
        n, size = text.shape
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, size + 1):
            alpha[:, j] = np.logaddexp.reduce([alpha[:, j - k] + p[:, j - k] for k, (_, p) in arcs.items() if k <= j], axis=0)
        return alpha

    def marginal(self, text: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """The log probability of each text."""
        return self.forward(text, self.arcs(text, log_p))[:, -1]

    def expected(self, text: np.ndarray, times: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """The expected number of uses of each piece."""
        n, size = text.shape
        arcs = self.arcs(text, log_p)
        alpha = self.forward(text, arcs)
        beta = np.full((n, size + 1), -np.inf)
        beta[:, size] = 0
        for j in range(size - 1, -1, -1):
            beta[:, j] = np.logaddexp.reduce([beta[:, j + k] + p[:, j] for k, (_, p) in arcs.items() if j + k <= size], axis=0)
        out = np.zeros(len(self.pieces))
        for k, (piece, p) in arcs.items():
            used = piece >= 0
            weight = np.exp(alpha[:, : size - k + 1] + p + beta[:, k:] - alpha[:, -1:]) * times[:, None]
            out += np.bincount(piece[used], weight[used], len(out))
        return out


def _by_length(raw: list[bytes], most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length, each with a space before it, as rows of bytes; and where they are."""
    size = np.array([len(x) for x in raw])
    for length in np.unique(size).tolist():
        every = np.flatnonzero(size == length)
        for at in np.array_split(every, -(-len(every) * max(1, length // 8) // most)):
            if len(at):
                text = np.full((len(at), length + 1), 0x20, np.uint8)
                text[:, 1:] = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(-1, length)
                yield text, at


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_counts(docs: DataFrame) -> DataFrame:
    """Of (text, held): hash, word, c (times in training documents), seen (times in all), for every distinct word."""
    schema = pa.schema([("hash", pa.int64()), ("word", pa.binary()), ("c", pa.int64()), ("seen", pa.int64())])

    def counted(parts: list[tuple]) -> pa.RecordBatch:
        key, n, learned, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        columns = [key[order][at].view(np.int64), word[order][at], np.add.reduceat(learned[order], at), np.add.reduceat(n[order], at)]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for rows, data, offsets in words.pieces(batch):
                start, end, first = words.spans(data, offsets)
                if not len(start):
                    continue
                key = words.hashed(data, start, end, lower=True)
                learn = np.repeat(~rows.column(1).to_numpy(zero_copy_only=False), np.diff(first))
                found = words.distinct(key)
                which = np.searchsorted(found, key)
                where = np.empty(len(found), np.int64)
                where[which] = np.arange(len(key))
                low = _lower(data)
                word = np.empty(len(found), object)
                word[:] = [low[a:b].tobytes() for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]
                parts.append((found, np.bincount(which), np.bincount(which, learn).astype(np.int64), word))
                held += len(found)
                if held >= _FLUSH:
                    yield counted(parts)
                    parts, held = [], 0
        if held:
            yield counted(parts)

    made = docs.select("text", "held").mapInArrow(run, "hash long, word binary, c long, seen long")
    return made.groupBy("hash").agg(F.first("word").alias("word"), F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def fit_pieces(counts: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """The log probabilities of the vocabulary's pieces, fitted to the training words."""
    own = Pieces.load(path)
    start, log_p = np.exp(own.log_p), own.log_p
    for _ in range(rounds):
        now = log_p

        def expect(frames: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            pieces, total = Pieces.load(path), None
            for pdf in frames:
                for text, at in _by_length(list(pdf["word"])):
                    got = pieces.expected(text, np.ones(len(at)), now)
                    total = got if total is None else total + got
            if total is not None:
                used = np.flatnonzero(total)
                yield pd.DataFrame({"piece": used, "n": total[used]})

        # a row for each piece of the vocabulary at most
        used = counts.where("c > 0").select("word").mapInPandas(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(len(start))
        total[used["piece"].to_numpy()] = used["n"].to_numpy()
        log_p = np.log(total + start * max(1.0, PRIOR * total.sum()))
        log_p -= np.logaddexp.reduce(log_p)
    return log_p


def score_texts(docs: DataFrame, rounds: int = ROUNDS, common: int = COMMON, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = ready(docs.sparkSession)
    path = path or vocabulary("piece_bpe_32k.model")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(F.col(doc_id)).alias("held"))
    counts = stored(word_counts(docs), "word-counts")
    of = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).first()
    ends = docs.where(~F.col("held")).count()
    n_words, v, n1, n2 = (int(x or 0) for x in of)
    n = n_words + ends
    distinct = v + (ends > 0)
    below = n + distinct + 1
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    p_end = (ends + 1) / (n + 2)
    log_p = fit_pieces(counts, path, rounds)

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces.load(path)
        for pdf in frames:
            out = np.empty(len(pdf))
            for rows, at in _by_length(list(pdf["word"])):
                out[at] = pieces.marginal(rows, log_p)
            c = pdf["c"].to_numpy(float)
            whole = np.log(np.maximum(c - discount, 1e-300) / max(1, n_words))
            whole[c == 0] = -np.inf
            rest = math.log(discount * v / n_words) if n_words and v else 0.0
            yield pd.DataFrame({"hash": pdf["hash"], "c": pdf["c"], "seen": pdf["seen"], "lp": (np.logaddexp(whole, out + rest) + math.log1p(-p_end)) / _LN10})

    priced = stored(counts.mapInPandas(spell, "hash long, c long, seen long, lp double"), "word-scores")
    top = commonest(priced, "seen", common).select("hash", "c", "lp").toPandas().sort_values("hash", key=lambda x: x.to_numpy().view(np.uint64))
    table = spark.sparkContext.broadcast((top["hash"].to_numpy().view(np.uint64).copy(), np.log10((top["c"].to_numpy() + 1) / below), top["lp"].to_numpy(), top["c"].to_numpy() > 0))
    end_base, end_lp = math.log10(((ends if ends else 0) + 1) / below), math.log10(p_end)

    schema = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, base, lp, known = table.value
        for batch in batches:
            for rows, data, offsets in words.pieces(batch):
                start, end, first = words.spans(data, offsets)
                key = words.hashed(data, start, end, lower=True)
                at = np.minimum(np.searchsorted(hashes, key), max(0, len(hashes) - 1))
                hit = hashes[at] == key if len(hashes) else np.zeros(len(key), bool)
                row = np.repeat(np.arange(rows.num_rows), np.diff(first))
                h, r = at[hit], row[hit]
                ids = rows.column(0).to_numpy()
                size = np.diff(first)
                doc = pa.concat_arrays([rows.column(2), pa.array(key[~hit].view(np.int64))])
                head = [np.zeros(rows.num_rows, np.int32), ids, np.zeros(rows.num_rows, np.int64), size + 1, np.bincount(r, known[h], rows.num_rows).astype(np.int64) + (ends > 0), np.bincount(r, base[h], rows.num_rows) + end_base, np.bincount(r, lp[h], rows.num_rows) + end_lp]
                miss = ~hit
                ids = ids[row[miss]]
                rest = [np.ones(len(ids), np.int32), ids, np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))]
                yield pa.RecordBatch.from_arrays([doc if t.name == "key" else pa.array(np.concatenate(c), t.type) for c, t in zip(zip(head, rest, strict=True), schema, strict=True)], schema=schema)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "text", "doc_id")
    found = stored(numbered.mapInArrow(look_up, "kind int, row long, key long, n long, known long, base double, lp double"), "looked-up", "kind")
    head = found.where("kind = 0").select("row", F.col("key").alias("doc_id"), "n", "known", "base", "lp")
    rare = found.where("kind = 1").select("row", F.col("key").alias("hash"))
    tail = rare.join(priced.select("hash", "c", F.col("lp").alias("lp")), "hash")
    tail = tail.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n"), (F.col("c") > 0).cast("long").alias("known"), F.log10((F.col("c") + 1) / F.lit(float(below))).alias("base"), "lp")
    out = head.unionByName(tail).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n", "known", "base", "lp")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lp").alias("score"))
