"""Language identification by bit-sliced Bloom filters of letter n-grams.

All languages share one array of slots. A slot is a bit mask over languages (several masks of
64 bits where there are more), and an n-gram of language l sets bit l in each of its slots. The
AND of an n-gram's slots is thus the set of all languages whose filter holds it, found with as
many reads as one filter would take. The number of slots follows from the number of n-grams.

Filters hold 4-grams of bytes inside words, with a space at either end, that are typical: an
n-gram enters the filter of a language if it occurs in at least ``LEAST_DOCS`` of its
training documents (or all, if there are fewer) and its share of documents there is at least ``TYPICAL`` of the largest
share in any language.

A text's n-grams are looked up, and the hits of each language are counted. A filter with a
share p of its bits set returns a false hit with probability p^k; the hits of language l of n
n-grams are corrected to (hits - n p^k) / (1 - p^k). The language with the most decides; its
part of all corrected hits is the score.

Training takes about ``TRAIN_ROWS`` labelled documents, in each language those with the smallest
hashes of their doc_id. Languages with few documents are taken whole and the others share what is
left evenly; every language is learned, with about ten times ``LEAST_DOCS`` documents at least
as far as there are any. The bound is a parameter. Every document is then scored whole in one pass
without a shuffle.

Cases: null texts and texts without a letter are ``und`` with score 0; a text with no hit at
all gets the commonest labelled language with its share as score; without training rows all
are ``und``; ties go to the language that comes first by name; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm import words
from corvida.session import ready, stored

TRAIN_ROWS = 20_000
GRAM = 4
LEAST_SLOTS = 1 << 21
MASK = 64
HASHES = 3
LEAST_DOCS = 3
TYPICAL = 0.34


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _letters() -> np.ndarray:
    """Bytes that may be part of a letter keep their (lower-case) value, all others are spaces."""
    out = np.full(256, 0x20, np.uint8)
    out[0x80:] = np.arange(0x80, 256)
    for a in range(26):
        out[0x41 + a] = out[0x61 + a] = 0x61 + a
    return out


_LETTER = _letters()


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all rows as 32-bit numbers, and the row of each. An n-gram lies in one word, with the space before and after it."""
    if not len(data):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    # a space at either end of each row
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n + GRAM, 0x20, np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    padded[np.arange(len(data)) + 2 * row + 1] = _LETTER[data]
    space = padded == 0x20
    gram = padded[: -GRAM + 1].astype(np.uint32)
    inner = np.zeros(len(gram), bool)
    for i in range(1, GRAM):
        gram |= padded[i : len(gram) + i].astype(np.uint32) << np.uint32(8 * i)
        if i < GRAM - 1:
            inner |= space[i : len(gram) + i]
    at = np.flatnonzero(~inner)
    begins = offsets + 2 * np.arange(n + 1)
    return gram[at], np.searchsorted(begins, at, "right") - 1


def _places(gram: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    h = words.mix(gram.astype(np.uint64) + np.uint64(0x9E37))
    step = h >> np.uint64(32) | np.uint64(1)
    for i in range(HASHES):
        yield (h + np.uint64(i) * step) & np.uint64(slots - 1)


def quota(counts: list[int], rows: int) -> int:
    """The most rows of each language so that all take about ``rows``, LEAST_DOCS at least."""
    left = rows
    for k, n in enumerate(sorted(counts)):
        if n * (len(counts) - k) >= left:
            return max(LEAST_DOCS, left // (len(counts) - k))
        left -= n
    return max(counts, default=0)


@dataclass
class Filters:
    """Masks over languages for each slot: slots[l // MASK] has bit l % MASK."""

    languages: list[str]
    prior: np.ndarray
    slots: np.ndarray

    @classmethod
    def build(cls, languages: list[str], prior: np.ndarray, gram: np.ndarray, language: np.ndarray) -> Filters:
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        slots = np.zeros((-(-len(languages) // MASK), max(LEAST_SLOTS, 1 << (4 * len(gram)).bit_length())), kind)
        bit = np.left_shift(kind(1), (language % MASK).astype(kind))
        for at in _places(gram, slots.shape[1]):
            np.bitwise_or.at(slots, (language // MASK, at), bit)
        return cls(languages, prior, slots)

    def holds(self, mask: np.ndarray, language: int) -> np.ndarray:
        """Whether each mask has the language."""
        kind = self.slots.dtype.type
        return (mask[language // MASK] >> kind(language % MASK)) & kind(1) == 1

    def false_hits(self) -> np.ndarray:
        """The probability of a false hit for each language."""
        share = [np.count_nonzero(self.holds(self.slots, i)) / self.slots.shape[1] for i in range(len(self.languages))]
        return np.array(share) ** HASHES

    def languages_of(self, gram: np.ndarray) -> np.ndarray:
        """The masks of all languages that hold each n-gram."""
        mask = None
        for at in _places(gram, self.slots.shape[1]):
            mask = self.slots[:, at] if mask is None else mask & self.slots[:, at]
        return mask

    def predict(self, data: np.ndarray, offsets: np.ndarray, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the language of each row and its score; ``wrong`` are the false hits."""
        n = len(offsets) - 1
        gram, row = grams(data, offsets)
        mask = self.languages_of(gram)
        total = np.bincount(row, minlength=n)
        fair = np.empty((n, len(self.languages)))
        for i in range(len(self.languages)):
            hits = np.bincount(row[self.holds(mask, i)], minlength=n)
            fair[:, i] = np.maximum(0, (hits - total * wrong[i]) / (1 - wrong[i]))
        none = fair.sum(axis=1) <= 0
        fair[none] = self.prior
        best = fair.argmax(axis=1)
        return best, fair[np.arange(n), best] / fair.sum(axis=1)


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Filters | None:
    """Fits the filters on (doc_id, text, lang)."""
    spark = docs.sparkSession
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not labelled:
        return None
    languages = sorted(labelled)
    number = {x: i for i, x in enumerate(languages)}
    most = quota(list(labelled.values()), train_rows)
    # hashes are even, so about m of n lie below m / n; a margin keeps LEAST_DOCS of them
    part = [(x, min(1.0, max(most, 10 * LEAST_DOCS) / n)) for x, n in labelled.items()]
    parts = spark.createDataFrame(part, "lang string, part double")
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    known = known.join(F.broadcast(parts), "lang").where(hashed < F.col("part")).select("text", "lang")  # parts: a row for each language
    known = stored(known, "known")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = pa.schema([("gram", pa.int64()), ("language", pa.int32()), ("n", pa.int64())])
    width = np.uint64(len(languages))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in words.pieces(batch):
                own = np.array([number[x] for x in rows.column(1).to_pylist()])
                gram, row = grams(data, offsets)
                once = words.distinct(gram.astype(np.uint64) << np.uint64(31) | row.astype(np.uint64))  # an n-gram counts once a row
                gram, language = once >> np.uint64(31), own[(once & np.uint64(2**31 - 1)).astype(np.int64)]
                key = np.sort(gram * width + language.astype(np.uint64))
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((key[at] // width).astype(np.int64)), pa.array((key[at] % width).astype(np.int32)), pa.array(np.diff(np.append(at, len(key))))], schema=schema)

    found = known.mapInArrow(count, "gram long, language int, n long")
    totals = F.broadcast(spark.createDataFrame([(number[x], n) for x, n in counts.items()], "language int, docs long"))  # a row for each language
    shares = found.groupBy("gram", "language").agg(F.sum("n").alias("n")).join(totals, "language").withColumn("share", F.col("n") / F.col("docs"))
    shares = stored(shares, "grams")
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    typical = shares.join(most, "gram").where((F.col("n") >= F.least(F.lit(LEAST_DOCS), "docs")) & (F.col("share") >= TYPICAL * F.col("most")))
    rows = typical.select("gram", "language").toPandas()  # bounded by the sample
    prior = np.array([labelled[x] for x in languages], float)
    return Filters.build(languages, prior / prior.sum(), rows["gram"].to_numpy(np.uint32), rows["language"].to_numpy(np.int64))


def predicted(docs: DataFrame, filters: Filters | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score."""
    ready(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    source = source.select("doc_id", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("letter", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong = filters.false_hits() if filters is not None else None
        for batch in batches:
            for rows, data, offsets in words.pieces(batch):
                if filters is None:
                    lang, score = pa.array(["und"] * rows.num_rows), np.zeros(rows.num_rows)
                else:
                    best, score = filters.predict(data, offsets, wrong)
                    lang = pa.array(filters.languages, pa.string()).take(pa.array(best))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lang, pa.array(score)], schema=schema)

    out = source.mapInArrow(run, "doc_id long, letter boolean, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(F.col("letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letter"), F.col("score")).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Trains on the labelled documents and predicts all."""
    ready(docs.sparkSession)
    return predicted(docs, train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), train_rows))
