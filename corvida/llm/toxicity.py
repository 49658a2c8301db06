"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-case words and their stems (the first four, five, six and eight bytes
of each), hashed into a fixed number of buckets; a term counts once a text, and as terms of their own
if the text has it twice and three times: a stem that clean texts have by chance, toxic ones repeat.
The score is the logistic function of

    w0 + sum of w_i over its terms + sum of <v_i, v_j> over pairs of its terms,

so a pair such as an insult with the mention of a group weighs more (or less) than its two
words apart. The pair sum is computed as half of |sum v|^2 - sum |v|^2, in time linear in
the number of terms.

Training takes at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of
their doc_id. The machine gets the terms that tell the labels apart beyond chance in that
sample, alone or as one of a pair. Alone asks for ``least_rows`` rows and a squared z of ``least_z2``;
with 1 and 0 every term of the sample reaches the machine. All pairs of whole words are counted, by
Spark, over ``PAIR_ROWS`` of those documents, toxic and clean ones in equal numbers if there
are as many; a pair counts if its share of toxic rows departs from what its terms have alone by
more than chance gives in so many pairs. All bounds are parameters. Every document is then
scored whole, in one pass over the table without a shuffle.

Cases: null and empty texts have no terms and get the score of a text without any known
term; without labelled rows every score is 0; labels of one kind only give that kind's
share; several labels of one doc_id count as their largest; other columns are ignored here
and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.llm import words
from corvida.session import ready, stored

TRAIN_ROWS, PAIR_ROWS = 20_000, 6_000
BUCKETS = 1 << 20
FACTORS = 8
THRESHOLD = 0.7
#: The least square of a term's z statistic: some chance terms in a million pass it.
LEAST_Z2, LEAST_ROWS = 22.0, 3
_STEM_BYTES = (4, 5, 6, 8)
#: How often a text has a term for it to count anew.
_AGAIN = (2, 3)
#: Of ``_EPOCHS`` the first ``_LINEAR`` move the bias and the linear weights alone, so pairs learn what these leave.
_EPOCHS, _LINEAR, _RATE, _DECAY, _PAIR_DECAY = 80, 30, 0.05, 1e-4, 1e-3
_BLOCK = 1_024


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all terms, and the row of each."""
    start, end, first = words.spans(data, offsets)
    whole = words.hashed(data, start, end, lower=True)
    stems = [words.hashed(data, start, np.minimum(end, start + n), lower=True) + np.uint64(n) for n in _STEM_BYTES]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return np.concatenate([whole, *map(words.mix, stems)]) % np.uint64(BUCKETS), np.tile(row, 1 + len(stems))


def _again(bucket: np.ndarray, times: int) -> np.ndarray:
    """The bucket of a term that a text has so many times."""
    return (words.mix(bucket.astype(np.uint64) + np.uint64(times << 32)) % np.uint64(BUCKETS)).astype(np.int64)


def _met(row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """row * BUCKETS + bucket of each distinct term of a row, terms met again among them; sorted."""
    key = np.sort(row * BUCKETS + bucket.astype(np.int64))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    times, key = np.diff(np.append(at, len(key))), key[at]
    row, bucket = np.divmod(key, BUCKETS)
    return words.distinct(np.concatenate([key, *(row[some] * BUCKETS + _again(bucket[some], t) for t in _AGAIN for some in (times >= t,))]))


@dataclass
class Model:
    """Weights by term; place[b] is the term of bucket b, or -1."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self) -> None:
        """Marks the buckets that matter: those of terms, and those whose repeats are terms."""
        every = np.arange(BUCKETS)
        self.watched = np.logical_or.reduce([self.place >= 0, *(self.place[_again(every, t)] >= 0 for t in _AGAIN)])

    def scores(self, term: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of rows whose distinct terms are term[first[i]:first[i + 1]]."""
        n = len(first) - 1
        row = np.repeat(np.arange(n), np.diff(first))
        linear = np.bincount(row, self.weights[term], n)
        v = self.factors[term]
        pairs = sum(np.bincount(row, v[:, f], n) ** 2 - np.bincount(row, v[:, f] ** 2, n) for f in range(v.shape[1])) / 2
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs, -30, 30)))

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct known terms of each row, and where each row begins."""
        bucket, row = _terms(data, offsets)
        some = self.watched[bucket]
        row, bucket = np.divmod(_met(row[some], bucket[some]), BUCKETS)
        term = self.place[bucket]
        key = words.distinct((row * len(self.weights) + term)[term >= 0]) if len(term) else np.empty(0, np.int64)
        row, term = np.divmod(key, max(1, len(self.weights)))
        return term, np.searchsorted(row, np.arange(len(offsets)))


def _fit(term: np.ndarray, first: np.ndarray, label: np.ndarray, n_terms: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss by Adam over mini-batches of the sample."""
    rng = np.random.default_rng(seed)
    share = label.mean()
    params = [np.array([np.log(share / (1 - share))]), np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, FACTORS))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    size, step, n = np.diff(first), 0, len(label)
    batch = max(256, n // 8)
    for epoch in range(_EPOCHS):
        rate = _RATE * (1 - epoch / _EPOCHS) + 1e-3
        if epoch == _LINEAR:
            step, moments = 0, [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        order = rng.permutation(n)
        for at in (order[i : i + batch] for i in range(0, n, batch)):
            k = size[at]
            stop = np.cumsum(k)
            t = term[np.repeat(first[:-1][at] - (stop - k), k) + np.arange(int(stop[-1]))]
            row = np.repeat(np.arange(len(at)), k)
            v = params[2][t]
            total = np.stack([np.bincount(row, v[:, f], len(at)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(row, (v**2).sum(axis=1), len(at))
            z = params[0][0] + np.bincount(row, params[1][t], len(at)) + ((total**2).sum(axis=1) - squares) / 2
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[at]) / len(at)
            e = error[row]
            grads = [np.array([error.sum()]), np.bincount(t, e, n_terms) + _DECAY * params[1], np.stack([np.bincount(t, e * (total[row, f] - v[:, f]), n_terms) for f in range(FACTORS)], axis=1) + _PAIR_DECAY * params[2]]
            step += 1
            for p, g, (m, s) in list(zip(params, grads, moments, strict=True))[: 2 if epoch < _LINEAR else 3]:
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def _deviance(clean: np.ndarray, toxic: np.ndarray, low, high) -> np.ndarray:
    """Of so many clean and toxic rows where a share from low to high would be toxic; beyond g by chance with at most 2 exp(-g / 2)."""
    n = clean + toxic
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.clip(toxic / n, low, high)
        return 2 * (np.where(toxic > 0, toxic * np.log(toxic / (n * share)), 0) + np.where(clean > 0, clean * np.log(clean / (n * (1 - share))), 0))


@dataclass
class _Pairs:
    """Terms as packed bits over the toxic and the clean rows, and the share of toxic rows that is
    expected of a pair: least and greatest, for pairs with each term that stands alone and for all others."""

    toxic: np.ndarray
    clean: np.ndarray
    own: np.ndarray
    overall: np.ndarray
    alone: np.ndarray
    least: float

    def beyond(self, i: int, j: int) -> np.ndarray:
        """The terms of two blocks, from i and from j on, that depart from chance in some pair of them."""
        x, y = slice(i, i + _BLOCK), slice(j, j + _BLOCK)
        t, c = (np.unpackbits(bits[x], axis=1).astype(np.float32) @ np.unpackbits(bits[y], axis=1).astype(np.float32).T for bits in (self.toxic, self.clean))
        a, b = self.alone[x, None], self.alone[None, y]
        low, high = (np.where(a, self.own[k][x, None], np.where(b, self.own[k][None, y], self.overall[k])) for k in (0, 1))
        hit = (_deviance(c, t, low, high) >= self.least) & ~(a & b)
        return np.concatenate([i + np.flatnonzero(hit.any(axis=1)), j + np.flatnonzero(hit.any(axis=0))])


def _paired(parts: list[np.ndarray], label: np.ndarray, clean: np.ndarray, toxic: np.ndarray, alone: np.ndarray, spark: SparkSession | None = None) -> np.ndarray:
    """Which terms depart from chance in some pair; ``alone`` says which do without one. A pair with such a term is
    held against that term's rows, other pairs against all rows. Long rows have more pairs of rare terms, so
    the share expected lies between that of the rows and that of their sizes.

    ``parts`` are the terms of each row, toxic rows first. A term with too few rows for a pair beyond chance, even if
    all of them were of one label, is left out before pairs are counted; so no such pair is missed. Pairs of blocks of
    terms are counted as products of 0/1 matrices, in Spark's tasks if there is a session."""
    n, n_terms, n1, share = len(label), len(alone), int(label.sum()), label.mean()
    size, sure = np.array([len(p) for p in parts], float), 1 / (2 * n)
    none = np.zeros(n_terms)
    best = np.maximum(_deviance(none, toxic, share, share), _deviance(clean, none, share, share))
    best[alone] = np.inf
    free = int((~alone & (best >= LEAST_Z2)).sum())
    least = max(LEAST_Z2, 2 * np.log(max(1, free * (free - 1) / 2 + alone.sum() * n_terms)))
    some = np.flatnonzero(best >= least)
    place = np.full(n_terms, -1, np.int32)
    place[some] = np.arange(len(some))
    term, row = place[np.concatenate(parts)], np.repeat(np.arange(n), size.astype(int))
    term, row = term[term >= 0], row[term >= 0]
    bits = np.zeros((len(some), n), bool)
    bits[term, row] = True
    with np.errstate(divide="ignore", invalid="ignore"):
        own = [np.bincount(term, w * (row < n1), len(some)) / np.bincount(term, w, len(some)) for w in (np.ones(len(row)), size[row])]
    own = np.clip([np.minimum(*own), np.maximum(*own)], sure, 1 - sure)
    overall = np.clip(sorted([share, (label * size**2).sum() / max(1, (size**2).sum())]), sure, 1 - sure)
    pairs = _Pairs(np.packbits(bits[:, :n1], axis=1), np.packbits(bits[:, n1:], axis=1), own, overall, alone[some], least)
    blocks = [(i, j) for i in range(0, len(some), _BLOCK) for j in range(0, i + 1, _BLOCK)]
    if spark and len(blocks) > 1:
        shared = spark.sparkContext.broadcast(pairs)  # a bit for each term and row of a bounded sample

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for i, j in zip(pdf["i"].tolist(), pdf["j"].tolist(), strict=True):
                    yield pd.DataFrame({"term": shared.value.beyond(i, j)})

        dealt = spark.createDataFrame(blocks, "i int, j int").repartition(len(blocks), "i", "j")
        found = np.array([r["term"] for r in dealt.mapInPandas(run, "term long").distinct().collect()], np.int64)
        shared.destroy()
    else:
        found = np.concatenate([np.empty(0, np.int64), *(pairs.beyond(i, j) for i, j in blocks)])
    out = np.zeros(n_terms, bool)
    out[some[found]] = True
    return out & ~alone


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, pair_rows: int = PAIR_ROWS, least_z2: float = LEAST_Z2, least_rows: int = LEAST_ROWS) -> Model:
    """Fits the machine on (doc_id, text) and (doc_id, toxic)."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))  # bounded by train_rows
    schema = pa.schema([("toxic", pa.int32()), ("doc_id", pa.int64()), ("buckets", pa.binary()), ("words", pa.binary())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in words.pieces(batch):
                bucket, row = _terms(data, offsets)
                columns = []
                whole = slice(len(bucket) // (1 + len(_STEM_BYTES)))  # whole words come first
                for key in (_met(row, bucket), words.distinct(row[whole] * BUCKETS + bucket[whole].astype(np.int64))):
                    of_row, distinct = np.divmod(key, BUCKETS)
                    first = np.searchsorted(of_row, np.arange(len(offsets)))
                    distinct = distinct.astype(np.int32)
                    columns.append(pa.array([distinct[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([rows.column(2), rows.column(0), *columns], schema=schema)

    seen = stored(docs.join(sample, "doc_id").select("doc_id", "text", "toxic").mapInArrow(extract, "toxic int, doc_id long, buckets binary, words binary"), "terms")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)]
        for pdf in frames:
            for kind in (0, 1):
                every = np.frombuffer(b"".join(pdf["buckets"][pdf["toxic"] == kind]), np.int32)
                found[kind] += np.bincount(every, minlength=BUCKETS)
        at = np.flatnonzero(found[0] + found[1])
        yield pd.DataFrame({"bucket": at, "clean": found[0][at], "toxic": found[1][at]})

    totals = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    place = np.full(BUCKETS, -1, np.int32)
    if not n0 or not n1:
        share = n1 / max(1, n0 + n1)
        return Model(place, float(np.clip(np.log((share + 1e-12) / (1 - share + 1e-12)), -30, 30)), np.zeros(1), np.zeros((1, FACTORS)))
    by_bucket = seen.select("toxic", "buckets").mapInPandas(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    # the square of z in a test that both labels have the term equally often
    both = (F.col("c") + F.col("t")) / (n0 + n1)
    gap = F.col("t") / n1 - F.col("c") / n0
    z2 = gap * gap / (both * (1 - both) * (1 / n0 + 1 / n1) + 1e-12)
    alone = by_bucket.where((F.col("c") + F.col("t") >= least_rows) & (z2 >= least_z2)).select("bucket").toPandas()["bucket"].to_numpy(np.int64)

    # the pairs: half of the rows toxic if there are as many
    of_toxic = min(n1, max(pair_rows // 2, pair_rows - n0))
    some = [(kind, seen.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(m)) for kind, m in ((1, of_toxic), (0, pair_rows - of_toxic))]
    rows = [(kind, np.frombuffer(r["words"], np.int32)) for kind, part in some for r in part.select("words").toLocalIterator()]  # at most pair_rows
    label = np.array([r[0] for r in rows], float)
    times = [np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)]
    for kind, r in rows:
        times[kind][r] += 1
    is_alone = np.zeros(BUCKETS, bool)
    is_alone[alone] = True
    met = np.flatnonzero(times[0] + times[1] >= least_rows)
    index = np.full(BUCKETS, -1, np.int32)
    index[met] = np.arange(len(met))
    parts = [index[r][index[r] >= 0] for _, r in rows]
    in_pairs = met[_paired(parts, label, times[0][met].astype(float), times[1][met].astype(float), is_alone[met], spark)]
    del rows, parts, times

    chosen = np.union1d(alone, in_pairs)
    place[chosen] = np.arange(len(chosen))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [place[np.frombuffer(b, np.int32)] for b in pdf["buckets"]]
            yield pd.DataFrame({"toxic": pdf["toxic"], "terms": [r[r >= 0].tobytes() for r in rows]})

    # at most train_rows rows of chosen terms; one part at a time passes through the driver's JVM
    rows = sorted(((r["toxic"], bytes(r["terms"])) for r in seen.select("toxic", "buckets").mapInPandas(project, "toxic int, terms binary").toLocalIterator()), key=lambda r: (-r[0], r[1]))
    label = np.array([r[0] for r in rows], float)
    parts = [np.frombuffer(r[1], np.int32) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return Model(place, *_fit(np.concatenate(parts), first, label, max(1, len(chosen))))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    ready(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in words.pieces(batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.scores(*model.rows(data, offsets)))], schema=schema)

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Trains and scores; options are those of ``train``."""
    ready(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(source, train(source, labels, **options))


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    bad = score_documents(docs, labels, **options).where("predicted = 1").select(F.col("doc_id").alias("__toxic"))
    return docs.join(bad, docs["doc_id"] == bad["__toxic"], "left_anti")
