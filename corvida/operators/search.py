"""Document search over a stored inverted index, with a bound for each block of documents.

``build`` writes the index: postings (term, block, doc_id, tf) in the order of term and block, so
that a search reads the row groups of its terms, and maxima (term, block, the largest tf, the
number of documents). Documents are dealt to blocks of about ``BLOCK`` by a hash of doc_id.

A document's score is the sum of tf * idf * weight over the terms of the search that it has.
No document of a block scores above the block's bound, the same sum over its largest tf. A
search with a limit scores the blocks with the largest bounds first; the last score that would
be in the result is a threshold for all other blocks, and those with a lower bound are not read.

Cases: null or empty texts are in no posting; repeated rows of a doc_id add up; rows without
doc_id are one document; terms that no document has give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.functions import text as T
from corvida.session import scratch_path

BLOCK = 1024
#: Blocks scored before the threshold is known.
FIRST = 8
MATCH_TYPES = ("exact", "conceptual", "both")


class Index:
    """An index in a folder; ``build`` writes one, the constructor opens one that is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.n_docs = spark.read.parquet(f"{path}/stats").first()["n_docs"]

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema("term string, block int, doc_id long, tf int").parquet(f"{self.path}/postings")

    @property
    def maxima(self) -> DataFrame:
        return self.spark.read.schema("term string, block int, most int, n long").parquet(f"{self.path}/maxima")

    def idf(self, terms: list[str]) -> dict[str, float]:
        """ln((1 + documents) / (1 + documents with the term)) + 1, of the terms that are there."""
        rows = self.maxima.where(F.col("term").isin(terms)).groupBy("term").agg((F.ln(F.lit(1 + self.n_docs) / (1 + F.sum("n"))) + 1).alias("idf"))
        return {r["term"]: r["idf"] for r in rows.collect()}  # a row for each term of the search

    def search(self, texts: list[str], related: dict[str, float] | None = None, limit: int | None = None, match_type: str = "both") -> DataFrame:
        """doc_id, match (exact or conceptual), score: documents with a term of ``texts`` (exact), or
        only with terms of ``related`` (term to weight; conceptual). The largest scores come first, ties by doc_id."""
        if match_type not in MATCH_TYPES:
            raise ValueError(f"match_type is one of {', '.join(MATCH_TYPES)}")
        exact = list(dict.fromkeys(texts))
        weights = {} if match_type == "exact" else {t: float(w) for t, w in (related or {}).items() if t not in exact}
        weights |= {t: 1.0 for t in exact}
        idf = self.idf(list(weights))
        gain = {t: w * idf[t] for t, w in weights.items() if t in idf}
        counted = {t: g for t, g in gain.items() if match_type != "conceptual" or t not in exact}
        if not counted:
            return self.spark.createDataFrame([], "doc_id long, match string, score double")
        if limit is None:
            return self._scored(gain, exact, match_type, None)
        bound = F.sum(F.col("most") * self._of(counted))
        bounds = self.maxima.where(F.col("term").isin(list(counted))).groupBy("block").agg(bound.alias("bound"))
        first = bounds.orderBy(F.desc("bound"), "block").limit(FIRST)
        best = self._scored(gain, exact, match_type, first).orderBy(F.desc("score"), "doc_id").limit(limit)
        found = best.agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).first()
        # scores are rounded to six places
        blocks = bounds if found["n"] < limit else bounds.where(F.col("bound") >= F.lit(found["least"] - 1e-6))
        return self._scored(gain, exact, match_type, blocks).orderBy(F.desc("score"), "doc_id").limit(limit)

    @staticmethod
    def _of(values: dict[str, float]) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("term"))

    def _scored(self, gain: dict[str, float], exact: list[str], match_type: str, blocks: DataFrame | None) -> DataFrame:
        rows = self.postings.where(F.col("term").isin(list(gain)))
        if blocks is not None:
            rows = rows.join(blocks.select("block"), "block", "left_semi")
        named = F.max(F.col("term").isin(exact)) if exact else F.lit(False)
        rows = rows.groupBy("doc_id").agg(F.round(F.sum(F.col("tf") * self._of(gain)), 6).alias("score"), named.alias("named"))
        if match_type != "both":
            rows = rows.where(F.col("named") if match_type == "exact" else ~F.col("named"))
        return rows.select("doc_id", F.when(F.col("named"), "exact").otherwise("conceptual").alias("match"), "score")


def build(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> Index:
    """Indexes (doc_id, text) and returns the index."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "search")
    n_docs = docs.count()
    blocks = max(1, -(-n_docs // block))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(T.word_tokens(F.col("text"))).alias("term"))
    rows = rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    rows = rows.select("term", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "tf")
    # a frequent term is cut between its blocks, so no task gets all its postings
    rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    spark.createDataFrame([(n_docs,)], "n_docs long").write.mode("overwrite").parquet(f"{path}/stats")
    postings = spark.read.schema("term string, block int, doc_id long, tf int").parquet(f"{path}/postings")
    maxima = postings.groupBy("term", "block").agg(F.max("tf").alias("most"), F.count(F.lit(1)).alias("n"))
    maxima.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/maxima")
    return Index(spark, path)


def copied(docs: DataFrame, path: str, where: Column | None = None, hits: DataFrame | None = None, mode: str = "overwrite") -> DataFrame:
    """Copies the documents that pass a filter and are among the hits of a search, with all their columns, into a
    new table or onto an existing one (mode ``append``); returns the table."""
    rows = docs if where is None else docs.where(where)
    if hits is not None:
        rows = rows.join(hits.select(F.col("doc_id").alias("__hit")), F.col("doc_id").eqNullSafe(F.col("__hit")), "left_semi")
    rows.write.mode(mode).parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)
