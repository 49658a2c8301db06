"""Concept analytics over the order tables.

An order is a document, its lines are term occurrences, a part is a term. The parts of one
name are the exact terms of a concept; the other parts of the brand of the concept's first
part are its related terms. Part types are shared lists whose concepts are the brands
inside them. Return flags are sentiments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRING_FIELDS = ("order_priority", "order_status", "segment")
SCORE_FIELDS = ("account_balance", "total_price")


class Star:
    """The tables of one directory as documents, terms, metadata and concepts."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def docs(self) -> DataFrame:
        """doc_id, date, the score fields and the string fields."""
        orders = self.table("orders").join(self.table("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
        return orders.select(
            F.col("o_orderkey").alias("doc_id"),
            F.col("o_orderdate").alias("date"),
            F.col("o_totalprice").alias("total_price"),
            F.col("c_acctbal").alias("account_balance"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderpriority").alias("order_priority"),
            F.col("c_mktsegment").alias("segment"),
        )

    def terms(self) -> DataFrame:
        """doc_id, term, pos, sentiment, confidence: every term occurrence in the order of its document."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
        sentiment = F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "N", "neutral").when(F.col("l_returnflag") == "R", "negative")
        return self.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("term"), F.row_number().over(w).alias("pos"), sentiment.alias("sentiment"), (F.col("l_discount") * 10).alias("confidence"))

    def concept_terms(self) -> DataFrame:
        """concept, term, exact (1 or 0): the terms of the concepts by name."""
        part = self.table("part").select("p_partkey", "p_name", "p_brand")
        first = part.groupBy(F.col("p_name").alias("concept")).agg(F.min_by("p_brand", "p_partkey").alias("brand"))
        related = first.join(part, (F.col("p_brand") == F.col("brand")) & (F.col("p_name") != F.col("concept")))
        exact = part.select(F.col("p_name").alias("concept"), F.col("p_partkey").alias("term"), F.lit(1).alias("exact"))
        return exact.union(related.select("concept", F.col("p_partkey"), F.lit(0)))

    def list_terms(self) -> DataFrame:
        """list, concept, term, exact: the shared lists; all their terms are exact."""
        return self.table("part").select(F.col("p_type").alias("list"), F.col("p_brand").alias("concept"), F.col("p_partkey").alias("term"), F.lit(1).alias("exact"))

    def metadata(self, types: tuple[str, ...] = ("string",)) -> DataFrame:
        """doc_id, field, type, value: the metadata as a long table."""
        docs, parts = self.docs(), []
        names = {"string": STRING_FIELDS, "score": SCORE_FIELDS, "date": ("date",)}
        fields = [(f, t) for t in types for f in names[t]]
        for f, t in fields:
            value = F.date_format(f, "yyyy-MM-dd") if t == "date" else F.col(f).cast("string")
            parts.append(F.struct(F.lit(f).alias("field"), F.lit(t).alias("type"), value.alias("value")))
        rows = docs.select("doc_id", F.explode(F.array(*parts)).alias("m"))
        return rows.select("doc_id", "m.field", "m.type", "m.value").where("value is not null")
