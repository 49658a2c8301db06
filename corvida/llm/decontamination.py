"""Benchmark decontamination: short test items inside long documents.

Containment search by MinHash over size partitions. An item of n shingles counts as found
when a document has at least 75 % of them. Items are partitioned by size, [2^k, 2^(k+1))
shingles. Within a partition an item's signature is its smallest shingles under one random
order of all shingles (bottom-k MinHash), with k one more than a quarter of the partition's
largest size. A document that has 75 % of the item's shingles misses fewer than k of them,
so it has at least one of the signature: the search loses nothing. Documents too small for a
partition are not compared with it.

Candidates are verified by the containment of the shingles themselves, as strings.

Only DataFrame functions: documents are split, hashed and compared inside the JVM. The
signatures and the items' shingles are broadcast while they are under a checked number of
rows, and joined by a shuffle beyond that. Texts are read twice and never shuffled, unless
the candidates are too many to broadcast their ids.

Cases: null and empty texts, and documents and items under five words, have no 5-word
shingle and are never found; equal items are found each for itself; a repeated row of a
document is reported once; an empty table on either side gives no rows; other columns are
ignored here and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.session import stored

SHINGLE = 5
CONTAINMENT = 0.75
#: Rows up to which items' shingles (at most some 100 bytes each) and candidates' ids are broadcast.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    """The lower-case words, between runs of ASCII white space."""
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _runs(values: Column, of: Column, one) -> Column:
    """one(slice of SHINGLE values) at each place of an array that is at least that long."""
    places = F.sequence(F.lit(1), F.size(of) - (SHINGLE - 1))
    return F.transform(places, lambda i: one(F.slice(values, i, SHINGLE)))


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _item_shingles(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item (a hash of id and shingles), item_id, shingle, hash, n_item: the distinct shingles of every
    item. Items of one id but other texts, or without id, stay apart; equal ones are one."""
    with_words = items.select(F.col(item_id).alias("item_id"), _words(F.col(text)).alias("w")).where(F.size("w") >= SHINGLE)
    strings = F.array_distinct(_runs(F.col("w"), F.col("w"), lambda x: F.array_join(x, " ")))
    found = with_words.select("item_id", strings.alias("s"))
    found = found.withColumn("item", F.xxhash64("item_id", F.col("item_id").isNull(), F.sort_array("s"))).dropDuplicates(["item"])
    found = found.select("item", "item_id", F.size("s").cast("long").alias("n_item"), F.explode("s").alias("shingle"))
    # the same hash as of a slice of hashed words
    return found.withColumn("hash", F.xxhash64(F.transform(F.split("shingle", " "), lambda w: F.xxhash64(w))))


def signatures(shingles: DataFrame) -> DataFrame:
    """item, hash, least: the signature shingles, and the fewest shingles that a document
    with any item of the partition has."""
    top = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    ordered = F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(41), "hash").alias("order"), "hash")))
    per_item = shingles.groupBy("item", "n_item").agg(ordered.alias("all"))
    k = F.floor(top * (1 - CONTAINMENT)).cast("int") + 1
    per_item = per_item.withColumn("sig", F.slice("all", 1, k))
    least = F.ceil(((top + 1) / 2) * CONTAINMENT).cast("int").alias("least")
    return per_item.select("item", least, F.explode("sig.hash").alias("hash"))


def _key(doc_id: str, text: str) -> Column:
    """What tells documents apart, those without doc_id or with that of another too."""
    return F.xxhash64(doc_id, F.col(doc_id).isNull(), text)


def _found(docs: DataFrame, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Of docs (doc, doc_id, text): doc, doc_id, item_id, n_item, n_shared, a row for each item in a document."""
    shingles = stored(_item_shingles(items, item_id, item_text), "item-shingles")
    sig = _small(signatures(shingles))

    worded = docs.select("doc", _words(F.col("text")).alias("w")).where(F.size("w") >= SHINGLE)
    hashed = worded.select("doc", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    runs = hashed.select("doc", (F.size("h") - (SHINGLE - 1)).alias("n"), F.explode(_runs(F.col("h"), F.col("h"), F.xxhash64)).alias("hash"))
    candidates = stored(runs.join(sig, "hash").where("n >= least").select("doc", "item").distinct(), "candidates")

    again = docs.join(_small(candidates.select("doc").distinct()), "doc", "left_semi")
    worded = again.select("doc", "doc_id", _words(F.col("text")).alias("w"))
    strings = worded.select("doc", "doc_id", F.explode(_runs(F.col("w"), F.col("w"), lambda x: F.array_join(x, " "))).alias("shingle"))
    shared = strings.join(_small(shingles.select("shingle", "item", "item_id", "n_item")), "shingle")
    shared = shared.groupBy("doc", "doc_id", "item", "item_id", "n_item").agg(F.count_distinct("shingle").alias("n_shared"))
    return shared.where(F.col("n_shared") >= F.col("n_item") * CONTAINMENT).join(candidates, ["doc", "item"])


def contained(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """A row for each item found in a document: doc_id, item_id, n_item, n_shared, containment.
    Rows that would be equal, of repeated documents or items, are given once."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("doc", _key("doc_id", "text"))
    found = _found(docs, items, item_id, item_text)
    return found.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item is found, with all their columns; those without doc_id are told apart by their texts."""
    keyed = docs.select("doc_id", "text").withColumn("doc", _key("doc_id", "text"))
    found = _found(keyed, items, "item_id", "text").select(F.col("doc").alias("__found")).distinct()
    return docs.join(found, _key("doc_id", "text") == F.col("__found"), "left_anti")
