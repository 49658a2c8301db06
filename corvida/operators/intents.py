"""Intent discovery: terms that stand for what people want, and pairs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvida.functions import vectors as V

TERMS, PAIR_TERMS, RELATED, SAME = 1000, 75, 0.6, 0.98
#: Parts of an intent at least this alike say the same; a document above the score gets a label.
PARTS_ALIKE, LABEL_ABOVE = 0.9, 0.5


def _crossed(terms: DataFrame) -> DataFrame:
    """All pairs of the chosen terms; there are at most TERMS of them."""
    few = terms.orderBy(F.desc("relevance"), "term").limit(TERMS)
    other = few.select(F.col("term").alias("term2"), F.col("vector").alias("vector2"))
    return few.crossJoin(F.broadcast(other)).withColumn("cosine", V.dot(F.col("vector"), F.col("vector2")))


def scores(terms: DataFrame) -> DataFrame:
    """Of (term, relevance, exact_match_count, vector): the intent score
    (1 + is a phrase) * relevance / matches * (1 - dispersion) * (phrases that hold it + 1)."""
    dispersion = _crossed(terms).groupBy("term").agg(F.stddev_pop((F.col("cosine") > RELATED).cast("double")).alias("dispersion"))
    phrase = F.size(F.split("term", " ")) > 1
    inside = terms.where(phrase).select(F.explode(F.split("term", " ")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("collocations"))
    rows = terms.join(dispersion, "term").join(inside, "term", "left").withColumn("collocations", F.coalesce("collocations", F.lit(0)).cast("long"))
    score = (1 + phrase.cast("int")) * F.try_divide("relevance", "exact_match_count") * (1 - F.col("dispersion")) * (F.col("collocations") + 1)
    return rows.select("term", "vector", "relevance", phrase.cast("int").alias("collocation"), "collocations", F.round("dispersion", 6).alias("dispersion"), F.round(score, 6).alias("intent_score"))


def pairs(scored: DataFrame, threshold: float = 1.0, first: int = PAIR_TERMS, generic: bool = False) -> DataFrame:
    """name, text: each of the first terms with every term of a score above the threshold that is related but not the same."""
    top = scored.orderBy(F.desc("intent_score"), "term").limit(first)
    other = scored.where(F.col("intent_score") > threshold).orderBy(F.desc("intent_score"), "term").limit(TERMS)
    other = other.select(F.col("term").alias("term2"), F.col("vector").alias("vector2"))
    rows = top.crossJoin(F.broadcast(other)).where(V.dot(F.col("vector"), F.col("vector2")).between(RELATED + 1e-12, SAME - 1e-12))
    out = rows.select(F.concat_ws("-", "term", "term2").alias("name"), F.concat_ws(" ", "term", "term2").alias("text"))
    if generic:
        alone = top.select(F.concat(F.lit("general-"), "term").alias("name"))
        out = out.unionByName(alone.withColumn("text", F.col("name")))
    return out


def different(named: DataFrame, order: list[str], threshold: float = 0.998) -> DataFrame:
    """Of (name, vector, ...) the rows that no earlier row is that similar to, whether that one stays or not.

    Proposed intents are few: at most PAIR_TERMS times TERMS, compared in blocks of a thousand earlier rows."""
    numbered = named.withColumn("at", F.row_number().over(Window.orderBy(*order)))  # as many as the proposals
    earlier = numbered.select(F.struct(F.col("at").alias("a"), F.col("vector").alias("v")).alias("e"), F.floor(F.col("at") / 1000).alias("block"))
    blocks = earlier.groupBy("block").agg(F.collect_list("e").alias("es"), F.min("e.a").alias("first"))
    same = F.exists("es", lambda e: (e["a"] < F.col("at")) & (V.dot(e["v"], F.col("vector")) >= threshold))
    bad = numbered.join(blocks, F.col("first") < F.col("at")).where(same).select("at").distinct()
    return numbered.join(bad, "at", "left_anti").drop("at")


def without_duplicates(scored: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Drops a term if any better one is that similar, whether that one stays or not."""
    ranked = scored.orderBy(F.desc("intent_score"), "term").limit(TERMS)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("intent_score"), "term")))  # at most TERMS rows
    better = ranked.select(F.col("rank").alias("r2"), F.col("vector").alias("v2"))
    bad = ranked.join(F.broadcast(better), (F.col("r2") < F.col("rank")) & (V.dot(F.col("vector"), F.col("v2")) >= threshold), "left_semi")
    return ranked.join(bad.select("term"), "term", "left_anti")


def document_scores(doc_terms: DataFrame, terms: DataFrame, intents: DataFrame) -> DataFrame:
    """Of (doc_id, term), (term, vector) and (intent, part, vector): doc_id, intent, the mean over
    the intent's parts of the largest cubed similarity of any of the document's terms."""
    order = [tuple(r) for r in intents.select("intent", "part").distinct().orderBy("intent", "part").collect()]  # as many as the definitions
    cube = F.pow(V.dot(F.col("vector"), F.col("part_vector")), F.lit(3.0))
    parts = intents.select("intent", "part", F.col("vector").alias("part_vector"))
    table = terms.crossJoin(F.broadcast(parts)).select("term", "intent", "part", cube.alias("s"))  # terms are few: one row for each concept
    at = lambda i, p: F.col("intent").eqNullSafe(F.lit(i)) & F.col("part").eqNullSafe(F.lit(p))
    largest = [F.max(f"s{k}").alias(f"s{k}") for k in range(len(order))]
    # terms of a document are brought together once; what follows stays where they are
    rows = doc_terms.groupBy("doc_id").agg(F.collect_set("term").alias("terms")).select("doc_id", F.explode("terms").alias("term"))
    kind = intents.schema["intent"].dataType
    if not order:
        return rows.select("doc_id", F.lit(None).cast(kind).alias("intent"), F.lit(None).cast("double").alias("score")).limit(0)
    wide = table.groupBy("term").agg(*(F.max(F.when(at(*x), F.col("s"))).alias(f"s{k}") for k, x in enumerate(order)))
    best = rows.join(F.broadcast(wide), "term").groupBy("doc_id").agg(*largest)
    means = []
    for intent in dict.fromkeys(i for i, _ in order):
        own = [F.col(f"s{k}") for k, (i, _) in enumerate(order) if i == intent]
        total = sum((F.coalesce(c, F.lit(0.0)) for c in own), F.lit(0.0))
        n = sum((c.isNotNull().cast("int") for c in own), F.lit(0))
        means.append(F.struct(F.lit(intent).cast(kind).alias("intent"), F.try_divide(total, n).alias("score"), (n > 0).alias("met")))
    return best.select("doc_id", F.inline(F.array(*means))).where("met").drop("met")


def kept(intents: DataFrame, threshold: float = PARTS_ALIKE) -> DataFrame:
    """The rows (intent, part, vector) of the intents that have one part or two parts less alike than the threshold.

    An intent is defined by a handful of texts, so its vectors stand in one array. Like in a matrix of all
    products each vector meets itself too. Rows without an intent or a vector go; repeated parts count once."""
    rows = intents.dropna(subset=["intent", "vector"]).dropDuplicates(["intent", "part"])
    vectors = rows.groupBy("intent").agg(F.collect_list("vector").alias("v"))
    least = F.array_min(F.flatten(F.transform("v", lambda a: F.transform("v", lambda b: V.dot(a, b)))))
    return rows.join(vectors.where((F.size("v") == 1) | (least < threshold)).select("intent"), "intent", "left_semi")


def labelled(scored: DataFrame, labels: list, threshold: float = LABEL_ABOVE, prefix: str = "") -> DataFrame:
    """doc_id, intent, score and a column for each label, of (doc_id, intent, score): the documents whose best
    score is above the threshold, with the best intent, the first in the order of ``labels`` on a tie.

    ``labels`` names the columns, so they are as many as the caller's definitions; intents not among them,
    null scores and documents without an id are left out. A label without a score in a document is null there."""
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("intent")) if labels else F.lit(0)
    rows = scored.dropna(subset=["doc_id", "intent", "score"]).withColumn("place", place).where("place > 0")
    wide = [F.max(F.when(F.col("place") == i + 1, F.col("score"))).alias(f"{prefix}{name}") for i, name in enumerate(labels)]
    out = rows.groupBy("doc_id").agg(F.max_by("intent", F.struct("score", -F.col("place"))).alias("intent"), F.max("score").alias("score"), *wide)
    return out.where(F.col("score") > threshold)


def neighbour_scores(terms: DataFrame, lexicon: DataFrame, n: int = 5) -> DataFrame:
    """Of (term, vector) and (term, sentiment): the mean sentiment of the n most similar known terms, weighted by similarity."""
    known = terms.join(lexicon.where("sentiment <> 0"), "term").select(F.col("term").alias("known"), F.col("vector").alias("kv"), "sentiment")
    rows = terms.crossJoin(F.broadcast(known)).where("term <> known").withColumn("cosine", V.dot(F.col("vector"), F.col("kv")))  # both within TERMS
    rn = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("cosine"), "known"))
    best = rows.withColumn("rn", rn).where(F.col("rn") <= n)
    return best.groupBy("term").agg(F.round(F.sum(F.col("cosine") * F.col("sentiment")) / F.sum("cosine"), 2).alias("classifier_score"))
