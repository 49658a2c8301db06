"""Mixing sources to target weights: a low-discrepancy schedule over blocks of equal tokens.

1. Sizes in words are summed for each source. Sources get weights in turn, and a share of
   ``share`` of all words by weight. No target is over ``most`` times its source's size: what
   is over goes to the other sources by weight, until none is above.
2. A source's documents are shuffled (by a hash of doc_id) and laid one after another on a
   line, which is cut into blocks of ``block`` words; a target is so many blocks, the line
   starting anew after its end.
3. Slot i of the schedule has the van der Corput point of i, its bits reversed. The points are
   mapped through the sources' cumulative numbers of blocks, so in every stretch of the
   schedule each source has its share of slots to within a few.
4. The rank of a slot among its source's slots is the number of earlier points in the source's
   interval. Earlier slots fall into one run of 2^k slots for each set bit k of i; the points of
   such a run are evenly spaced, so how many are in the interval is a division. No slot has to
   see another one.
5. Slot and document meet in the block: rank r takes block r modulo the source's blocks.

All of it is DataFrame functions. Running sums over a source, a hot one too, are taken in
buckets of the shuffle's hash with the sums of the buckets before added.

Cases: a null or empty text has size 0 and is never taken. A null source is a source of its
own, the last. Rows without doc_id are shuffled by a hash of their text; repeated rows are
mixed each for itself. An empty table gives no rows; a text longer than a block is spread
over blocks; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.llm.common import ROW, numbered
from corvida.session import ready, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 2048
#: Rows of a source that a bucket of the shuffle holds, about.
BUCKET = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 1) -> DataFrame:
    """A row for each document: ROW (kept where docs has it), doc_id, source, size, place (its hash in the shuffle)."""
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id().alias(ROW)
    key = F.coalesce(F.col(doc_id).cast("long").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(text, F.lit("")))))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(row, F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), key)).alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row for each source: source, source_size, n_rows, rank, weight, target.

    The driver sees sums over sources, never the sources: each round raises the level until no
    further source meets its bound."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    # a row for each source: numbering them is small beside the documents
    found = found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))) + 1)
    found = stored(found.withColumn("weight", weight.cast("long")), "sources")
    bound, level, before = F.col("source_size") * most, None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > bound
        total, held, free, n_full = found.agg(F.sum("source_size"), F.sum(F.when(full, bound)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if n_full == before:
            break
        level, before = (share * (total or 0) - (held or 0)) / free if free else level, n_full
    return found.withColumn("target", F.least(F.col("weight") * F.lit(float(level or 0)), bound.cast("double")))


def reversed_bits(x: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of x in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("long")


def earlier(point: Column, slot: Column, low: Column, high: Column, bits: int) -> Column:
    """How many of the slots before ``slot`` have their point in [low, high); ``point`` is that of ``slot``.

    For each set bit k of slot there is a run of 2^k earlier slots that agree with it above bit k
    and have bit k clear: their points are d, d + step, d + 2 step, ... with step 2^(bits - k)
    and d the lowest bits - k - 1 bits of ``point``."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        d = point.bitwiseAND(F.lit((1 << (bits - 1 - k)) - 1).cast("long"))
        up = lambda x, k=k, d=d: F.shiftright(x - d + F.lit((1 << (bits - k)) - 1).cast("long"), bits - k)
        out = out + F.shiftright(slot, k).bitwiseAND(F.lit(1).cast("long")) * (up(high) - up(low))
    return out


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots: slot (their order), rank (the source's number), turn (among its source's slots),
    block, take (words; below the block's only in a source's last slot)."""
    spark = sources.sparkSession
    size, words = F.col("source_size"), F.floor("target").cast("long")
    blocks = F.ceil(size / F.lit(block)).cast("long")
    whole = F.when(size > 0, F.floor(words / size)).otherwise(0).cast("long")
    left = words - whole * size
    plan = sources.where(size > 0).select("rank", "source_size", blocks.alias("blocks"), (whole * blocks + F.ceil(left / F.lit(block)).cast("long")).alias("slots"), whole.alias("whole"), left.alias("left"))
    total, n = plan.agg(F.sum("slots"), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], "slot long, rank int, turn long, block long, take long")
    bits = max(1, (total - 1).bit_length())
    cells = min(bits, max(6, n.bit_length() + 4))
    # each source has an interval of the 2^bits points: cut at whole numbers it still holds its slots, as 2^bits is not less than their sum
    until = F.sum("slots").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = lambda x: f"cast(({x}) as decimal(19,0)) * {1 << bits} div {total}"
    plan = plan.withColumn("until", until).select("*", F.expr(share("until - slots")).alias("low"), F.expr(share("until")).alias("high"))
    wide = bits - cells
    intervals = plan.where("high > low").withColumn("cell", F.explode(F.sequence(F.shiftright("low", wide), F.shiftright(F.col("high") - 1, wide))))
    slots = spark.range(1 << bits).select(F.col("id").alias("slot"), reversed_bits(F.col("id"), bits).alias("point")).withColumn("cell", F.shiftright("point", wide))
    # every cell has the same number of slots, so no cell is hot; Spark broadcasts the intervals if they are small
    met = slots.join(intervals, "cell").where("point >= low and point < high")
    met = met.withColumn("turn", earlier(F.col("point"), F.col("slot"), F.col("low"), F.col("high"), bits)).where("turn < slots")
    at = F.pmod("turn", "blocks")
    last = F.col("turn") == F.col("whole") * F.col("blocks") + F.floor(F.col("left") / F.lit(block))
    held = F.least(F.lit(block).cast("long"), F.col("source_size") - at * block)
    return met.select("slot", "rank", "turn", at.alias("block"), F.when(last, F.col("left") % block).otherwise(held).alias("take"))


def pieces(sizes: DataFrame, sources: DataFrame, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """What every block holds: rank, block, at (in the block), ROW, doc_id, start (in the document), length."""
    most = sources.agg(F.max("n_rows")).first()[0] or 0
    bits = min(24, max(0, (most // bucket).bit_length()))
    number = F.shiftright(F.conv(F.substring("place", 1, 6), 16, 10).cast("long"), 24 - bits)
    # sources are a row each; where they are too many to broadcast, a hot one is split as a skewed join
    rows = sizes.where("size > 0").withColumnRenamed("source", "s").join(sources.select("source", "rank"), F.col("s").eqNullSafe(F.col("source")))
    rows = rows.select("rank", number.alias("bucket"), ROW, "doc_id", "size", "place")
    # one row for each source and bucket
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("held"))
    base = sums.select("rank", "bucket", F.coalesce(F.sum("held").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("rank", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(inside)).join(base, ["rank", "bucket"])
    rows = rows.select("rank", ROW, "doc_id", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("first"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))))
    begin = F.greatest(F.col("first"), F.col("block") * block)
    end = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block)
    return rows.select("rank", "block", (begin - F.col("block") * block).alias("at"), ROW, "doc_id", (begin - F.col("first")).alias("start"), (end - begin).alias("length"))


def mixed(sizes: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: slot, at (in the slot), ROW, doc_id, start and length of the words taken."""
    met = schedule(sources, block).join(pieces(sizes, sources, block), ["rank", "block"])
    return met.where("at < take").select("slot", "rank", "at", ROW, "doc_id", "start", F.least(F.col("length"), F.col("take") - F.col("at")).alias("length"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", block: int = BLOCK, seed: int = 1) -> DataFrame:
    """The mixed words themselves: slot, at, doc_id, start, length, words (an array); ordered by slot and at they are the mix."""
    ready(docs.sparkSession)
    rows = numbered(docs.select(text, doc_id, source))
    sizes = stored(sized(rows, text, doc_id, source, seed), "sizes")
    out = mixed(sizes, stored(targets(sizes), "targets"), block).join(rows.select(ROW, F.col(text).alias("text")), ROW)
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.col("start").cast("int") + 1, F.col("length").cast("int"))
    return out.select("slot", "at", "doc_id", "start", "length", words.alias("words"))


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken."""
    ready(docs.sparkSession)
    sizes = stored(sized(docs, seed=seed), "sizes")
    sources = stored(targets(sizes, weights, share, most), "targets")
    sums = mixed(sizes, sources, block).groupBy(ROW).agg(F.sum("length").alias("taken"))
    out = sizes.join(sums, ROW, "left")
    out = out.withColumnRenamed("source", "s").join(sources, F.col("s").eqNullSafe(F.col("source")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
