"""Resharding by minimum-cost flow.

A store is a folder of files, each in one shard. Given the sizes of the old shards and the
capacities of the new ones, a minimum-cost flow decides how many bytes go from each old
shard to each new one; staying costs nothing and a moved byte costs one, so the plan moves
the fewest bytes. The flow has a node for each shard, however many rows there are.

Each old shard's files, one after another, are then cut into the runs of bytes that the flow
asks for. A file that lies in a run that stays is not touched. Files that move are read and
written to their new shard as they are; only the few files that a cut goes through (less
than old plus new shards) are split by rows. Nothing is sorted or shuffled but those. Their
smallest rows then even out what long rows at the cuts have left uneven.

A row's slot is its place in its file plus the rows in its shard's files before it.

Cases: a null text has size 1, as an empty one; equal texts are placed each for itself; a
null source is a source; an empty table gives no rows; all columns of a row are kept in the
files, inside one struct, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvida.session import scratch_path, stored

SHARDS, OLD_SHARDS = 8, 8
ROWS_PER_FILE = 20_000
#: Files up to which the plan for them (some 200 bytes each) is broadcast.
BROADCAST_FILES = 200_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] of all supply to nodes with capacities, at the least total cost; by successive
    shortest paths in the residual network (Bellman-Ford, as its costs may be negative)."""
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are too small")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, free = list(supply), list(capacity)
    while any(left):
        far = float("inf")
        at_i = [0 if left[i] else far for i in range(n)]
        at_j, from_j, from_i = [far] * m, [-1] * m, [-1] * n
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if at_i[i] + cost[i][j] < at_j[j]:
                        at_j[j], from_j[j], changed = at_i[i] + cost[i][j], i, True
                    if flow[i][j] and at_j[j] - cost[i][j] < at_i[i]:
                        at_i[i], from_i[i], changed = at_j[j] - cost[i][j], j, True
        end = min((j for j in range(m) if free[j]), key=lambda j: at_j[j])
        path, j = [], end
        while True:
            i = from_j[j]
            path.append((i, j, 1))
            if from_i[i] < 0:
                break
            path.append((i, from_i[i], -1))
            j = from_i[i]
        amount = min(left[path[-1][0]], free[end], *(flow[i][j] for i, j, sign in path if sign < 0))
        for i, j, sign in path:
            flow[i][j] += sign * amount
        left[path[-1][0]] -= amount
        free[end] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


class Store:
    """Rows in files: folders with files of rows (doc: all columns, size) in partitions by shard."""

    def __init__(self, spark: SparkSession, schema, paths: list[str]):
        self.spark, self.schema, self.paths = spark, schema, paths

    @classmethod
    def write(cls, docs: DataFrame, shard: Column, path: str, text: str = "text") -> Store:
        """Writes a table as it is dealt; each task writes a file for each shard it meets."""
        size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
        rows = docs.select(F.struct("*").alias("doc"), size.alias("size"), shard.cast("int").alias("shard"))
        cls._put(rows, path)
        return cls(docs.sparkSession, rows.schema, [path])

    @staticmethod
    def _put(rows: DataFrame, path: str) -> None:
        rows.write.partitionBy("shard").option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "zstd").parquet(path)

    def read(self, path: str) -> DataFrame:
        """The rows of one folder with the file and place each is in."""
        return self.spark.read.schema(self.schema).parquet(path).select("doc", "size", "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))

    def files(self, path: str) -> DataFrame:
        return self.read(path).groupBy("shard", "file").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_FILES else df


def _evened(cut: DataFrame, plan: DataFrame, capacities: list[int]) -> DataFrame:
    """A long row at a cut goes to one side whole, so shards miss their capacities by up to such a
    row. The smallest rows of the files that are split anyway make up for it: a second flow says how
    many bytes go from shards over their capacity to those under it."""
    has = [0] * len(capacities)
    whole = plan.where("new_shard is not null").groupBy(F.col("new_shard").alias("shard")).agg(F.sum("bytes").alias("b"))
    for r in whole.union(cut.groupBy("shard").agg(F.sum("size"))).collect():  # two rows a shard at most
        has[r["shard"]] += r["b"]
    over = [max(0, h - c) for h, c in zip(has, capacities, strict=True)]
    under = [max(0, c - h) for h, c in zip(has, capacities, strict=True)]
    if sum(over) > sum(under):
        return cut.select("doc", "size", "shard")
    runs = []
    for i, row in enumerate(min_cost_flow(over, under, [[1] * len(capacities)] * len(capacities))):
        at = 0
        for j, amount in enumerate(row):
            if amount:
                runs.append((i, at, at + amount, j))
                at += amount
    runs = F.broadcast(cut.sparkSession.createDataFrame(runs, "shard int, low long, high long, new_shard int"))  # a pair of shards a row
    # a number of files of a bounded number of rows
    end = F.sum("size").over(Window.partitionBy("shard").orderBy("size", "file", "place").rowsBetween(Window.unboundedPreceding, 0))
    rows = cut.withColumn("end", end).join(runs.withColumnRenamed("shard", "of"), (F.col("of") == F.col("shard")) & (F.col("end") - F.col("size") >= F.col("low")) & (F.col("end") <= F.col("high")), "left")
    return rows.select("doc", "size", F.coalesce("new_shard", "shard").alias("shard"))


def reshard(store: Store, capacities: list[int] | None = None, shards: int = SHARDS, cost: list[list[int]] | None = None, path: str | None = None) -> DataFrame:
    """Moves rows between shards and returns all rows of the new store: doc, size, shard, slot, moved.

    ``cost[i][j]`` is the price of a byte from old shard i to new shard j."""
    spark, old = store.spark, store.paths[0]
    files = stored(store.files(old), "files")
    sizes = {r["shard"]: r["b"] for r in files.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    supply = [sizes.get(i, 0) for i in range(max([*sizes, shards - 1]) + 1)]
    capacities = capacities or even_capacities(sum(supply), shards)
    cost = cost or [[int(i != j) for j in range(len(capacities))] for i in range(len(supply))]
    flow = min_cost_flow(supply, capacities, cost)

    runs = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):  # what stays comes first
            if row[j]:
                runs.append((i, at, at + row[j], j))
                at += row[j]
    runs = spark.createDataFrame(runs, "shard int, low long, high long, new_shard int")

    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    # the run that holds all of a file, if one does
    whole = placed.join(F.broadcast(runs), "shard", "left").where((F.col("start") >= F.col("low")) & (F.col("start") + F.col("bytes") <= F.col("high")))
    plan = stored(placed.join(whole.select("file", "new_shard"), "file", "left"), "plan")
    kept, moved = plan.where("new_shard = shard"), plan.where("new_shard <> shard")
    split = plan.where("new_shard is null")

    rows = store.read(old)
    as_they_are = rows.join(_small(moved.select("file", "new_shard")), "file").select("doc", "size", F.col("new_shard").alias("shard"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.drop("shard").join(F.broadcast(split.select("shard", "file", "start")), "file")  # fewer files than there are shards
    cut = cut.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = cut.join(F.broadcast(runs), "shard").where("low <= at and at < high").select("doc", "size", F.col("new_shard").alias("shard"), "file", "place")
    cut = _evened(stored(cut, "cut"), plan, capacities)
    new = path or scratch_path(spark, "resharded")
    Store._put(as_they_are.unionByName(cut), new)

    stay = rows.join(_small(kept.select("file")), "file", "left_semi").withColumn("moved", F.lit(False))
    written = Store(spark, store.schema, [new])
    came = written.read(new).withColumn("moved", F.lit(True))
    counts = kept.select("shard", "file", "rows").unionByName(written.files(new).select("shard", "file", "rows"))
    base = counts.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    now = stay.select(came.columns).unionByName(came)
    return now.join(_small(stored(base, "slots")), "file").select("doc", "size", "shard", (F.col("base") + F.col("place")).alias("slot"), "moved")


def sharded(docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Lays the table out by source, which makes shards of uneven sizes, and evens them out.
    Returns a row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    by_source = F.pmod(F.crc32(F.coalesce(F.col(source).cast("string"), F.lit("")).cast("binary")), F.lit(old_shards))
    store = Store.write(docs, by_source, scratch_path(docs.sparkSession, "store"), text)
    rows = reshard(store, shards=shards)
    read = F.coalesce(F.col(f"doc.{text}"), F.lit("")).cast("binary")
    return rows.select(F.col(f"doc.{doc_id}").cast("long").alias("doc_id"), (F.octet_length(read) + 1).cast("long").alias("size"), F.crc32(read).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
