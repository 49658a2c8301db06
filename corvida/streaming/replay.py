"""Sends a stored table again as a stream: batches of random size, round and round.

The source gives positions only, a few a batch; the rows at those positions are read from a
table that is sorted by them. Its offset is (batch, position), so a stream that starts again
goes on where it was, and the same seed gives the same batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from corvida.operators import numbering
from corvida.session import ready, scratch_path

MOST = 15


def _number(text: str, digits: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


class Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.seed, self.rows, self.batches = options["seed"], int(options["rows"]), int(options["batches"])
        self.most, self.start = int(options.get("most", MOST)), int(options.get("start", -1))

    def initialOffset(self) -> dict:
        """The start that was asked for, else one that the seed gives."""
        return {"batch": 0, "at": self.start if self.start >= 0 else _number(self.seed, 8) % max(1, self.rows)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        batch, at = start["batch"], start["at"]
        if batch >= self.batches or not self.rows:
            return iter(()), start
        size = 1 + _number(f"{self.seed}-{batch}", 6) % self.most
        return iter([((at + i) % self.rows, batch, i) for i in range(size)]), {"batch": batch + 1, "at": (at + size) % self.rows}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start["batch"] < end["batch"]:
            rows, start = self.read(start)
            yield from rows

    def commit(self, end: dict) -> None:
        pass


class Replay(DataSource):
    """Options: rows (of the table), batches, seed, most (rows a batch), start (a position)."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "pos long, batch long, place int"

    def simpleStreamReader(self, schema) -> Reader:
        return Reader(dict(self.options))


def replayed(rows: DataFrame, order: list[str], seed: int = 1, batches: int = 10, most: int = MOST, start: int | None = None, path: str | None = None) -> DataFrame:
    """The rows that ``batches`` batches send, with batch, pos (in the table) and place (in the batch). A run
    on the same ``path`` goes on with the batches that are not there yet."""
    spark = ready(rows.sparkSession)
    spark.dataSource.register(Replay)
    path = path or scratch_path(spark, "replay")
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        table = numbering.numbered(rows, *order, name="pos").withColumn("pos", F.col("pos") - 1)
        table.repartitionByRange("pos").sortWithinPartitions("pos").write.mode("overwrite").parquet(f"{path}/rows")
    table = spark.read.parquet(f"{path}/rows")
    n = table.count()
    sent = f"{path}/sent"

    def send(found: DataFrame, number: int) -> None:
        got = found.collect()  # at most ``most`` positions
        picked = found.sparkSession.createDataFrame(got, "pos long, batch long, place int")
        # positions as a filter, so that only their row groups are read
        near = table.where(F.col("pos").isin([r["pos"] for r in got])) if got else table.limit(0)
        near.join(F.broadcast(picked), "pos").write.mode("overwrite").parquet(f"{sent}/trigger={number}")

    options = {"seed": str(seed), "rows": str(n), "batches": str(batches), "most": str(most)} | ({"start": str(start)} if start is not None else {})
    stream = spark.readStream.format("replay").options(**options).load()
    query = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime="0 seconds").foreachBatch(send).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    schema = StructType([*table.schema, *StructType.fromDDL("batch long, place int, trigger int")])
    return spark.read.schema(schema).parquet(sent).drop("trigger") if n and batches else spark.createDataFrame([], schema).drop("trigger")
