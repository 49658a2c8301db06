"""Streams over files of events: windows, retention by count and by time, filters, replay.

Each job runs until what is there has been read (``availableNow``) and returns the table that
it has kept in the shared folder; the same functions take a live source.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from corvida.operators.numbering import numbered
from corvida.session import scratch_path, stored

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEEP, WINDOWS = 997, (50, 25_000)


def source(spark: SparkSession, folder: str, name: str = "events.parquet", schema: str = EVENTS, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _run(stream: DataFrame, start: Callable, path: str) -> None:
    query = start(stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True))
    query.awaitTermination()


def appended(stream: DataFrame, name: str) -> DataFrame:
    """Writes a stream to Parquet and reads what it wrote."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, name)
    _run(stream, lambda w: w.outputMode("append").format("parquet").option("path", f"{path}/data").start(), path)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events and their value for each window and type; a window is given out once no event of
    it can come any more. Windows tumble, or slide if a slide is given."""
    w = F.window("ts", window, slide or window)
    rows = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, which a gap without events ends."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "n")


def _versions(spark: SparkSession, path: str, below: int) -> list[str]:
    """The finished versions of a table under that number, the newest last; what is in the folder decides, not this process."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in system.listStatus(where)] if system.exists(where) else []
    done = [int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and int(n[1:]) < below and system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return [f"{path}/v{n}" for n in sorted(done)]


def _version(spark: SparkSession, path: str, below: int) -> str | None:
    """The newest of them."""
    return (_versions(spark, path, below) or [None])[-1]


def retained(events: DataFrame, keep: Callable[[DataFrame], DataFrame], name: str, path: str | None = None) -> DataFrame:
    """A table that each batch of a stream is added to, cut by ``keep`` each time. Batch n makes
    version n out of the newest version before it, so one that runs again after a failure gives
    the same table, and a stream started again on the same ``path`` goes on with what it had."""
    spark, path = events.sparkSession, path or scratch_path(events.sparkSession, name)

    def merge(batch: DataFrame, number: int) -> None:
        before = _version(batch.sparkSession, path, number)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(before).unionByName(batch) if before else batch
        keep(rows).write.mode("overwrite").parquet(f"{path}/v{number}")

    _run(events, lambda w: w.foreachBatch(merge).start(), path)
    last = _version(spark, path, 1 << 62)
    return spark.read.schema(events.schema).parquet(last) if last else spark.createDataFrame([], events.schema)


def latest(n: int = KEEP) -> Callable[[DataFrame], DataFrame]:
    """Keeps the newest n events; equal times go by id."""
    if not WINDOWS[0] <= n <= WINDOWS[1]:
        raise ValueError(f"between {WINDOWS[0]} and {WINDOWS[1]} messages can be kept")
    return lambda rows: rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def newer_than(days: int = 1) -> Callable[[DataFrame], DataFrame]:
    """Keeps what is at most so many days older than the newest event."""

    def keep(rows: DataFrame) -> DataFrame:
        newest = rows.agg(F.max("ts").alias("newest"))
        return rows.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr(f"interval {days} days")).drop("newest")  # one row

    return keep


def with_topics(events: DataFrame, topics: list[str]) -> DataFrame:
    """Events with any of the topics."""
    return events.where(F.arrays_overlap(F.array("event_type"), F.array(*map(F.lit, topics))))


class _Buffer(StatefulProcessor):
    """Holds events until there are ``size`` of them; a timer sends what is left after a time without a full buffer."""

    def __init__(self, size: int, wait_ms: int, fields: list[str]):
        self.size, self.wait_ms, self.fields = size, wait_ms, fields

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(self.fields))
        self.sent = handle.getValueState("sent", "n long")

    def _out(self, rows, flush: int, full: bool):
        import pandas as pd

        return pd.DataFrame([(*r, flush, full) for r in rows], columns=[*(f.split()[0] for f in self.fields), "flush", "full"])

    def handleInputRows(self, key, rows, timer_values):
        # what a trigger brings is put in order of time before it is numbered
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        fresh = [tuple(r) for pdf in rows for r in pdf[[f.split()[0] for f in self.fields]].itertuples(index=False)]
        held += sorted(fresh)
        sent = self.sent.get()[0] if self.sent.exists() else 0
        while len(held) >= self.size:
            yield self._out(held[: self.size], sent, True)
            held, sent = held[self.size :], sent + 1
        self.sent.update((sent,))
        if self.wait_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if held:
            self.held.put([(t.to_pydatetime() if hasattr(t, "to_pydatetime") else t, int(i)) for t, i in held])
            if self.wait_ms is not None:
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.wait_ms)
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timer_values, expired):
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        if held:
            sent = self.sent.get()[0] if self.sent.exists() else 0
            yield self._out(held, sent, False)
            self.sent.update((sent + 1,))
            self.held.clear()

    def close(self) -> None:
        pass


def flushed(events: DataFrame, size: int = 201, wait: float | None = None, lanes: int = 1) -> DataFrame:
    """A stream of ts, event_id, flush (its number), full: events leave when a buffer holds ``size`` of them, or, not full,
    ``wait`` seconds after the last event (None: never; with a wait a stream looks again and again, so it doesn't end by itself). A lane has a buffer and numbers of its own; more lanes
    (by a hash of the event) share the work. A lane holds the events of one trigger at most, besides its buffer."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    fields = ["ts timestamp", "event_id long"]
    rows = events.select("ts", "event_id", F.pmod(F.xxhash64("event_id"), F.lit(lanes)).cast("int").alias("lane"))
    return rows.groupBy("lane").transformWithStateInPandas(_Buffer(size, None if wait is None else int(wait * 1000), fields), f"{', '.join(fields)}, flush long, full boolean", "Append", "None" if wait is None else "ProcessingTime")


def flushes(events: DataFrame, size: int = 201, path: str | None = None) -> DataFrame:
    """ts, event_id, flush (its number), full of every event: those that left when the one buffer held ``size`` of
    them, and those that it still holds, with the number they will leave by (``full`` is false). Each trigger numbers
    what it brings and what was held by ranges of (ts, event_id), so no task has all events. Batch n makes version n
    out of the newest before it; a stream started again on the same ``path`` goes on with what the buffer held."""
    spark, path = events.sparkSession, path or scratch_path(events.sparkSession, "flushes")
    schema = "ts timestamp, event_id long, flush long, full boolean"

    def send(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return  # the version before stays the newest
        spark, rows, sent = batch.sparkSession, batch.select("ts", "event_id"), 0
        if before := _version(spark, path, number):
            held = spark.read.schema(schema).parquet(before)
            # events that wait have the number that comes next
            sent = held.agg(F.max(F.col("flush") + F.col("full").cast("long"))).first()[0]
            rows = rows.unionByName(held.where("not full").select("ts", "event_id"))
        rows = stored(rows, "waiting")
        ordered = numbered(rows, F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
        flush = F.lit(sent) + F.floor((F.col("number") - 1) / size).cast("long")
        out = ordered.select("ts", "event_id", flush.alias("flush"), (flush < sent + rows.count() // size).alias("full"))
        out.write.mode("overwrite").parquet(f"{path}/v{number}")

    _run(events, lambda w: w.foreachBatch(send).start(), path)
    done = _versions(spark, path, 1 << 62)
    if not done:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema)
    return read.parquet(*done).where("full").unionByName(read.parquet(done[-1]).where("not full"))


class Progress(StreamingQueryListener):
    """Keeps a row for each batch of every stream that runs while it listens."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.id), p.name, p.batchId, p.numInputRows, p.timestamp))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self) -> DataFrame:
        """query, name, batch, rows, at: the last word on each batch."""
        rows = self.spark.createDataFrame(self.rows, "query string, name string, batch long, rows long, at string")
        return rows.groupBy("query", "name", "batch").agg(F.max("rows").alias("rows"), F.max("at").alias("at"))


@contextmanager
def progress(spark: SparkSession) -> Iterator[Progress]:
    """Listens while streams run inside; waits for events that are still under way at the end."""
    seen = Progress(spark)
    spark.streams.addListener(seen)
    try:
        yield seen
    finally:
        n = -1
        while n != len(seen.rows):
            n = len(seen.rows)
            time.sleep(0.5)
        spark.streams.removeListener(seen)
