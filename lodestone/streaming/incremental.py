"""Indexes and results that grow as files and rows come in, with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import fusion, results
from ..schema import FAILED_ATTEMPT
from ..sources.log import Log, live, vacuum
from ..sources.shared import cut


def now_micros() -> int:
    return time.time_ns() // 1000


def read_rows(spark: SparkSession, folder: str, schema: str, files_each: int = 1) -> DataFrame:
    """A stream of Parquet rows: at most files_each new files a batch, so that a pass has a bounded budget of work."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def exhaust(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there in batches, then stop; a later call goes on from the checkpoint. sink must bear repeated batches."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "300 milliseconds") -> StreamingQuery:
    """Hits as they come: a batch each interval. Stop it (pause) for other work; another call goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def pause(query: StreamingQuery) -> None:
    """Give way to a user's search: what has been written stays, and a later call with the same checkpoint goes on."""
    query.stop()


class ProgressiveResults:
    """Result rows merged batch by batch into a bounded table of the best k: rows are replaced, never cleared.

    Each batch commits a new table that takes the place of the one before it. A repeated batch starts from what earlier batches
    left, so it gives the same table again. A new object over the same folder goes on where the last one ended; tables that
    nobody needs any more are removed.
    """

    COLUMNS = ("path_key", "priority", "score", "percent", "name", *fusion.FLAGS)

    def __init__(self, spark: SparkSession, folder: str, k: int, custom_ranking: bool = False):
        self.spark, self.log, self.k, self.custom_ranking = spark, Log(spark, folder), k, custom_ranking

    @property
    def last(self) -> int:
        """The number of the newest batch, or -1."""
        entries = self.log.entries()
        return entries[-1]["batch"] if entries else -1

    def current(self) -> DataFrame | None:
        parts = live(self.log.entries())
        return self.spark.read.parquet(self.log.path(parts[-1]["part"])) if parts else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        if "rank" not in batch.columns:
            batch = fusion.ranked(batch, [F.desc("priority"), F.desc("score"), F.col("path_key")], self.k).withColumnRenamed("lane_rank", "rank")
        batch = fusion.flagged(batch).select(*self.COLUMNS, F.col("rank").cast("long").alias("rank"))
        earlier = [e["added"][0]["part"] for e in self.log.entries() if e["batch"] < number]
        before = self.spark.read.schema(batch.schema).parquet(self.log.path(earlier[-1])) if earlier else batch.limit(0)
        part = self.log.new_part("results")
        out = fusion.upsert(before, batch, self.k, self.custom_ranking)
        out.select(*self.COLUMNS, F.col("rank").cast("long").alias("rank")).write.parquet(self.log.path(part))
        self.log.commit(lambda seen: {"batch": number, "added": [{"part": part}], "removed": [p["part"] for p in live(seen)]})
        vacuum(self.log, ["results"])


class IndexUpdates:
    """Documents of a stream that aren't current in an index go through work and are added to it; failures wait a day.

    Each batch writes what it has made, and what has failed, under new names and commits both at once. What a batch is compared
    with is what has been committed, so a repeated batch, or one whose writer died before its commit, never takes or loses
    rows of another: it finds its rows current and makes nothing, or makes them again. A document that work gives no row
    for has failed: it is tried again, in the same version, only after hours, told by the clock at each batch (a number is a
    moment that stands still). Every compact_each commits the latest rows are written as one part, and parts that nobody needs
    any more are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, versions: list[str], work: Callable[[DataFrame], DataFrame], clock: Callable[[], int] | int = now_micros, hours: int = 24, compact_each: int = 50):
        self.spark, self.log, self.versions, self.work, self.hours, self.compact_each = spark, Log(spark, folder), versions, work, hours, compact_each
        self.clock = clock if callable(clock) else lambda: clock

    def _read(self, kind: str, schema: str) -> DataFrame:
        """The rows of all live parts of a kind, with the number of their commit."""
        made = [self.spark.read.schema(schema).parquet(self.log.path(p[kind])).withColumn("added", F.lit(p["number"]).cast("long")) for p in live(self.log.entries()) if p.get(kind)]
        return reduce(DataFrame.union, made) if made else self.spark.createDataFrame([], f"{schema}, added long")

    def rows(self, schema: str, among: DataFrame | None = None) -> DataFrame:
        """The index so far: the latest row of each path (of the paths of among only)."""
        rows = self._read("part", schema)
        rows = rows if among is None else rows.join(among.select("path_key").distinct(), "path_key", "left_semi")
        columns = [c for c in rows.columns if c not in ("path_key", "added")]
        return rows.groupBy("path_key").agg(F.max_by(F.struct(*columns), F.struct("added", *self.versions)).alias("r")).select("path_key", "r.*")

    def attempts(self) -> DataFrame:
        return self._read("attempts", FAILED_ATTEMPT).drop("added")

    def sink(self, schema: str) -> Callable[[DataFrame, int], None]:
        def add(batch: DataFrame, number: int) -> None:
            now = self.clock()
            columns = [c for c in batch.columns if c != "path_key"]
            batch = batch.groupBy("path_key").agg(F.max_by(F.struct(*columns), F.struct(*self.versions)).alias("r")).select("path_key", "r.*")
            waiting = results.pending(batch, self.rows(schema, batch), self.versions).withColumn("_version", F.xxhash64(*self.versions))
            waiting = cut(results.without_recent_failures(waiting, self.attempts(), now, self.hours, "_version"))
            part, attempts = self.log.new_part("index"), self.log.new_part("attempts")
            self.work(waiting.drop("_version")).write.parquet(self.log.path(part))
            made = self.spark.read.schema(schema).parquet(self.log.path(part)).select("path_key", *self.versions)
            failed = waiting.join(made, ["path_key", *self.versions], "left_anti").select("path_key", F.col("_version").alias("version"), F.lit(now).cast("long").alias("attempted")).distinct()
            failed.write.parquet(self.log.path(attempts))
            done = self.log.commit(lambda before: {"batch": number, "added": [{"part": part, "attempts": attempts}]})
            if done["number"] and done["number"] % self.compact_each == 0:
                self.compact(schema)

        return add

    def compact(self, schema: str) -> None:
        """The latest rows and the attempts that still count as one part; if another commit comes meanwhile, nothing changes."""
        seen = self.log.entries()
        parts, kept = live(seen), self.log.new_part("index")
        recent = self.log.new_part("attempts")
        self.rows(schema).write.parquet(self.log.path(kept))
        self.attempts().where(F.col("attempted") > self.clock() - self.hours * 3_600_000_000).write.parquet(self.log.path(recent))
        entry = {"batch": None, "removed": [p["part"] for p in parts], "added": [{"part": kept, "attempts": recent}]}
        self.log.commit(lambda now: entry if len(now) == len(seen) else None)
        vacuum(self.log, ["index", "attempts"], keep=self.compact_each)


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """An extra: counts in windows of event time; rows later than the watermark allows are dropped by the stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
