"""Queries that run streams over several batches of the events, each from the checkpoint of the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder
from ..streaming.incremental import IndexUpdates, exhaust, read_rows
from ..streaming.state import PROVIDER, ROCKS, attempts
from .registry import query, table

SCHEMA, BATCHES = "path_key string, version long, text string, seen timestamp", 4
_EVENTS = "SELECT 'user_' || user_id AS path_key, event_id AS version, (event_id // 500) % 4 AS batch FROM events"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    batch = (F.floor(F.col("event_id") / 500) % BATCHES).cast("int")
    return e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("path_key"), F.col("event_id").alias("version"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("seen"), batch.alias("batch"))


def _in_batches(spark: SparkSession, sf_dir: str, run: Callable[[DataFrame, str], None]) -> None:
    """Files of a batch arrive, and a stream takes what is new."""
    rows, folder, checkpoint = _documents(spark, sf_dir), new_folder(spark, "arriving"), new_folder(spark, "checkpoint")
    for b in range(BATCHES):
        rows.where(F.col("batch") == b).drop("batch").write.mode("append").parquet(folder)
        run(read_rows(spark, folder, SCHEMA, 1_000_000), checkpoint)


@query(f"SELECT path_key, max_by(version, batch) AS version FROM (SELECT path_key, batch, max(version) AS version FROM ({_EVENTS}) GROUP BY path_key, batch) WHERE version % 7 <> 3 GROUP BY path_key")
def index_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' last events as versions of documents; work fails for one in seven. Each batch is given twice, as after a lost
    checkpoint."""
    index = IndexUpdates(spark, new_folder(spark, "updates"), ["version"], lambda rows: rows.where("version % 7 <> 3").select("path_key", "version"), compact_each=3)
    add = index.sink("path_key string, version long")

    def twice(batch: DataFrame, number: int) -> None:
        add(batch, number)
        add(batch, number)

    _in_batches(spark, sf_dir, lambda stream, checkpoint: exhaust(stream, twice, checkpoint).awaitTermination())
    return index.rows("path_key string, version long")


def _work(path_key: str, version: int, text: str | None) -> str | None:
    return None if version % 7 == 3 else f"{path_key}@{version}"


@query(
    f"""WITH newest AS (SELECT path_key, batch, max(version) AS version FROM ({_EVENTS}) GROUP BY path_key, batch),
seen AS (SELECT *, max(version) OVER (PARTITION BY path_key ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM newest)
SELECT path_key, version, CASE WHEN version % 7 <> 3 THEN path_key || '@' || version END AS payload, version % 7 = 3 AS failed FROM seen WHERE before IS NULL OR version > before"""
)
def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with keyed state: of a batch a path's newest version is tried, unless a newer one has been."""
    out = new_folder(spark, "attempts")
    before = spark.conf.get(PROVIDER, None)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run(stream: DataFrame, checkpoint: str) -> None:
        made = attempts(stream, _work, most=1, late="36500 days")
        made.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    spark.conf.set(PROVIDER, ROCKS)
    try:
        _in_batches(spark, sf_dir, run)
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.parquet(out).select("path_key", "version", "payload", "failed")
