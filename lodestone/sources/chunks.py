"""Rows in numbered chunks, which indexes speak of: a row's address is its chunk and its place there."""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import Log

#: Rows of a chunk at most: as many as a bitmap of Spark's has bits.
CHUNK = 32_768
DEAD = "chunk long, bits binary"
_TURN = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[Column], first: int, chunk: int, chunks_each: int) -> DataFrame:
    """rows in ranges of the order, with chunk (from first on; a task's begin at a multiple of 2^20), place, and grp (of so many
    chunks): equal orders must not occur, so that a task that runs again gives the same addresses."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    turn = F.col("_id").bitwiseAND(F.lit(_TURN))  # the task stands above 33 bits of the row's turn in it
    out = ordered.withColumns({"chunk": F.lit(first) + F.shiftleft(F.shiftright("_id", 33), 20) + F.floor(turn / chunk), "place": (turn % chunk).cast("int")}).drop("_id")
    return out.withColumn("grp", F.floor(F.col("chunk") / chunks_each))


def next_chunk(parts: list[dict]) -> int:
    """The first chunk of a new part. Parts tell their last."""
    return (max((p["last"] for p in parts), default=-1) + 1) << 20


def bucket_of(column: str, buckets: int) -> Column:
    """The bucket of a text."""
    return (F.crc32(F.encode(column, "UTF-8")) % buckets).cast("int")


def number_of(text: str, buckets: int) -> int:
    """bucket_of on the driver."""
    return zlib.crc32(text.encode("utf-8", "replace")) % buckets


def has_bit(bits: Column, place: Column) -> Column:
    """Whether a bitmap has the bit of a place (from 0)."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), place % 8)) != 0


def bitmaps(rows: DataFrame) -> DataFrame:
    """chunk, bits of addresses."""
    return rows.groupBy("chunk").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))


def alive(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    """rows (chunk, place) without the dead ones (chunk, bits; several rows a chunk may be)."""
    if dead is None:
        return rows
    ended = dead.groupBy("chunk").agg(F.bitmap_or_agg("bits").alias("_dead"))
    return rows.join(ended, "chunk", "left").where(F.col("_dead").isNull() | ~has_bit(F.col("_dead"), F.col("place"))).drop("_dead")


def read_parts(log: Log, parts: list[str], schema: str) -> DataFrame:
    """The rows of several folders."""
    spark: SparkSession = log.spark
    made = [spark.read.schema(schema).parquet(log.path(p)) for p in parts]
    return reduce(DataFrame.union, made) if made else spark.createDataFrame([], schema)


def in_groups(rows: DataFrame, wanted: DataFrame, chunks_each: int, most: int) -> DataFrame:
    """rows cut to the folders that hold a wanted chunk, by their names; where these are more than most, not cut at all (the
    join that follows chooses)."""
    groups = [r["grp"] for r in wanted.select(F.floor(F.col("chunk") / chunks_each).alias("grp")).distinct().limit(most + 1).collect()]
    if len(groups) > most:
        return rows
    return rows.where(F.col("grp").isin(*groups)) if groups else rows.where(F.lit(False))
