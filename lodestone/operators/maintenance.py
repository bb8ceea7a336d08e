"""Keeping indexes up to date: how much work a pass may do, what is put off, and passes until nothing is left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import results

#: Passes of one preparation at most, and new documents of a pass.
PASSES, TEXTS_EACH, IMAGES_EACH = 96, 384, 256


@dataclass(frozen=True)
class Budget:
    """What a background pass may do for each root."""

    heavy: bool
    contents: int
    texts: int
    images: int


def budget(idle: bool, delay_minutes: float) -> Budget:
    """Models run only while nobody works, or in passes that come five minutes apart or more."""
    return Budget(True, 1200, 48, 12) if idle or delay_minutes >= 5 else Budget(False, 0, 0, 0)


def next_delay(idle: bool, found_work: bool) -> int:
    """Seconds until the next pass."""
    return (20 if found_work else 300) if idle else 900


def recognition_quota(most_documents: int) -> int:
    """Texts that a scan recognises in images at most; others are put off."""
    return min(max(most_documents // 8, 96), 512)


def split_by_quota(rows: DataFrame, quota: int, *order) -> tuple[DataFrame, DataFrame]:
    """Rows of path_key for now, the first of them by the order, and those that are put off (their number makes an index incomplete)."""
    now = rows.orderBy(*order, "path_key").limit(quota)
    return now, rows.join(now.select("path_key"), "path_key", "left_anti")


def progress(done: int, total: int, before: int = 0, ended: bool = False) -> int:
    """Percent that never falls, and is 100 only at the end."""
    return 100 if ended else max(before, min(99, 100 * done // total if total else 0))


def prepare(documents: DataFrame, index: Callable[[], DataFrame], add: Callable[[DataFrame], None], versions: list[str], each: int = TEXTS_EACH, passes: int = PASSES, home: str | None = None) -> dict[str, int]:
    """Bring an index up to date in passes of bounded work: add() appends rows for what it is given. Stops when nothing is
    pending, when a pass has made nothing, or after so many passes. documents: path_key, directory_path, has_text, modified."""
    before, n = None, 0
    while n < passes:
        waiting = results.pending(documents, index(), versions)
        left = waiting.count()
        if not left or left == before:
            break
        add(results.pending_order(waiting, each, home))
        before, n = left, n + 1
    return {"passes": n, "pending": results.pending(documents, index(), versions).count(), "documents": documents.count()}


def content_order(files: DataFrame, cap: int, scores: DataFrame | None = None, home: str | None = None) -> DataFrame:
    """The files whose texts a scan reads, at most cap: sheets that matter first (half of the cap, 64 at least), then others by path."""
    keyed = files.withColumn("path_key", F.lower("full_path"))
    first = results.preferred_sheets(keyed.withColumn("file_id", F.col("path_key")), min(cap, max(64, cap // 2)), scores, home).select("path_key", F.lit(0).alias("lane"))
    rest = keyed.where(~F.col("is_directory")).join(first.select("path_key"), "path_key", "left_anti").select("path_key", F.lit(1).alias("lane"))
    chosen = first.unionByName(rest).orderBy("lane", "path_key").limit(cap)
    return keyed.join(chosen, "path_key")
