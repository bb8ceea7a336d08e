"""Live scans: a stream of folders, whose files are listed and scored while the rest is still being found.

The source walks the roots in the order of their paths, each folder before those below it. Its offset is the last folder that
it has given, so an offset is as long as a path, whatever the size of the tree, and a replayed batch gives the same folders.
A batch has at most so many folders; their files are listed on the executors. Hits go into a bounded table of the best, batch
by batch, and a search for types alone ends as soon as it is full.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..functions import paths as P
from ..operators import metadata
from ..plans.intent import Intent
from ..schema import FILE_RECORD
from .files import _batch, _created, _entries, _open
from .log import Log, live

#: Folders of a batch. Hits that are given out together, and milliseconds after which fewer are.
FOLDERS, HITS, WAIT = 256, 24, 300
#: Rows kept where files for the visual lane count too: at least, at most, and for each one wanted.
VISUAL_LEAST, VISUAL_MOST, VISUAL_EACH = 4_000, 20_000, 40


def walk(roots: list[str], after: tuple[int, str] | None = None) -> Iterator[tuple[int, str]]:
    """(root's number, folder): each folder before those below it, names in order. after: only what comes later. Links to folders
    aren't followed; of folders that can't be read nothing is given but themselves."""
    first = 0 if after is None else after[0]
    for n in range(first, len(roots)):
        system, top = _open(roots[n])
        prefix = roots[n].partition("://")[0] + "://" if "://" in roots[n] else ""
        top = top.rstrip("/") or "/"
        done = after[1].removeprefix(prefix) if after is not None and n == first else None
        yield from ((n, prefix + f) for f in _below(system, top, None if done is None else done[len(top.rstrip("/")) :].strip("/").split("/") if done != top else []))


def _below(system: fs.FileSystem, folder: str, done: list[str] | None) -> Iterator[str]:
    """done: the parts of the path, from here, of the last folder that was given; None: nothing was."""
    if done is None:
        yield folder
    names = sorted(i.base_name for i in _entries(system, folder) if i.type == fs.FileType.Directory and not (isinstance(system, fs.LocalFileSystem) and os.path.islink(i.path)))
    for name in names:
        if done and name < done[0]:
            continue
        yield from _below(system, f"{folder.rstrip('/')}/{name}", done[1:] if done and name == done[0] else None)


class FolderReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.roots, self.each = options["path"].split(";"), int(options.get("folders", FOLDERS))

    def initialOffset(self) -> dict:
        return {"root": -1, "folder": "", "end": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["end"]:
            return iter([]), start
        found = []
        for at in walk(self.roots, None if start["root"] < 0 else (start["root"], start["folder"])):
            found.append(at)
            if len(found) == self.each:
                break
        if not found:
            return iter([]), start | {"end": True}
        return iter([(f,) for _, f in found]), {"root": found[-1][0], "folder": found[-1][1], "end": False}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch again, after a restart."""
        last = (end["root"], end["folder"])
        if end["end"] or (start["root"], start["folder"]) == last:
            return
        for at in walk(self.roots, None if start["root"] < 0 else (start["root"], start["folder"])):
            yield (at[1],)
            if at == last:
                return

    def commit(self, end: dict) -> None:
        pass


class FolderStream(DataSource):
    """spark.readStream.format("folders"): path (several with ;), folders (of a batch at most)."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return "folder string"

    def simpleStreamReader(self, schema: StructType) -> FolderReader:
        return FolderReader(dict(self.options))


def folders(spark: SparkSession, roots: list[str], each: int = FOLDERS) -> DataFrame:
    """A stream of the folders below the roots, these among them."""
    spark.dataSource.register(FolderStream)
    return spark.readStream.format("folders").option("path", ";".join(roots)).option("folders", each).load()


def list_files(folders: DataFrame, tasks: int = 8) -> DataFrame:
    """FILE_RECORD of what is in the folders (folder), files and folders."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where in batch.column(0).to_pylist():
                system, folder = _open(where)
                local, rows = isinstance(system, fs.LocalFileSystem), []
                for i in _entries(system, folder):
                    is_folder = i.type == fs.FileType.Directory
                    modified = int(i.mtime_ns // 1000) if i.mtime_ns is not None else None
                    rows.append((i.base_name, i.path, folder, "" if is_folder else os.path.splitext(i.base_name)[1].lower(), is_folder, None if is_folder else i.size, _created(i.path, modified) if local else modified, modified))
                    if len(rows) >= 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return folders.repartition(tasks).mapInArrow(read, FILE_RECORD)


HIT = f"{FILE_RECORD}, path_key string, score double, ranking_score double, visual boolean"


class LiveSearch:
    """The best files of a live scan for an intent, batch by batch; folder keeps them and where the scan is.

    k: rows wanted. With visual, images and PDF files without any match count too, after all matches, and more rows are kept: the
    visual lane then judges them, those in the user's own folders (home) first. A listener is given each batch's new rows, HITS
    at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, intent: Intent, k: int, now_micros: int, visual: bool = False, days: tuple[int | None, int | None] = (None, None), listener: Callable[[list], None] | None = None, home: str | None = None):
        self.spark, self.log, self.intent, self.k, self.now, self.visual, self.days, self.listener, self.home = spark, Log(spark, folder), intent, k, now_micros, visual, days, listener, home

    @property
    def by_type(self) -> bool:
        """Types alone: any row that fits will do, and the scan ends when there are enough."""
        return not self.intent.terms and not self.intent.directives and not self.visual

    @property
    def capacity(self) -> int:
        if self.visual:
            return min(VISUAL_MOST, max(VISUAL_LEAST, VISUAL_EACH * self.k))
        return self.k if self.by_type else min(metadata.MOST, max(self.k, 12 * self.k))

    def best(self) -> DataFrame:
        """The best rows so far: HIT."""
        parts = live(self.log.entries())
        return self.spark.read.schema(HIT).parquet(self.log.path(parts[-1]["part"])) if parts else self.spark.createDataFrame([], HIT)

    @property
    def full(self) -> bool:
        """Whether a scan for types alone has what it wants."""
        entries = self.log.entries()
        return self.by_type and bool(entries) and entries[-1]["rows"] >= self.capacity

    def scored(self, files: DataFrame) -> DataFrame:
        """The files that match, and with visual the others that the visual lane may judge: HIT."""
        rows = files.where(~F.col("is_directory")).withColumn("path_key", F.lower("full_path")).dropDuplicates(["path_key"])
        found = metadata.search(rows.withColumn("file_id", F.col("path_key")), self.intent, self.capacity, self.now, *self.days)
        hits = found.select(F.col("file_id").alias("path_key"), "score", "ranking_score", F.lit(False).alias("visual")).join(rows, "path_key")
        if self.visual:
            seen = (P.category(F.col("extension")) == "Image") | (F.col("extension") == ".pdf")
            wanted = rows.where(metadata.hard_filters(self.intent, F.col("modified"), *self.days) & seen).join(hits.select("path_key"), "path_key", "left_anti")
            place = P.path_priority(F.col("directory_path"), self.home).cast("double")
            hits = hits.unionByName(wanted.withColumns({"score": place, "ranking_score": place, "visual": F.lit(True)}))
        return hits.select(*StructType.fromDDL(HIT).fieldNames())

    def kept(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc("ranking_score"), F.desc_nulls_last("modified"), "path_key").limit(self.capacity)

    def __call__(self, folders: DataFrame, number: int) -> None:
        """A batch of folders. A repeated batch changes nothing: its files are the rows that are there already."""
        if self.full:
            return
        hits = self.kept(self.scored(list_files(folders)))
        before = self.best()
        part = self.log.new_part("best")
        merged = hits.join(before.select("path_key"), "path_key", "left_anti").unionByName(before)
        self.kept(merged).write.parquet(self.log.path(part))
        out = self.spark.read.schema(HIT).parquet(self.log.path(part))
        old = [p["part"] for p in live(self.log.entries())]
        if self.listener is not None:
            new = out.join(before.select("path_key"), "path_key", "left_anti").orderBy(F.desc("ranking_score"), "path_key")
            waiting: list = []
            for row in new.toLocalIterator():
                waiting.append(row)
                if len(waiting) == HITS:
                    self.listener(waiting)
                    waiting = []
            if waiting:
                self.listener(waiting)
        count = out.count()
        self.log.commit(lambda _: {"batch": number, "rows": count, "added": [{"part": part}], "removed": old})

    def run(self, roots: list[str], checkpoint: str, each: int = FOLDERS, batches: int | None = None) -> DataFrame:
        """Scan to the end (or so many batches), from where the checkpoint is, and give the best rows."""
        left = [batches]

        def sink(rows: DataFrame, number: int) -> None:
            self(rows, number)
            left[0] = None if left[0] is None else left[0] - 1

        query = folders(self.spark, roots, each).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{WAIT} milliseconds").start()
        while query.isActive:
            if self.full or left[0] == 0 or _ended(query):
                query.stop()
            query.awaitTermination(0.1)
        if query.exception() is not None:
            raise query.exception()
        return self.best()


def _ended(query) -> bool:
    """Whether the source has no folder left and all that it gave is done."""
    progress = query.lastProgress
    if not progress or not progress["sources"]:
        return False
    end = progress["sources"][0]["endOffset"]
    return bool(end) and '"end": true' in str(end).replace("'", '"').replace("True", "true")
