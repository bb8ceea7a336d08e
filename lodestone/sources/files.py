"""Scanning folders. file_tree is a data source that lists files and folders; binaryFile reads contents."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import paths as P
from ..schema import FILE_RECORD

#: Folders that a tree is cut into, about.
FOLDERS = 64
_NAMES = ["name", "full_path", "directory_path", "extension", "is_directory", "size_bytes", "created", "modified"]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]


class Folder(InputPartition):
    def __init__(self, path: str, recursive: bool):
        super().__init__(path)
        self.path, self.recursive = path, recursive


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(os.path.abspath(path) if "://" not in path else path)


def _created(path: str, modified: int | None) -> int | None:
    """When a local file was made, where its system tells; else when it was changed."""
    try:
        born = getattr(os.stat(path), "st_birthtime", None)
    except OSError:
        born = None
    return modified if born is None else int(born * 1_000_000)


class TreeReader(DataSourceReader):
    """Folders are listed breadth first on the driver until there are FOLDERS of them: each of those is a partition with all below
    it, and each folder above them one with its own entries. So one deep folder isn't one task. A folder that can't be read is
    passed over."""

    def __init__(self, options: dict[str, str]):
        self.roots = options["path"].split(";")
        self.recursive = options.get("recursive", "true").lower() != "false"
        self.folders = int(options.get("folders", FOLDERS))

    def partitions(self) -> list[Folder]:
        out, edge = [], list(self.roots)
        while self.recursive and edge and len(edge) < self.folders:
            below = []
            for folder in edge:
                out.append(Folder(folder, False))
                system, path = _open(folder)
                prefix = folder.partition("://")[0] + "://" if "://" in folder else ""
                below += [prefix + i.path for i in _entries(system, path) if i.type == fs.FileType.Directory]
            edge = below
        return out + [Folder(f, self.recursive) for f in edge]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, path = _open(partition.path)
        local = isinstance(system, fs.LocalFileSystem)
        waiting, seen, rows = deque([path]), set(), []
        while waiting:
            folder = waiting.popleft()
            real = os.path.realpath(folder) if local else folder  # links may lead back
            if real in seen:
                continue
            seen.add(real)
            for i in _entries(system, folder):
                is_folder = i.type == fs.FileType.Directory
                modified = int(i.mtime_ns // 1000) if i.mtime_ns is not None else None
                extension = "" if is_folder else os.path.splitext(i.base_name)[1].lower()
                rows.append((i.base_name, i.path, folder, extension, is_folder, None if is_folder else i.size, _created(i.path, modified) if local else modified, modified))
                if is_folder and partition.recursive:
                    waiting.append(i.path)
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


def _entries(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What is visible in a folder."""
    try:
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    except OSError:
        return []
    return [i for i in found if i.base_name.strip() and not i.base_name.startswith("~")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_NAMES), _TYPES)], _NAMES)


class FileTreeDataSource(DataSource):
    """spark.read.format("file_tree"): path (several with ;), recursive, folders (partitions, about). Names that begin with ~ are passed over."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return FILE_RECORD

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


def scan(spark: SparkSession, roots: list[str], recursive: bool = True, most: int | None = None) -> DataFrame:
    """File records below the roots. most: one more row than that tells that the scan isn't complete."""
    spark.dataSource.register(FileTreeDataSource)
    rows = spark.read.format("file_tree").option("path", ";".join(roots)).option("recursive", str(recursive).lower()).load()
    return rows if most is None else rows.limit(most + 1)


def is_complete(scanned: DataFrame, most: int) -> bool:
    """Whether a scan with that bound has seen everything."""
    return scanned.limit(most + 1).count() <= most


#: Items that a look into the current folder, and a live scan, see at most.
LIVE_FOLDER, LIVE_SCAN = 10_000, 250_000


def current_folder(spark: SparkSession, folder: str, most: int = LIVE_FOLDER) -> DataFrame:
    """What is in a folder now, whatever an index says."""
    return scan(spark, [folder], recursive=False).limit(most)


def read_binary(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """path_key, name, extension, modified, size_bytes, content; larger files are left out by the scan itself."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if most_bytes is not None:
        rows = rows.where(F.col("length") <= most_bytes)
    name = P.name(F.col("path"))
    return rows.select(F.lower(F.regexp_replace("path", "^file:(//)?", "")).alias("path_key"), name.alias("name"), P.extension(name).alias("extension"), F.unix_micros("modificationTime").alias("modified"), F.col("length").alias("size_bytes"), "content")
