"""Versioned index tables: a folder for each version of a root's rows, and a commit that points to it.

A reader sees the old version until the commit is put, so a failed or repeated write leaves the index as it was, and of two
writers at once each gives a whole version: the later commit counts. Rows lie in files by ranges of their paths, and a small
table beside them tells each file's first and last path and time, by which a reader chooses the files that it opens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.results import usable
from ..schema import FORMATS, INDEX_HEADER
from .log import Log, live, vacuum

BOUNDS = "file string, low_path string, high_path string, low_modified long, high_modified long"
_HEADER = [c.split()[0] for c in INDEX_HEADER.split(", ")]


def root_key(root: str) -> str:
    import hashlib

    return hashlib.sha256(root.upper().encode()).hexdigest().upper()[:24]


class Index:
    """The tables of one kind ('metadata', 'content', 'semantic', 'visual') below a folder. keep: commits whose versions stay
    readable for those who have begun to read them."""

    def __init__(self, spark: SparkSession, base: str, kind: str, schema: str, keep: int = 2):
        self.spark, self.kind, self.schema, self.keep = spark, kind, StructType.fromDDL(schema), keep
        self.log = Log(spark, f"{base.rstrip('/')}/{kind}")
        names = self.schema.fieldNames()
        self.path = next((c for c in ("path_key", "full_path") if c in names), None)

    def versions(self) -> list[dict]:
        """What the commits tell of each root's newest version."""
        return live(self.log.entries())

    def headers(self) -> DataFrame:
        """The newest header of each root."""
        return self.spark.createDataFrame([tuple(v[c] for c in _HEADER) for v in self.versions()], INDEX_HEADER)  # a row a root

    def write(self, root: str, rows: DataFrame, now_micros: int, root_modified: int = 0, is_complete: bool = True, cap: int = 0, files: int | None = None) -> None:
        """A new version of a root's rows. files: how many (Spark's number of shuffle partitions, if not given)."""
        part, bounds, key = self.log.new_part("rows"), self.log.new_part("bounds"), root_key(root)
        names = self.schema.fieldNames()
        chosen = rows.select(*names)
        if self.path is not None:
            order = [self.path, *(c for c in ("modified",) if c in names)]
            chosen = (chosen.repartitionByRange(*order) if files is None else chosen.repartitionByRange(files, *order)).sortWithinPartitions(*order)
        chosen.write.parquet(self.log.path(part))
        written = self.spark.read.schema(self.schema).parquet(self.log.path(part))
        path = F.lower(self.path) if self.path is not None else F.lit(None).cast("string")
        time = F.col("modified").cast("long") if "modified" in names else F.lit(None).cast("long")
        per_file = written.groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).agg(F.min(path).alias("low_path"), F.max(path).alias("high_path"), F.min(time).alias("low_modified"), F.max(time).alias("high_modified"), F.count("*").alias("rows"))
        per_file.write.parquet(self.log.path(bounds))
        count = self.spark.read.schema(f"{BOUNDS}, rows long").parquet(self.log.path(bounds)).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        header = dict(zip(_HEADER, (root, key, FORMATS[self.kind], now_micros, root_modified, is_complete, cap, count), strict=True))

        def change(before: list[dict]) -> dict:
            return {"added": [header | {"part": part, "bounds": bounds}], "removed": [p["part"] for p in live(before) if p["root_key"] == key]}

        self.log.commit(change)
        vacuum(self.log, ["rows", "bounds"], self.keep)

    def get_or_build(self, root: str, build: Callable[[], DataFrame], now_micros: int, root_modified: int = 0, cap: int = 0, minutes: int = 30) -> DataFrame:
        """A root's usable rows; where there are none, they are built, written and read back."""
        fresh = usable(self.headers(), FORMATS[self.kind], now_micros, cap, minutes).where((F.col("root_key") == root_key(root)) & (F.col("root_modified") >= root_modified))
        if fresh.isEmpty():
            self.write(root, build(), now_micros, root_modified, cap=cap)
        return self.read([root])

    def files(self, roots: list[str] | None = None, fresh: int | None = None, cap: int = 0, minutes: int = 30, below: str | None = None, modified: tuple[int | None, int | None] = (None, None)) -> list[str]:
        """The files of usable versions that may hold a row below a folder, of a range of times (from, and before)."""
        headers = self.headers().where(F.col("format_version") == FORMATS[self.kind])
        if fresh is not None:
            headers = usable(headers, FORMATS[self.kind], fresh, cap, minutes)
        if roots is not None:
            headers = headers.where(F.col("root_key").isin(*map(root_key, roots)))
        wanted = {r["root_key"] for r in headers.select("root_key").collect()}
        made = [self.spark.read.schema(BOUNDS).parquet(self.log.path(v["bounds"])).withColumn("part", F.lit(v["part"])) for v in self.versions() if v["root_key"] in wanted]
        if not made:
            return []
        rows = reduce(DataFrame.union, made)
        if below is not None and self.path is not None:
            key = below.lower().rstrip("/")
            rows = rows.where((F.col("high_path") >= key) & (F.substring("low_path", 1, len(key)) <= key))
        if modified[0] is not None:
            rows = rows.where(F.col("high_modified").isNull() | (F.col("high_modified") >= modified[0]))
        if modified[1] is not None:
            rows = rows.where(F.col("low_modified").isNull() | (F.col("low_modified") < modified[1]))
        return sorted(self.log.path(f"{r['part']}/{r['file']}") for r in rows.select("part", "file").toLocalIterator())

    def read(self, roots: list[str] | None = None, fresh: int | None = None, cap: int = 0, minutes: int = 30, below: str | None = None, modified: tuple[int | None, int | None] = (None, None)) -> DataFrame:
        """The rows of usable versions. fresh: the present time; older snapshots than minutes then count as missing. below, modified:
        only rows below a folder, and of a range of times."""
        files = self.files(roots, fresh, cap, minutes, below, modified)
        if not files:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*files)
        if below is not None and self.path is not None:
            key = below.lower().rstrip("/")
            rows = rows.where((F.lower(self.path) == key) | F.startswith(F.lower(self.path), F.lit(f"{key}/")))
        if modified[0] is not None:
            rows = rows.where(F.col("modified") >= modified[0])
        if modified[1] is not None:
            rows = rows.where(F.col("modified") < modified[1])
        return rows
