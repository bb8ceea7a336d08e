"""An index of titles by characters: bitmap postings over chunks of files, from which a search learns which chunks to read.

Files are kept in chunks of at most CHUNK rows in the order of their names. Of each character and chunk a bitmap tells which
rows' names hold it. A query of several characters takes the bitmaps of its rarest character first, those of the others only
in chunks that the rarest occurs in, and their intersection names the rows that may match: names are read from these chunks
only, and the query itself is tested on them, so results are those of a scan of all files.
The index grows by batches. A batch is a part with its own chunks, postings and counts of characters; a path that comes again
replaces the older row, and a removed path ends it: older parts' rows die by a bitmap for each chunk that the batch writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import titles
from ..schema import FILE_RECORD
from .chunks import CHUNK, DEAD, alive, bitmaps, bucket_of, has_bit, in_groups, next_chunk, number_of, numbered, read_parts
from .log import Log, live

#: Chunks of a folder of rows, and buckets of postings.
CHUNKS_EACH, BUCKETS = 32, 64
#: Chunks that are named one by one when rows are read; where a query's rows lie in more, all folders are looked at.
MOST_NAMED = 10_000
ROWS = FILE_RECORD + ", path_key string, chunk long, place int, grp long"
POSTINGS, COUNTS = "ch string, chunk long, n long, bits binary, bucket int", "ch string, n long"


def characters(name: Column) -> Column:
    """The distinct characters of a name, letters small. A final sigma counts as any other: it is lower-cased by its place."""
    return F.array_distinct(F.filter(F.split(F.translate(F.lower(name), "ς", "σ"), ""), lambda x: x != ""))


def characters_of(query: str) -> list[str]:
    return sorted(set(query.lower().replace("ς", "σ")))


class TitleIndex:
    """folder: where the parts are. chunk, chunks_each, buckets: set when the index is made, and the same ever after."""

    def __init__(self, spark: SparkSession, folder: str, chunk: int = CHUNK, chunks_each: int = CHUNKS_EACH, buckets: int = BUCKETS):
        self.spark, self.log, self.chunk, self.chunks_each, self.buckets = spark, Log(spark, folder), chunk, chunks_each, buckets
        if not 0 < chunk <= CHUNK:
            raise ValueError(f"a chunk has at most {CHUNK} rows")

    # growth

    def add(self, files: DataFrame, batch: str, gone: DataFrame | None = None) -> None:
        """files: FILE_RECORD. Rows of paths (whatever their case) that the index has replace the older ones; of several with one
        path the newest counts. gone: full_path of files that aren't there any more. batch names this piece of work: what is
        already in under that name isn't added again. Null paths and names are left out; extra columns are ignored."""
        seen = self.log.entries()
        if any(e["batch"] == batch for e in seen):
            return
        rows = files.select(*StructType.fromDDL(FILE_RECORD).fieldNames()).where("full_path IS NOT NULL AND name IS NOT NULL").withColumn("path_key", F.lower("full_path"))
        rows = rows.groupBy("path_key").agg(F.max(F.struct("modified", *(c for c in rows.columns if c not in ("path_key", "modified")))).alias("r")).select("path_key", "r.*")
        first = next_chunk([p for e in seen for p in e["added"]])
        part = self.log.new_part("rows")
        numbered(rows, [F.lower("name"), F.col("path_key")], first, self.chunk, self.chunks_each).write.partitionBy("grp").parquet(self.log.path(part))
        mine = read_parts(self.log, [part], ROWS)
        last = mine.agg(F.max("chunk")).first()[0]
        posts, counts, dead = (self.log.new_part(k) for k in ("postings", "counts", "dead"))
        chars = mine.select("chunk", "place", F.explode(characters(F.col("name"))).alias("ch"))
        made = chars.groupBy("ch", "chunk").agg(F.count("*").alias("n"), F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits")).withColumn("bucket", bucket_of("ch", self.buckets))
        made.repartition("bucket").sortWithinPartitions("ch", "chunk").write.partitionBy("bucket").parquet(self.log.path(posts))
        read_parts(self.log, [posts], POSTINGS).groupBy("ch").agg(F.sum("n").alias("n")).write.parquet(self.log.path(counts))
        before = live(seen)
        if before:
            ended = mine.select("path_key") if gone is None else mine.select("path_key").union(gone.select(F.lower("full_path")))
            old = read_parts(self.log, [p["part"] for p in before], ROWS).select("path_key", "chunk", "place")
            died = old.join(ended.distinct(), "path_key", "left_semi")
            bitmaps(died).write.parquet(self.log.path(dead))
        entry = {"batch": batch, "added": [{"part": part, "postings": posts, "counts": counts, "dead": dead if before else None, "last": (last if last is not None else first) >> 20}]}

        def change(now: list[dict]) -> dict | None:
            if any(e["batch"] == batch for e in now):
                return None
            if len(now) != len(seen):
                raise RuntimeError("another batch was added meanwhile: add this one again")
            return entry

        self.log.commit(change)

    def compact(self, batch: str) -> None:
        """All live rows as one part, which takes the place of the others."""
        seen = self.log.entries()
        parts = live(seen)
        if len(parts) < 2 or any(e["batch"] == batch for e in seen):
            return
        whole = TitleIndex(self.spark, f"{self.log.folder}/{self.log.new_part('compact')}", self.chunk, self.chunks_each, self.buckets)
        whole.add(self.rows(), batch)
        (made,) = live(whole.log.entries())
        inside = whole.log.folder.removeprefix(f"{self.log.folder}/")
        moved = made | {k: f"{inside}/{made[k]}" for k in ("part", "postings", "counts")} | {"last": max(p["last"] for p in parts)}
        del moved["number"]

        def change(now: list[dict]) -> dict | None:
            return {"batch": batch, "removed": [p["part"] for p in parts], "added": [moved]} if len(now) == len(seen) else None

        self.log.commit(change)

    # what is there

    def _alive(self, parts: list[dict], rows: DataFrame) -> DataFrame:
        """rows without those that later batches ended."""
        ended = [p["dead"] for p in parts if p["dead"]]
        return alive(rows, read_parts(self.log, ended, DEAD) if ended else None)

    def rows(self) -> DataFrame:
        """All live files."""
        parts = live(self.log.entries())
        return self._alive(parts, read_parts(self.log, [p["part"] for p in parts], ROWS)).drop("chunk", "place", "grp")

    # search

    def candidates(self, query: str) -> DataFrame:
        """chunk, bits: the rows whose names hold every character of the query, dead ones among them."""
        parts, chars = live(self.log.entries()), characters_of(query)
        none = self.spark.createDataFrame([], "chunk long, bits binary")
        if not parts or not chars:
            return none
        counts = {r["ch"]: r["n"] for r in read_parts(self.log, [p["counts"] for p in parts], COUNTS).where(F.col("ch").isin(*chars)).groupBy("ch").agg(F.sum("n").alias("n")).collect()}  # the query's characters at most
        if len(counts) < len(chars):
            return none
        rarest, *others = sorted(chars, key=lambda c: (counts[c], c))
        posts = read_parts(self.log, [p["postings"] for p in parts], POSTINGS)

        def of(these: list[str]) -> DataFrame:
            return posts.where(F.col("bucket").isin(*{number_of(c, self.buckets) for c in these}) & F.col("ch").isin(*these)).select("chunk", "bits")

        rare = of([rarest])
        if not others:
            return rare
        rest = of(others).join(rare.select("chunk"), "chunk", "left_semi")
        met = rare.union(rest).groupBy("chunk").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
        return met.where((F.col("n") == len(chars)) & (F.bitmap_count("bits") > 0)).drop("n")

    def search(self, query: str, k: int = 750, sort: str = "name", descending: bool = False, **options) -> DataFrame:
        """The first k live files that match, as titles.search over rows() gives them; options as in titles.matcher.

        A pattern, and a query on whole paths, can't be told by characters of names: all live files are tested. So is every
        file for an empty query.
        """
        test = titles.matcher(query, **options)
        if not query or options.get("use_regex") or titles.on_paths(query):
            return titles.search(self.rows(), test, k, sort, descending)
        parts = live(self.log.entries())
        found = self.candidates(query)
        rows = in_groups(read_parts(self.log, [p["part"] for p in parts], ROWS), found, self.chunks_each, MOST_NAMED)
        near = rows.join(found, "chunk").where(has_bit(F.col("bits"), F.col("place"))).drop("bits")
        return titles.search(self._alive(parts, near).drop("chunk", "place", "grp"), test, k, sort, descending)
