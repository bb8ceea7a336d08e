"""Queries through indexes that grow by batches: titles by characters, texts by trigrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.content_index import ContentIndex
from ..sources.shared import new_folder
from ..sources.title_index import TitleIndex
from .registry import FILES_SQL, files, query, table
from .texts import _BM25, WANTED

#: What is typed, its options, and the same as a condition in SQL.
_TYPED = (
    ("ring", {}, "contains(lower(name), 'ring')"),
    ("7", {}, "contains(lower(name), '7')"),
    ("BOLT_1", {}, "contains(lower(name), 'bolt_1')"),
    ("Blue", {"match_case": True}, "contains(name, 'Blue')"),
    ("widget", {"whole_word": True, "kind": "files"}, "NOT is_directory AND regexp_matches(lower(name), '(^|[^\\p{L}\\p{Nd}])widget($|[^\\p{L}\\p{Nd}])')"),
    ("x", {"kind": "folders"}, "is_directory AND contains(lower(name), 'x')"),
    ("economy/brand_2", {}, "contains(lower(full_path), 'economy/brand_2')"),
    ("^red.*[05]\\.(png|pdf)$", {"use_regex": True}, "regexp_matches(name, '(?i)^red.*[05]\\.(png|pdf)$')"),
    ("~", {}, "contains(lower(name), '~')"),
)
_MOST = 60
_TITLES = "SELECT '{label}' AS typed, row_number() OVER (ORDER BY lower(name), lower(full_path), full_path) AS place, full_path, size_bytes FROM live WHERE {test} QUALIFY place <= {most}"


@query(
    f"WITH {FILES_SQL}, live AS (SELECT name, full_path, is_directory, CASE WHEN file_id % 2 = 0 THEN size_bytes ELSE size_bytes + 7 END AS size_bytes FROM files WHERE file_id % 10 <> 5) "
    + " UNION ALL ".join(f"(SELECT * FROM ({_TITLES.format(label=q.replace(chr(39), chr(39) * 2), test=test, most=_MOST)}))" for q, _, test in _TYPED)
)
def title_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index made of two batches: the second has a part of the first's paths again, and ends some others."""
    rows = files(spark, sf_dir)
    index = TitleIndex(spark, new_folder(spark, "titles"))
    index.add(rows.where("file_id % 4 <> 0").withColumn("size_bytes", F.col("size_bytes") + 7), "first")
    index.add(rows.where("file_id % 2 = 0"), "second", rows.where("file_id % 10 = 5").select("full_path"))
    found = [index.search(q, _MOST, **options).select(F.lit(q).alias("typed"), "name", "full_path", "size_bytes") for q, options, _ in _TYPED]
    place = Window.partitionBy("typed").orderBy(F.lower("name"), F.lower("full_path"), "full_path")  # _MOST rows each
    return reduce(DataFrame.union, found).withColumn("place", F.row_number().over(place).cast("long")).select("typed", "place", "full_path", "size_bytes")


@query(_BM25.replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' license' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 5))"))
def content_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_bm25_topk through an index of two batches: the second replaces some documents and ends others."""
    rows = table(spark, sf_dir, "documents").withColumn("doc_key", F.lpad(F.col("doc_id").cast("string"), 18, "0"))
    index = ContentIndex(spark, new_folder(spark, "contents"))
    index.add(rows.where("doc_id % 4 <> 0"), "first")
    index.statistics(WANTED)  # the second batch changes the first's documents: what is known of them is counted again
    index.add(rows.where("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit(" license"))), "second", rows.where("doc_id % 10 = 5").select("doc_key"))
    found = index.search(WANTED, 50)
    return found.select(F.col("doc_key").cast("long").alias("doc_id"), F.round("lexical", 6).alias("lexical"), F.col("matched").cast("long").alias("matched"), F.round("coherence", 6).alias("coherence"), F.round("score", 6).alias("score"))
