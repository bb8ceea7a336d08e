"""Named queries over the driver's tables, their DuckDB SQL, and the views both read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The moment at which ages are measured: 2024-07-01 UTC, in microseconds.
NOW = 1_719_792_000_000_000
DAY = 86_400_000_000


def query(sql: str | None = None) -> Callable:
    """Register a function by its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(rows: DataFrame) -> DataFrame:
    """An ordered, bounded list's rows with their place in it (from 1): the order itself, without a window over all rows."""
    one = rows.columns
    listed = rows.limit(100_000).agg(F.collect_list(F.struct(*one)).alias("l"))  # keeps the order of a sorted, bounded table
    return listed.select(F.posexplode("l").alias("p", "r")).select("r.*", (F.col("p") + 1).cast("long").alias("place"))


_EXTENSIONS = (".ppk", ".xlsx", ".txt", ".png", ".py", ".pdf", ".zip", ".docx", "", ".blend")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files and folders: the name from p_name, the folder from p_type and p_brand."""
    p = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("p_partkey") % len(_EXTENSIONS) + 1).cast("int"))
    rows = p.select(
        F.col("p_partkey").alias("file_id"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), ext).alias("name"),
        F.concat(F.lit("/store/"), F.lower("p_type"), F.lit("/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_"))).alias("directory_path"),
        ext.alias("extension"),
        (ext == "").alias("is_directory"),
        F.when(ext != "", F.col("p_size") * 1000 + F.col("p_partkey")).cast("long").alias("size_bytes"),
        (F.lit(1_704_067_200_000_000) + F.col("p_partkey") * 3_600_000_000).alias("created"),
        "p_size",
    )
    return rows.select("file_id", "name", F.concat("directory_path", F.lit("/"), "name").alias("full_path"), "directory_path", "extension", "is_directory", "size_bytes", "created", (F.col("created") + F.col("p_size") * F.lit(DAY)).alias("modified"))


FILES_SQL = """files AS (
  SELECT file_id, name, directory_path || '/' || name AS full_path, directory_path, extension, extension = '' AS is_directory,
         CASE WHEN extension <> '' THEN (p_size * 1000 + file_id)::BIGINT END AS size_bytes, created, created + p_size::BIGINT * 86400000000 AS modified
  FROM (SELECT p_partkey AS file_id, replace(p_name, ' ', '_') || '_' || p_partkey || ext AS name, '/store/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '_') AS directory_path,
               ext AS extension, p_size, 1704067200000000 + p_partkey * 3600000000 AS created
        FROM (SELECT *, list_extract(['.ppk', '.xlsx', '.txt', '.png', '.py', '.pdf', '.zip', '.docx', '', '.blend'], (p_partkey % 10 + 1)::INT) AS ext FROM part)))"""


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a name and a path."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.concat(F.lit("/docs/"), "lang", F.lit("/"), "source").alias("directory_path"), "lang", "source", "n_chars")


CONTENTS_SQL = "contents AS (SELECT doc_id, text, 'doc_' || doc_id || '.txt' AS name, '/docs/' || lang || '/' || source AS directory_path, lang, source, n_chars FROM documents)"
