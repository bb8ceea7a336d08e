"""From raw documents to packed training sequences: language, quality, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import fresh, materialize, table
from lodestone.llm.language import UNKNOWN, identify
from lodestone.llm.near_duplicates import near_duplicates
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import sample_rows

#: Cosines with the nearest language's prototype under which a document is of none, if it has so many letters that the cosine
#: tells: 1024 dimensions make it uncertain by 0.03, and a word or two share few trigrams with any prototype.
LEAST_COSINE, LETTERS = 0.1, 40


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without letters, or long enough and unlike every language, go."""
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    short = F.length(F.regexp_replace("text", r"[^\p{L}]", "")) < LETTERS
    kept = identify(docs, names=(lang, score)).where((F.col(lang) != UNKNOWN) & ((F.col(score) >= LEAST_COSINE) | short))
    return kept.select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects for the labelled target."""
    return sample_rows(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id. Rows without a doc_id stay.

    Of rows with one doc_id and equal texts the first in the order of all columns stays; those with other texts stay each.
    """
    found = materialize(near_duplicates(docs), "kept")
    kept = docs.join(found.where("kept").select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").select(docs.columns)
    repeated = found.where("kept").groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        twice = kept.join(repeated.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
        turn = fresh(docs.columns, "turn")
        order = [F.col(c).cast("string").asc_nulls_first() for c in docs.columns]
        first = twice.withColumn(turn, F.row_number().over(Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy(*order))).where(F.col(turn) == 1)
        kept = kept.join(repeated.select("doc_id"), "doc_id", "left_anti").select(docs.columns).union(first.select(docs.columns))
    return kept.union(docs.where("doc_id IS NULL"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [("language ID", language_id), ("quality", quality), ("near dedup", near_dedup), ("packing", packing)]

#: Byte-pair encoding and the language model of stage 1 have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
