"""The pipeline against brute-force stages, and its queries."""

import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lodestone.llm import queries
from test_near_duplicates import brute_force
from test_queries import TABLES, as_counter
from test_tokens import check_packing


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "quality", "near dedup", "packing"] and corpus_pipeline.ORACLE_SQL is None
    known = stages["language ID"](spark, docs, sf_dir)
    clean = stages["quality"](spark, known, sf_dir)
    assert known.columns == clean.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    kept = stages["near dedup"](spark, clean, sf_dir)
    assert kept.columns == docs.columns
    first = {i for i, _, c in brute_force(rows) if i == c}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first)
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert check_packing(packed, [(i, t) for i, t in rows if i in first], 2048) <= -(-sum(r["length"] for r in packed) // 2048) + 1


def test_stages_bear_odd_documents(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.count() <= docs.count(), name


def test_stages_leave_every_column_as_it_was(spark, odd_docs, sf_dir):
    """score, rank and others of the input come out of each stage with their own values."""
    have = Counter(map(str, odd_docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert not Counter(map(str, stage(spark, odd_docs, sf_dir).collect())) - have, name


def test_texts_of_one_doc_id_are_judged_each(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (1, "quite another text with words of its own", "b"), (1, long, "c"), (2, long + " end", "d"), (3, None, "e"), (3, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
    assert sorted((r["doc_id"], r["other"]) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == [(1, "a"), (1, "b"), (3, "e")]


def test_language_stage_keeps_short_words_and_drops_letter_junk(spark, sf_dir):
    rng = random.Random(3)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüéèñ") + " " * (rng.random() < 0.15) for _ in range(600)) for _ in range(30)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**9 + i, x, None) for i, x in enumerate(junk)] + [(2 * 10**9, "A.", None), (2 * 10**9 + 1, "Avec.", None)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.union(more), sf_dir).collect()}
    assert {2 * 10**9, 2 * 10**9 + 1} <= kept and sum(10**9 + i in kept for i in range(30)) <= 3
    labelled = {r["doc_id"] for r in docs.where("lang IS NOT NULL AND text rlike '[a-zA-Z]'").collect()}
    assert len(labelled - kept) <= 0.01 * len(labelled)


def test_language_stage_rejects_what_has_no_letters(spark, odd_docs, sf_dir):
    kept = corpus_pipeline.language_id(spark, odd_docs, sf_dir)
    assert kept.where(~F.col("text").rlike(r"\p{L}")).count() == 0 and kept.where("doc_id = 4").count() == 2


def test_near_dedup_keeps_one_of_repeated_rows_and_all_without_id(spark, odd_docs, sf_dir):
    ids = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, odd_docs, sf_dir).collect()]
    assert ids.count(4) == 1 and 101 not in ids and None in ids


def test_every_operator_is_registered_once(spark):
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_sql_of_operators(spark, sf_dir):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf_dir)
        found = duck.execute(sql)
        assert as_counter(df.columns, df.collect()) == as_counter([d[0] for d in found.description], found.fetchall()), name
