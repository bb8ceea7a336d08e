"""Every query with SQL gives what DuckDB gives on the same tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def as_counter(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(tuple(r[i]) if isinstance(r[i], list) else r[i] for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert df.columns
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert as_counter(df.columns, rows) == as_counter(names, found.fetchall())


def spread(duck, sf_dir, tmp_path, factor, **keys):
    """The tables of keys with their keys multiplied, as larger tables have them, and a connection that sees them."""
    c = duck.cursor()
    for t, key in keys.items():
        c.execute(f"COPY (SELECT * REPLACE ({key} * {factor} AS {key}) FROM '{sf_dir}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
        c.execute(f"CREATE TEMP VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    return str(tmp_path), c


def test_sizes_of_large_keys(spark, sf_dir, duck, tmp_path):
    where, c = spread(duck, sf_dir, tmp_path, 6007, orders="o_orderkey")
    df = QUERIES["size_short"](spark, where)
    found = c.execute(ORACLE_SQL["size_short"]).fetchall()
    assert max(float(shown.split()[0]) for _, shown in found) > 1024  # more than a terabyte
    assert Counter(map(tuple, df.select("o_orderkey", "shown").collect())) == Counter(found)


@pytest.mark.parametrize("factor", [40, 600])  # days to come; wishes that are infinite, so that only paths tell
def test_wishes_of_large_keys(spark, sf_dir, duck, tmp_path, factor):
    where, c = spread(duck, sf_dir, tmp_path, factor, documents="doc_id", embeddings="vec_id")
    rows = [tuple(r) for r in QUERIES["wished_order"](spark, where).collect()]
    assert rows == c.execute(ORACLE_SQL["wished_order"]).fetchall() and rows[0][2] > 1


def test_entry(spark):
    assert entry.entry(spark).schema.fieldNames() == ["doc_id", "lexical", "matched", "coherence", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top_k_is_pushed_into_the_sort(spark, sf_dir):
    plan = QUERIES["content_bm25_topk"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    plan = QUERIES["extension_categories"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "p_retailprice" not in plan.split("== Physical Plan ==")[1]
