"""Whole searches over a small tree, with a deterministic model."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine, micros
from lodestone.operators.vectors import index_rows
from lodestone.plans.intent import compile_intent
from lodestone.schema import FILE_RECORD

NOW = datetime(2024, 7, 17)
DAY = 86_400_000_000
NAMES = ["keys/aws_viewplasticsurgery_key.ppk", "keys/aws_notes.txt", "work/network account list.xlsx", "work/계정 목록.xlsx", "work/meeting_report.docx", "photos/cat.png", "photos/dog.png", "models/bridge.stl", "plans/지하 3층 도면.dwg", "plans/지하 13층 도면.dwg", "etc/random.bin"]
TEXTS = {"work/계정 목록.xlsx": "NEPTUNE-FW-8842 firewall owner", "keys/aws_notes.txt": "notes about wifi error in the office, network failed", "work/meeting_report.docx": "wifi error report: the network account was locked", "etc/random.bin": "wireguard mullvad tunnel"}


def embed(text):
    return [1.0, 0.0, 0.0] if "wireguard" in text.lower() else [0.0, 1.0, 0.0]


@pytest.fixture(scope="module")
def engine(spark):
    rows = []
    for n, path in enumerate(NAMES):
        folder, name = path.rsplit("/", 1)
        rows.append((name, f"/root/{path}", f"/root/{folder}", "." + name.rsplit(".", 1)[1], False, 1000 * n, micros(NOW) - n * DAY, micros(NOW) - n * DAY))
    files = spark.createDataFrame(rows, FILE_RECORD).persist()
    docs = spark.createDataFrame([(f"/root/{p}", t) for p, t in TEXTS.items()], "path_key string, text string")
    vectors = spark.createDataFrame([(r[1].lower(), r[7], embed(TEXTS.get(r[1].removeprefix("/root/"), ""))) for r in rows], "path_key string, modified long, embedding array<float>")
    stale = spark.createDataFrame([("/root/photos/cat.png", 1, [1.0, 0.0, 0.0])], "path_key string, modified long, embedding array<float>")
    apps = spark.createDataFrame([(1, "AWS Console"), (2, "Paint")], "app_id long, name string")
    return Engine(files, docs, index_rows(vectors.union(stale)), applications=apps, embed=embed)


def names(df):
    return [r["name"] for r in df.collect()]


@pytest.mark.parametrize("query", ["AWS 키", "aws key", "aws 키 찾아줘", "AWS ppk 파일"])
def test_the_key_is_among_the_first_three(engine, query):
    assert "aws_viewplasticsurgery_key.ppk" in names(engine.search(query, NOW, 10))[:3]


def test_name_and_cell_together_come_first(engine):
    rows = engine.search("계정 NEPTUNE", NOW, 10).collect()
    assert rows[0]["name"] == "계정 목록.xlsx" and rows[0]["kind"] == "Combined" and rows[0]["percent"] == 99.0


def test_types_and_floors(engine):
    assert set(names(engine.search("*.stl", NOW))) == {"bridge.stl"}
    assert names(engine.search("지하 3층 도면", NOW)) == ["지하 3층 도면.dwg"]


def test_meaning_needs_no_word(engine):
    rows = {r["name"]: r for r in engine.search("wireguard tunnel", NOW).collect()}
    assert rows["random.bin"]["kind"] in ("Content", "Combined") and "cat.png" not in rows  # its vector is stale


def test_roots_and_empty_wishes(engine):
    found = engine.search("aws key", NOW, roots=["/root/work"]).collect()
    assert found and all(r["full_path"].startswith("/root/work/") for r in found)
    assert names(engine.search("찾아줘", NOW)) == []


def test_stages_and_refinement(engine):
    steps = dict(engine.stages("wifi error", NOW, 10))
    assert list(steps) == ["titles", "applications", "words", "vectors"]
    assert [n for n, _ in engine.stages("'aws key'", NOW)] == ["titles", "applications"]
    found = engine.search("wifi error network", NOW)
    assert names(engine.refine(found, "report", NOW)) == ["meeting_report.docx"]


def test_titles(engine):
    assert names(engine.titles("aws")) == ["aws_notes.txt", "aws_viewplasticsurgery_key.ppk"]


def test_one_plan_without_products_of_rows(engine):
    plan = engine.search("wifi error", NOW).select(F.col("name"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_indexes_answer_as_tables_do(spark, engine, tmp_path):
    from lodestone.sources.content_index import ContentIndex
    from lodestone.sources.title_index import TitleIndex

    titles, texts = TitleIndex(spark, str(tmp_path / "t"), chunk=4), ContentIndex(spark, str(tmp_path / "c"), docs=2)
    titles.add(engine.files, "a")
    own = engine.files.select(F.lower("full_path").alias("doc_key"), "name", "directory_path", "modified")
    texts.add(engine.documents.withColumnRenamed("path_key", "doc_key").join(own, "doc_key"), "a")
    indexed = Engine(None, vectors=engine.vectors, embed=embed, title_index=titles, content_index=texts)
    want = engine.search("계정 NEPTUNE", NOW, 10)
    assert [tuple(r) for r in indexed.search("계정 NEPTUNE", NOW, 10).select(*want.columns).collect()] == [tuple(r) for r in want.collect()]
    assert names(indexed.titles("aws")) == names(engine.titles("aws"))
    within = indexed._content_by_index(compile_intent("wifi error", NOW), indexed.keyed(), NOW, 10, F.startswith("doc_key", F.lit("/root/work/"))).collect()
    assert [r["path_key"] for r in within] == ["/root/work/meeting_report.docx"]


def test_equal_scores_of_a_lane_come_newest_first(spark):
    files = spark.createDataFrame([(f"{c}.txt", f"/r/{c}.txt", "/r", ".txt", False, 1, 1, m) for c, m in (("a", 1), ("b", 9), ("c", 5))], FILE_RECORD)
    docs = spark.createDataFrame([(f"/r/{c}.txt", "same words here") for c in "abc"], "path_key string, text string")
    assert names(Engine(files, docs).search("same words", NOW)) == ["b.txt", "c.txt", "a.txt"]
