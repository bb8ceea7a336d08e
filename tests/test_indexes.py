"""Indexes that grow by batches give what a scan of everything gives, and read less."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import content, titles
from lodestone.plans.intent import Term
from lodestone.schema import FILE_RECORD
from lodestone.sources.content_index import ContentIndex, grams_of
from lodestone.sources.log import Log, live, vacuum
from lodestone.sources.title_index import TitleIndex, characters_of


def test_a_commit_is_put_once(spark, tmp_path):
    one, other = Log(spark, str(tmp_path)), Log(spark, str(tmp_path))
    assert one.entries() == [] and one.put(0, {"added": [{"part": "rows/a"}]}) and not other.put(0, {"added": []})
    calls = []

    def change(before):
        calls.append(len(before))
        if len(calls) == 1:  # the other writer is first
            assert other.put(1, {"added": [{"part": "rows/b"}], "removed": ["rows/a"]})
        return {"added": [{"part": "rows/c"}]}

    assert one.commit(change)["number"] == 2 and calls == [1, 2]
    assert [p["part"] for p in live(other.entries())] == ["rows/b", "rows/c"]
    assert one.commit(lambda before: None) is None


def test_an_unfinished_commit_is_not_seen(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    log.put(0, {"added": [{"part": "rows/a"}]})
    (tmp_path / "log" / f"{1:020d}.json").write_text('{"added"')
    assert len(log.entries()) == 1


def test_old_parts_go(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    for name in "abc":
        (tmp_path / "rows" / name).mkdir(parents=True)
    (tmp_path / "rows" / "unnamed").mkdir()
    log.put(0, {"added": [{"part": "rows/a"}]})
    log.put(1, {"added": [{"part": "rows/b"}], "removed": ["rows/a"]})
    assert vacuum(log, ["rows"], keep=2) == []
    log.put(2, {"added": [{"part": "rows/c"}], "removed": ["rows/b"]})
    assert vacuum(log, ["rows"], keep=1) == ["rows/a", "rows/b"]
    assert log.children("rows") == ["c", "unnamed"]


ODD = ["Straße.txt", "STRASSE.txt", "ΟΔΟΣ.txt", "οδος_1", "İstanbul", "ıstanbul", "a", "", "tab\there", "계정 목록.xlsx", "🙂 smile.png", "q" * 300, "x_ray.PNG", "ray", "array"]


def odd_files(spark):
    rows = [(n, f"/odd/{i}/{n}", f"/odd/{i}", "", i % 4 == 0, None if i % 5 == 0 else i, i, i) for i, n in enumerate(ODD)]
    rows += [(None, "/odd/none", "/odd", "", False, 1, 1, 1), ("none", None, None, None, None, None, None, None), ("ray", "/ODD/13/ray", "/odd/13", "", False, 99, 99, 99)]
    return spark.createDataFrame([(*r, 7) for r in rows], FILE_RECORD + ", chunk int")  # a clashing column


def many_files(spark, n=3000):
    words = ["ring", "bolt", "widget", "gear", "array"]
    rows = [(f"{words[i % 5]}_{i}.txt", f"/many/{i % 7}/{words[i % 5]}_{i}.txt", f"/many/{i % 7}", ".txt", False, i, i, i) for i in range(n)]
    return spark.createDataFrame([*rows, ("zebra~.txt", "/many/zebra~.txt", "/many", ".txt", False, 1, 1, 1)], FILE_RECORD)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    index = TitleIndex(spark, str(tmp_path_factory.mktemp("titles")), chunk=100, chunks_each=2, buckets=8)
    files = many_files(spark)
    index.add(files.where("size_bytes % 3 <> 0"), "a")
    index.add(files.where("size_bytes % 2 = 0").withColumn("size_bytes", -F.col("size_bytes")).unionByName(odd_files(spark).drop("chunk")), "b", files.where("size_bytes % 10 = 1").select("full_path"))
    index.add(files, "b")  # repeated work adds nothing
    return index


def check(index, query, **options):
    cut = {k: options.pop(k) for k in ("k", "sort", "descending") if k in options}
    found = index.search(query, **cut, **options)
    want = titles.search(index.rows(), titles.matcher(query, **options), cut.get("k", 750), cut.get("sort", "name"), cut.get("descending", False))
    assert [tuple(r) for r in found.select(*want.columns).collect()] == [tuple(r) for r in want.collect()]
    return found


def test_live_rows(index):
    rows = {r["full_path"]: r["size_bytes"] for r in index.rows().collect()}
    want = {f"/many/{i % 7}/{w}_{i}.txt": -i if i % 2 == 0 else i for i in range(3000) for w in [["ring", "bolt", "widget", "gear", "array"][i % 5]] if (i % 3 or i % 2 == 0) and i % 10 != 1}
    assert {p: s for p, s in rows.items() if p.startswith("/many/") and "zebra" not in p} == want
    assert "/many/zebra~.txt" not in rows and rows["/ODD/13/ray"] == 99 and "/odd/13/ray" not in rows


@pytest.mark.parametrize(
    ("query", "options"),
    [("ring", {}), ("r", {}), ("", {}), ("gear_29", {"sort": "size", "descending": True, "k": 7}), ("RAY", {"match_case": True}), ("ray", {"whole_word": True}), ("οδοσ", {}), ("ΟΔΟΣ", {}), ("straße", {}), ("İ", {}), ("🙂", {}), ("목록", {"kind": "files"}), ("q", {"kind": "folders"}), ("/many/3", {}), (r"^a.*7\.txt$", {"use_regex": True}), ("nothing#", {}), ("\t", {})],
)
def test_the_index_finds_what_a_scan_finds(index, query, options):
    check(index, query, **options)


def test_only_folders_that_may_match_are_read(spark, index):
    parts = [index.log.path(p["part"]) for p in live(index.log.entries())]
    folders = sum(spark.read.parquet(p).select("grp").distinct().count() for p in parts)
    found = index.search("목록")
    found.collect()
    read = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters", 1)[1]
    assert "grp" in read.split("PushedFilters")[0]
    groups = index.candidates("목록").select(F.floor(F.col("chunk") / 2)).distinct().count()
    assert groups == 1 and folders > 10


def test_compaction_and_growth(spark, tmp_path):
    index = TitleIndex(spark, str(tmp_path), chunk=50, chunks_each=1, buckets=4)
    files = many_files(spark, 400)
    index.add(files.where("size_bytes < 200"), "a")
    index.add(files.where("size_bytes >= 200"), "b", files.where("size_bytes < 20").select("full_path"))
    before = sorted(r["full_path"] for r in index.rows().collect())
    index.compact("whole")
    assert len(live(index.log.entries())) == 1 and sorted(r["full_path"] for r in index.rows().collect()) == before
    index.add(files.where("size_bytes < 5"), "c")
    assert index.rows().count() == len(before) + 6  # some that were ended (zebra~ too) are back
    check(index, "ring_1")
    assert TitleIndex(spark, str(tmp_path / "none")).search("a").count() == 0


def test_an_empty_batch(spark, tmp_path):
    index = TitleIndex(spark, str(tmp_path), chunk=50)
    index.add(many_files(spark, 10).limit(0), "empty")
    assert index.search("a").count() == 0 and index.rows().count() == 0
    index.add(many_files(spark, 10), "some")
    assert index.search("ring").count() == 2


def test_characters():
    assert characters_of("Ring ς") == [" ", "g", "i", "n", "r", "σ"]


def term(word, *more):
    return Term(word, (word, *more), (word, *more))


WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "계정", "straße", "x"]


def texts(spark, n=600):
    rows = [(f"k{i:05}", f"{WORDS[i % 9]}_{i}.txt", f"/d/{WORDS[i % 7]}", i // 3, " ".join(WORDS[j % 9] + ("s" if (i * j) % 5 == 0 else "") for j in range(i % 11, i % 11 + i % 23))) for i in range(n)]
    odd = [("o1", None, None, None, None), ("o2", "", "", 1, ""), ("o3", "Ωmega", "/d", 1, "alpha 🙂🙂 ﬁ \0 ÀB"), ("o4", "n", "/d", 1, "alpha " * 3000), (None, "n", "/d", 1, "alpha beta"), ("o5", "a", "/d", 1, "al"), ("o6", "a", "/d", 1, "old beta"), ("o6", "a", "/d", 2, "new alpha beta")]
    return spark.createDataFrame([(*r, 9, b"x") for r in rows + odd], "doc_key string, name string, directory_path string, modified long, text string, chunk int, grp binary")


@pytest.fixture(scope="module")
def contents(spark, tmp_path_factory):
    index = ContentIndex(spark, str(tmp_path_factory.mktemp("contents")), docs=32, chunks_each=2, buckets=8)
    rows = texts(spark)
    index.add(rows.where("doc_key IS NULL OR crc32(doc_key) % 3 <> 0"), "a")
    index.statistics((term("alpha"), term("of")))
    index.add(rows.where("crc32(doc_key) % 2 = 0").withColumn("text", F.concat("text", F.lit(" gammas"))), "b", rows.where("crc32(doc_key) % 11 = 0").select("doc_key"))
    return index


@pytest.mark.parametrize(
    ("terms", "k"),
    [((term("alpha"), term("beta", "gamma")), 10), ((term("of"), term("delta")), 1000), ((term("계정"), term("straße"), term("the")), 7), ((term("nowhere"), term("alpha")), 5), ((term("nowhere"),), 5), ((term("🙂"), term("ﬁ")), 3), ((term("alphas", "betas"), term("gamma", "d")), 12)],
)
def test_texts_found_are_those_of_a_scan(contents, terms, k):
    want = content.search(contents.documents(), terms, k, "doc_key", "text", F.col("name"), F.col("directory_path"), None, F.col("modified"))
    got = contents.search(terms, k)
    assert got.columns == want.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert contents.statistics(terms).first().asDict() == content.statistics(contents.documents(), terms).first().asDict()


def test_hard_filters_hold(contents):
    where = F.col("modified") > 50
    want = content.search(contents.documents(), (term("alpha"),), 9, "doc_key", "text", F.col("name"), F.col("directory_path"), where, F.col("modified"))
    assert [tuple(r) for r in contents.search((term("alpha"),), 9, where).collect()] == [tuple(r) for r in want.collect()]


def test_of_one_key_the_newest_counts(contents):
    assert [r["text"].removesuffix(" gammas") for r in contents.documents().where("doc_key = 'o6'").collect()] == ["new alpha beta"]


def test_known_parts_are_not_counted_again(spark, tmp_path):
    index = ContentIndex(spark, str(tmp_path), docs=32, buckets=4)
    rows, asked, count = texts(spark, 120), [], index._count
    index._count = lambda new, parts, terms: asked.append(len(new)) or count(new, parts, terms)
    index.add(rows, "a")
    one = index.statistics((term("alphas"),)).first()
    index.statistics((term("alphas"),))
    index.add(rows.where("doc_key < 'k00010'").withColumn("doc_key", F.concat(F.lit("z"), "doc_key")), "b")
    two = index.statistics((term("alphas"),)).first()
    index.add(rows.where("doc_key = 'k00001'"), "c")  # changes the first part
    three = index.statistics((term("alphas"),)).first()
    assert asked == [1, 1, 2] and two["n_docs"] == one["n_docs"] + 10 and three.asDict() == two.asDict()


def test_only_texts_that_may_hold_a_term_are_read(spark, tmp_path):
    index = ContentIndex(spark, str(tmp_path), docs=16, chunks_each=1, buckets=4)
    rows = spark.createDataFrame([(f"k{i:04}", "needle here" if i == 700 else f"hay {i}") for i in range(800)], "doc_key string, text string")
    index.add(rows, "a")
    found = index.candidates((term("needle"),))
    assert [(r["caps"]) for r in found.collect()] == [[1]]
    (part,) = live(index.log.entries())
    folders = [x for x in index.log.children(part["part"]) if x.startswith("grp=")]
    plan = index._texts([part], found)._jdf.queryExecution().executedPlan().toString()
    assert len(folders) >= 50 and "PartitionFilters" in plan and "grp" in plan.split("PartitionFilters", 1)[1][:80]
    assert [r["doc_key"] for r in index.search((term("needle"),), 3).collect()] == ["k0700"]


def test_grams():
    assert grams_of("abca") == ["abc", "bca"] and grams_of("ab") == []
