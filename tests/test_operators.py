"""Formulas and ranking rules on literal rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import patterns
from lodestone.functions import scores as S
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.functions.models import TooLarge, embed_text, sampled_pages, with_recovery
from lodestone.operators import content, fusion, metadata, results, titles
from lodestone.operators import vectors as VO
from lodestone.plans.intent import Directive, Intent, Term

FILE = "file_id long, name string, full_path string, directory_path string, extension string, is_directory boolean, size_bytes long, created long, modified long"
DAY = 86_400_000_000


def term(word, *more):
    return Term(word, (word, *more), (word, *more))


def make_files(spark, rows):
    out = [(i, n, f"{d}/{n}", d, "" if "." not in n else "." + n.rsplit(".", 1)[1], "." not in n, 1000, c * DAY, m * DAY) for i, (n, d, c, m) in enumerate(rows)]
    return spark.createDataFrame(out, FILE)


def test_created_recency_orders_equal_matches(spark):
    files = make_files(spark, [("aws_archive_key.ppk", "/a", 100, 999), ("aws_current_key.ppk", "/a", 998, 970), ("aws_monkey_notes.txt", "/a", 999, 999)])
    intent = Intent("aws key", (term("aws"), term("key")), directives=(Directive("CreatedRecency", weight=0.45, half_life_days=90),))
    ids = [r["file_id"] for r in metadata.search(files, intent, 10, 1000 * DAY).collect()]
    assert ids[:2] == [1, 0] and ids.index(2) == 2


def test_full_match_above_partial(spark):
    files = make_files(spark, [("network_account_list.txt", "/a", 1, 1), ("network.txt", "/a", 1, 9)])
    rows = metadata.search(files, Intent("", (term("network"), term("account"), term("list"))), 10).collect()
    assert [r["file_id"] for r in rows] == [0, 1] and rows[0]["tier"] == 3


def test_near_words_above_far_ones(spark):
    near, far = "alpha beta gamma delta", "alpha " + "x " * 900 + "beta gamma " + "y " * 900 + "delta"
    docs = spark.createDataFrame([(1, far), (2, near), (3, "alpha only"), (4, None)], "doc_id long, text string")
    rows = content.search(docs, tuple(map(term, ("alpha", "beta", "gamma", "delta"))), 10).collect()
    assert [r["doc_id"] for r in rows][0] == 2 and 3 not in [r["doc_id"] for r in rows]
    with pytest.raises(ValueError):
        content.search(docs, (), 1)


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    terms = (term("the"), term("token"))
    one, many = (sorted((r["doc_id"], round(r["score"], 9)) for r in content.search(docs.repartition(n), terms, 20).collect()) for n in (1, 7))
    assert one == many
    few = [r["doc_id"] for r in content.search(docs, terms, 5).collect()]
    assert few == [r["doc_id"] for r in content.search(docs, terms, 20).collect()][:5]


def test_script_predicates_in_three_values(spark):
    rows = spark.createDataFrame([("문서.txt", "글자"), ("문서2.txt", None), ("doc.txt", "text")], "name string, text string")
    p = F.when(F.col("text").isNotNull(), T.script_profile(F.col("text")))
    got = rows.select(T.attribute(("Hangul", "Name", "Only"), P.stem(F.col("name")), F.lit(""), p), T.attribute(("Latin", "Content", "Contains"), F.col("name"), F.lit(""), p)).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, None), (False, True)]


def test_floors_and_visibility(spark):
    rows = spark.createDataFrame([("지하 3층",), ("B13F",), ("b3f plan",), ("3층",)], "t string")
    assert [r[0] for r in rows.select(T.has_all_floors(F.col("t"), ((True, 3),))).collect()] == [True, False, True, False]
    assert spark.range(1).select(P.visible(F.lit("/a/~b/c")), P.visible(F.lit("/a/b~/c"))).first() == (False, True)


def test_segments(spark):
    long = "".join(chr(97 + i % 26) for i in range(1000))
    r = spark.createDataFrame([(long,), ("short",), ("",)], "t string").select(T.compact_segment(F.col("t")).alias("c"), T.segments(F.col("t")).alias("s")).collect()
    assert len(r[0]["c"]) == 240 and len(r[0]["s"]) == 5 and r[1]["c"] == "short" and r[1]["s"] == ["short"]


def test_quantized_cosine_is_near_the_exact_one(spark):
    rng = random.Random(3)
    rows = [(i, V.unit([rng.gauss(0, 1) for _ in range(32)])) for i in range(50)]
    df = VO.index_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    for r in df.select("vec_id", V.cosine_bytes(rows[0][1], F.col("quantized")).alias("c")).collect():
        assert abs(r["c"] - sum(a * b for a, b in zip(rows[0][1], rows[r["vec_id"]][1]))) < 0.01


def test_zero_vectors(spark):
    r = spark.range(1).select(V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), V.normalize(F.array(F.lit(0.0)))).first()
    assert r[0] == 0.0 and r[1] is None


def test_blend(spark):
    r = spark.range(1).select(V.blend(F.array(F.lit(0.2), F.lit(0.6)), False), V.blend(F.array(F.lit(0.2), F.lit(0.6)), True), V.blend(F.array(F.lit(0.4)), True)).first()
    assert [round(x, 9) for x in r] == [round(0.82 * 0.6 + 0.18 * 0.2, 9), round(0.65 * 0.6 + 0.35 * 0.2, 9), 0.4]


def lane(spark, number, rows):
    out = [(p, number, i, float(s), e, c, 0) for i, (p, s, e, c) in enumerate(rows)]
    return fusion.lane(spark.createDataFrame(out, "path_key string, lane int, lane_rank int, score double, evidence string, coverage double, modified long"))


def test_merge_and_guardrails(spark):
    names = lane(spark, 0, [("exact", 300, "ExactName", 1.0), ("both", 200, "NameCandidate", 1.0)])
    texts = lane(spark, 1, [("body", 900, "Content", 1.0), ("both", 400, "Content", 1.0)])
    merged = fusion.merge([names, texts])
    both = merged.where("path_key = 'both'").first()
    assert both["score"] == 200 + 0.55 * 400 and math.isclose(both["rrf"], 2 / 62)
    rows = fusion.order(merged, 10).collect()
    assert [(r["path_key"], r["kind"]) for r in rows] == [("exact", "ExactName"), ("both", "Combined"), ("body", "Content")]


def test_precision_first(spark):
    words = lane(spark, 0, [("a", 1, "ExactName", 1.0)])
    near = lane(spark, 2, [("a", 1, "SemanticCandidate", None), ("b", 1, "SemanticCandidate", None)])
    keep = lambda kind: sorted(r["path_key"] for r in fusion.without_unsupported(near, words, F.col("evidence") == kind).collect())
    assert keep("ExactName") == ["a"] and keep("Content") == ["a", "b"]


def test_rerank_promotes(spark):
    rows = spark.createDataFrame([(1, 100.0, 0.0), (2, 40.0, 1.0), (3, 10.0, 1.0)], "rank int, score double, s double")
    out = {r["rank"]: r["new_rank"] for r in VO.rerank(rows, F.col("s"), depth=2).collect()}
    assert out == {2: 1, 1: 2, 3: 3}


def test_recency_and_sizes(spark):
    now = 100 * DAY
    r = spark.range(1).select(S.recency(F.lit(90 * DAY), 10, now), S.recency(F.lit(None).cast("long"), 10, now), S.size_score(F.lit(10_000_000_000)), S.size_score(F.lit(0))).first()
    assert list(r) == [0.5, 0.0, 1.0, 0.0]


def test_title_options(spark):
    files = make_files(spark, [("Red Ring.txt", "/a", 1, 1), ("ringing.txt", "/a", 1, 1), ("ring", "/b", 1, 1)])
    count = lambda *a, **k: files.where(titles.matcher(*a, **k)).count()
    assert (count("ring"), count("ring", whole_word=True), count("Ring", match_case=True), count("ring", kind="folders"), count("/b/"), count("^r.*g$", use_regex=True)) == (3, 2, 1, 1, 1, 1)
    with pytest.raises(ValueError):
        titles.matcher("(", use_regex=True)


def test_postings(spark):
    files = make_files(spark, [(f"plain_{i}.txt", "/a", 1, 1) for i in range(50)] + [("계정.txt", "/a", 1, 1)])
    sizes = titles.postings(files, chunk=20).select("ch", "n")
    assert titles.rarest(sizes, "계t").first()["n"] == 1 and titles.rarest(sizes, "계q").count() == 0


def found_rows(spark, rows):
    """(name, folder, modified) with places and types."""
    out = [(i, n, d, "." + n.rpartition(".")[2] if "." in n else "", "." not in n, m) for i, (n, d, m) in enumerate(rows)]
    return spark.createDataFrame(out, "orig_idx int, name string, directory_path string, extension string, is_directory boolean, modified long")


def test_refinement_keeps_order_and_counts_unknown(spark):
    rows = found_rows(spark, [("wifi list.txt", "/a", 1), ("wifi error.txt", "/a", 1), ("notes.txt", "/a", 1)])
    out = results.refine(rows, Intent("", (term("wifi"), term("error"))))
    assert [r["orig_idx"] for r in out.collect()] == [1, 0]
    v = spark.createDataFrame([(None,), (1,), (1,)], "v int")
    assert results.unknown_count(v, F.col("v") == 1).first() == (3, 2, 1)


def test_refinement_by_floor_type_wish_and_unspaced_words(spark):
    rows = found_rows(spark, [("지하 3층 계정목록.xlsx", "/a", 1), ("B3 plan.dwg", "/b", 3), ("B13 plan.dwg", "/b", 4), ("old.dwg", "/지하 3층", 2), ("folder", "/b3", 9)])
    ids = lambda i, **k: [r["orig_idx"] for r in results.refine(rows, i, **k).collect()]
    assert ids(Intent("", floors=((True, 3),))) == [0, 1, 3, 4]
    assert ids(Intent("", floors=((True, 3),), extensions=frozenset((".dwg",)))) == [1, 3, 4]  # a folder with the floor is direct evidence
    assert ids(Intent("", (term("계정 목록"),))) == [] and ids(Intent("", (Term("목록", ("목록",), ("목록",)),))) == [0]
    assert ids(Intent("", extensions=frozenset((".dwg",)), directives=(Directive("ModifiedRecency", half_life_days=1.0),)), now_micros=4 * DAY) == [2, 1, 3]
    assert ids(Intent("", (Term("계정", ("account", "계정"), ()),))) == [0]


def test_rungs_of_titles(spark):
    files = make_files(spark, [("network account.xlsx", "/a", 1, 1), ("account list network.xlsx", "/a", 1, 1), ("account.txt", "/network", 1, 1), ("notes.txt", "/account", 1, 1), ("계정.txt", "/a", 1, 1)])
    files = files.withColumn("file_id", F.col("name"))
    account = Term("account", ("account", "계정"), ())
    got = {r["file_id"]: (r["rung"], r["score"], r["exact"]) for r in titles.ladder(files, Intent("network account xlsx", (term("network"), account)), 10).collect()}
    assert got == {
        "network account.xlsx": ("equal", 1000.0, True), "account list network.xlsx": ("typed", 860.0, False), "account.txt": ("path", 760.0 + 18 + 10, False),
        "notes.txt": ("some", 540 + 95 + 4.0, False), "계정.txt": ("some", 540 + 95 + 9.0, False),
    }
    one = titles.ladder(files, Intent("account", (account,)), 10).collect()
    assert "notes.txt" not in {r["file_id"] for r in one}  # one word must be in the title
    assert {r["rung"] for r in titles.ladder(files, Intent("xyz abc"), 10).collect()} == set()


def test_applications_by_source_and_without_gaps(spark):
    apps = spark.createDataFrame([(1, "Red Widget", "공용 바탕 화면"), (2, "RedWidget Pro", "공용 시작 메뉴"), (3, "Widget", None), (4, "the red widget", None)], "app_id int, name string, source string")
    got = {r["app_id"]: (r["score"], r["percent"]) for r in results.search_applications(apps, (term("red"), term("widget")), 10).collect()}
    assert got == {1: (780 + 170 + 110 + 110 + 80 + 70.0, 100.0), 2: (780 + 170 + 110 + 55.0, 92.0), 4: (780 + 170 + 110 + 110 + 35.0, 98.0)}
    assert {r["score"] for r in results.application_rows(results.search_applications(apps, (term("red"), term("widget")), 10)).collect()} == {820.0}


def test_percentages(spark):
    def one(kind, evidence=(), coverage=None, names=0, terms=0, semantic=None, best=0.0, visual=None):
        f = lambda x: F.lit(x).cast("double")
        kinds = F.array(*map(F.lit, evidence)) if evidence else F.array().cast("array<string>")
        return spark.range(1).select(S.match_percent(F.lit(kind), kinds, f(coverage), F.lit(names), F.lit(terms), f(semantic), f(best), f(visual), f(best))).first()[0]

    assert [one("ExactName", names=2, terms=2), one("ExactName", names=1, terms=2), one("Other"), one("NameCandidate"), one("Combined"), one("Combined", coverage=0.2)] == [99.0, 92.0, 70.0, 74.0, 96.0, 96.0]
    assert [one("Content"), one("Content", ("ExactName",)), one("SemanticCandidate", semantic=0.8), one("SemanticCandidate", semantic=0.8, best=0.8), one("VisualCandidate"), one("VisualCandidate", visual=0.08, best=0.08)] == [84.0, 99.0, 45.0, 72.0, 35.0, 48.0]


def test_targets_of_paths(spark):
    row = spark.createDataFrame([("nai_001.png", "/home/u/Pictures/ComfyUI/output", 1536), ("20240101123.jpg", "/home/u/Desktop/x", 0)], "n string, d string, b long")
    got = row.select(P.generated_image_priority(F.col("n"), F.col("d")), P.path_priority(F.col("d"), "/home/U"), P.size_short(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(80_000.0, 30, "1.5 KB"), (2_000.0, 50, "0 B")]
    assert results.scope_roots("FolderAndNetwork", "/a", [], ["//s", "//S", "/a"], []) == ["/a", "//s"] and results.scope_roots("Folder", None, [], [], []) == []
    assert results.title_root_order(["/x", "//net", "/cur", "/X"], "/CUR") == ["/cur", "//net", "/x"]


def test_patterns_end(spark):
    long = "a" * 100_000
    rows = spark.createDataFrame([(1, long + "!"), (2, "12.34"), (3, None), (4, "ÀB\n")], "i int, t string")
    got = lambda p, **k: [r["i"] for r in rows.where(patterns.matches(F.col("t"), p, **k)).orderBy("i").collect()]
    assert got("^(a+)+$") == [] and got("((a|aa)+)+b") == [] and got(r"(\d+)+") == [2] and got("^((a|aa)+)+!$") == [1]
    assert got("àb", match_case=False) == [4] and got("àb") == []


@pytest.mark.parametrize(("pattern", "why"), [(r"(a)\1", "back-references"), (r"(?P<x>a)(?P=x)", "back-references"), ("a(?=b)", "looking"), ("(?<!a)b", "looking"), ("(?>a)b", "atomic"), ("a++b", "possessive"), ("(", "not a regular"), ("[z-a]", "not a regular"), ("*a", "not a regular")])
def test_what_no_automaton_can_tell_is_refused(pattern, why):
    with pytest.raises(ValueError, match=why):
        patterns.validate(pattern)


def test_ordinary_patterns_pass():
    for pattern in (r"(\d+)+", "((a+))+b", r"[(?=]+", r"\Q(?=\E", "x" * 600, "a{2,5}?", r"\\1"):
        patterns.validate(pattern)


def test_labels_of_a_tagger(spark, tmp_path):
    (tmp_path / "tags.csv").write_text('tag_id,name,category,count\n1,"a, ""b""",4,9\n2,c ,9,1\n3,d,0,1\n4,e,x,1\n5,f\n', encoding="utf-8")
    assert [tuple(r) for r in results.tag_labels(spark, str(tmp_path / "tags.csv")).orderBy("tag_id").collect()] == [("1", 'a, "b"', "Character"), ("2", "c", "Rating"), ("3", "d", "General")]


def test_upsert_keeps_what_is_better(spark):
    rows = lambda *x: spark.createDataFrame(x, "path_key string, priority int, score double, percent double, name string, rank long")
    before, new = rows(("a", 2, 5.0, 50.0, "a", 0), ("b", 1, 9.0, 50.0, "b", 1)), rows(("a", 1, 99.0, 99.0, "a", 0), ("b", 1, 8.0, 60.0, "b", 1), ("c", 3, 1.0, 1.0, "c", 2))
    got = lambda **k: [(r["path_key"], r["priority"], r["score"], r["rank"]) for r in fusion.upsert(before, new, 9, **k).orderBy("rank").collect()]
    assert got() == [("c", 3, 1.0, 0), ("a", 2, 5.0, 1), ("b", 1, 8.0, 2)] and [x[0] for x in got(custom_ranking=True)] == ["b", "a", "c"]


def test_what_was_analysed_further_stays(spark):
    kind = "path_key string, priority int, score double, percent double, name string, rank long, was_advanced boolean, was_visual boolean, was_ai boolean"
    rows = lambda *x: spark.createDataFrame([(p, 1, s, s, p, 0, *f) for p, s, *f in x], kind)
    no, yes = False, True
    before = rows(("a", 9.0, yes, no, no), ("b", 1.0, no, yes, no), ("c", 9.0, no, no, no), ("d", 9.0, yes, no, yes), ("e", 9.0, no, None, no))
    new = rows(("a", 99.0, no, yes, yes), ("b", 2.0, no, yes, no), ("c", 1.0, no, no, yes), ("d", 1.0, yes, yes, no), ("e", 1.0, no, no, no))
    got = {r["path_key"]: r["score"] for r in fusion.upsert(before, new, 9).collect()}
    assert got == {"a": 9.0, "b": 2.0, "c": 1.0, "d": 1.0, "e": 9.0}


def test_round_robin_is_fair(spark):
    rows = spark.createDataFrame([(i, f"d{i % 6}" if i < 60 else "hot", i) for i in range(200)], "k int, g string, p int")
    assert len({r["g"] for r in results.round_robin(rows, 7, "g", "p", "k").collect()}) == 7


def test_text_facts_are_unknown_without_a_text(spark):
    a = spark.createDataFrame([("x",), ("y",)], "path_key string")
    b = spark.createDataFrame([("x", "가a1")], "path_key string, text string")
    got = {r["path_key"]: r["profile"] for r in results.text_facts(a, b).collect()}
    assert tuple(got["x"]) == (1, 1, 1, 2) and got["y"] is None


def test_quotas_cut_before_groups_meet(spark):
    rows = spark.createDataFrame([(i, "hot", i) for i in range(50)], "k int, g string, p int")
    plan = results.round_robin(rows, 7, "g", "p", "k")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_model_recovery(spark):
    def model(texts):
        if len(texts) > 1 or len(texts[0]) > 100:
            raise TooLarge
        return [[float(len(texts[0]))]]

    assert with_recovery(model, ["a" * 300, "b"]) == [[88.0], [1.0]]
    df = spark.createDataFrame([("ab",), (None,)], "t string").select(embed_text(F.col("t"), lambda: lambda ts: [[float(len(t))] for t in ts], "query").alias("v"))
    assert [r["v"] for r in df.collect()] == [[9.0], None]


def test_sampled_pages(spark):
    rows = spark.createDataFrame([(1,), (3,), (9,)], "n int").select(sampled_pages(F.col("n")).alias("p")).collect()
    assert [r["p"] for r in rows] == [[0], [0, 1, 2], [0, 4, 8]]


def test_packed_vectors_are_searched_as_arrays_are(spark, monkeypatch):
    monkeypatch.setattr(VO, "AT_ONCE", 7)
    rng = random.Random(4)
    rows = [(f"k{i:03}", [rng.gauss(0, 1) for _ in range(16)]) for i in range(90)]
    rows += [("twin-b", rows[5][1]), ("twin-a", rows[5][1]), ("zero", [0.0] * 16), ("none", None)]
    index = VO.index_rows(spark.createDataFrame([(k, None if v is None else V.unit(v)) for k, v in rows], "path_key string, embedding array<float>")).repartition(3)
    for least, k in ((0.0, 20), (0.3, 240), (-1.0, 3)):
        want = [(r["path_key"], round(r["similarity"], 9), r["rank"]) for r in VO.semantic_search(index.where("embedding IS NOT NULL"), rows[5][1], k, least, 0.05, 2, "path_key").collect()]
        got = [(r["path_key"], round(r["similarity"], 9), r["rank"]) for r in VO.semantic_search(VO.pack(index), rows[5][1], k, least, 0.05, 2, "path_key").collect()]
        assert got == want and got[0][0] == "k005"
    assert VO.semantic_search(VO.pack(index), [1.0, 0.0], 5, key="path_key").count() == 0  # another length
    assert [r["packed"] for r in VO.pack(spark.createDataFrame([([-128, -1, 0, 127],)], "quantized array<tinyint>")).collect()] == [b"\x80\xff\x00\x7f"]


def test_many_roots_are_one_join(spark):
    paths = ["/a/b/x", "/a/bb/x", "/A/c", "/d", "/e/f/g/h", "/a/b", "rel/x"]
    rows = spark.createDataFrame([(p, p.lower()) for p in paths], "full_path string, path_key string")
    got = lambda *roots: sorted(r["full_path"] for r in results.in_any_root(rows, spark.createDataFrame([(r,) for r in roots], "root string")).collect())
    assert got("/A/b", "/a/B/", "/e/f/g", "/e", None) == ["/a/b", "/a/b/x", "/e/f/g/h"] and got("/") == sorted(p for p in paths if p[0] == "/") and got("/zz") == []
    assert got(*(f"/no/{i}" for i in range(3000)), "rel", "/d") == ["/d", "rel/x"]
    assert [r["root"] for r in results.outermost(spark.createDataFrame([("/a",), ("/a/b/c",), ("/ab",)], "root string")).orderBy("root").collect()] == ["/a", "/ab"]


def test_a_text_is_scored_once_and_only_where_a_join_chose_it(spark):
    """Conditions on scores don't become conditions on texts, which would be counted anew for each use, below the join."""
    from lodestone.operators import content
    from lodestone.plans.intent import Term

    docs = spark.createDataFrame([(i, f"the token {'license ' * (i % 3)}") for i in range(20)], "doc_id long, text string")
    terms = tuple(Term(w, (w,), (w,)) for w in ("license", "token", "the"))
    found = content.search(docs.join(spark.range(5).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), terms, 5, known=content.statistics(docs, terms))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "license" in x]
    assert {r["doc_id"] for r in found.collect()} == set(range(5))
