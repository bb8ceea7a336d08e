from datetime import datetime

import json
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions.phonetic import aliases, phonetic_similarity, romanize, skeleton
from lodestone.operators import sounds
from lodestone.plans import fixed, model_plan, visual
from lodestone.plans.intent import classify, compile_intent, explicit_extensions, needs_targeted_scan, script_clauses, date_range, detect_categories, directives, floors, half_life, lanes, normalize_token, references_previous, script_predicates, sort_mode, tokenize

NOW = datetime(2024, 7, 17, 15, 30)


def test_terms_types_and_dates():
    i = compile_intent("지난달 계정 목록 엑셀 파일 최신순", NOW)
    assert [t.original for t in i.terms] == ["계정", "목록"]
    assert [t.original for t in i.literal_terms] == ["엑셀"] and i.categories == {"Spreadsheet"}
    assert (i.modified_from, i.modified_to) == (datetime(2024, 6, 1), datetime(2024, 7, 1))
    assert i.directives[0].feature == "ModifiedRecency" and i.directives[0].primary and i.directives[0].weight == 0.65
    assert "account" in i.terms[0].texts and "ppk" in i.terms[0].names and "ppk" not in i.terms[0].texts


@pytest.mark.parametrize(("phrase", "start", "end"), [("오늘", (7, 17), (7, 18)), ("어제", (7, 16), (7, 17)), ("이번 주", (7, 15), (7, 22)), ("지난주", (7, 8), (7, 15)), ("이번달", (7, 1), (8, 1))])
def test_dates(phrase, start, end):
    assert date_range(f"{phrase} 파일", NOW) == (datetime(2024, *start), datetime(2024, *end))


def test_years_and_no_date():
    assert date_range("작년 보고서", NOW) == (datetime(2023, 1, 1), datetime(2024, 1, 1))
    assert date_range("보고서", NOW) == (None, None)


def test_endings_keep_words():
    assert normalize_token("네트워크에서") == "네트워크" and normalize_token("키를") == "키" and normalize_token("이") == "이"
    assert tokenize("AWS 키를 .PPK") == ["aws", "키", "ppk"]


def test_floors():
    assert floors("지하 3층 B13F 2층") == ((True, 3), (True, 13), (False, 2))
    assert floors("지하 0층 B1000") == ()


def test_categories():
    assert detect_categories("문서", ["문서"]) == {"Document", "Spreadsheet", "Presentation"}
    assert detect_categories("3d", ["3d"]) == {"ThreeDimensionalModel", "CadDrawing"}
    assert fixed.CATEGORIES[".ppt"] == "Presentation"


def test_explicit_and_unknown_extensions():
    assert ".stl" in compile_intent("*.stl 찾아줘", NOW).extensions
    assert "artifact42" in [t.original for t in compile_intent("artifact42", NOW).terms]


def test_directives():
    d = directives("큰 파일 우선 60%")
    assert d[0].feature == "FileSize" and d[0].higher_first and d[0].weight == 0.6
    assert directives("보고서") == () and half_life("최근 2주") == 14.0 and half_life("") == 90.0
    assert sort_mode(compile_intent("보고서", NOW)) == "Relevance"


def test_scripts():
    found, rest = script_predicates("파일명이 한글만 된 파일")
    assert found == (("Hangul", "Name", "Only"),) and "한글" not in rest


def test_classes_and_lanes():
    assert classify(compile_intent("고양이 사진", NOW)) == "Visual"
    assert classify(compile_intent("'aws key'", NOW)) == "ExactName"
    assert classify(compile_intent("계약 관련 자료", NOW)) == "TopicRelated"
    assert lanes(compile_intent("wifi", NOW)).precision_first and not lanes(compile_intent("wifi 오류", NOW)).precision_first
    assert references_previous("그 중 엑셀만") and references_previous("방금 찾은 것") and not references_previous("엑셀")


def fragments(word, length):
    yield word
    if len(word) > length + 2:
        for n in range(max(4, length - 2), min(len(word) - 1, length + 2) + 1):
            for i in range(len(word) - n + 1):
                yield word[i : i + n]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def likeness(text, term):
    """Brute force over words, readings and fragments."""
    best = 0.0
    for word in {w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) >= 4}:
        for reading in aliases(term):
            for part in fragments(word, len(reading)):
                longest = max(len(part), len(reading))
                if abs(len(part) - len(reading)) > max(3, longest // 2):
                    continue
                best = max(best, 1 - edit(part, reading) / longest)
                a, b = skeleton(part), skeleton(reading)
                if min(len(a), len(b)) >= 3:
                    best = max(best, 1 - edit(a, b) / max(len(a), len(b)))
    return best


def test_phonetics(spark):
    assert romanize("위젯") == "wijet" and aliases("abc") == []
    assert aliases("위젯") == ["wijet", "wizet"] and aliases("네트워크") == ["neteuwokeu", "netuwoku"] and aliases("빌드")[-1] == "vildu"
    assert romanize("값없다") == "gapeopda" and romanize("핥") == "hal"
    texts = ["my network drive", "zebra", "", None, "networking12 ab", "wizard widgets", "the WIDGET of a widgetmaker", "xyz netwrk"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for term in ("네트워크", "위젯", "abc"):
        got = {r["i"]: r["x"] for r in df.select("i", phonetic_similarity(F.col("t"), term).alias("x")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == pytest.approx(likeness(t or "", term)), (term, t)
    assert likeness("my network drive", "네트워크") >= 0.76 > likeness("zebra", "네트워크")


def test_the_index_of_pairs_finds_all_that_sound_alike(spark):
    import random

    rng = random.Random(9)
    names = ["network drive", "netwrk", "neteuwok", "wizard widgets", "wijett", "buildx server", "vildu", "bild", None, "", "xnetworkingx12", "server", "sever_log", "seobeo"]
    for _ in range(400):
        word = rng.choice(["network", "widget", "build", "server", "seobeo", "wijet"])
        names.append("".join(rng.choice("aeiounrstwkdgb") if rng.random() < 0.15 else c for c in word) + rng.choice(["", "s", "ing", " x"]))
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    words, terms = sounds.words_of(df, "i"), ["네트워크", "위젯", "빌드", "서버", "abc"]
    pairs = sounds.pairs_of(words)
    got = {(r["term"], r["i"]): r["likeness"] for r in sounds.sound_alike(words, pairs, terms, "i").collect()}
    want = {(t, r["i"]): r["x"] for t in terms for r in df.select("i", phonetic_similarity(F.col("name"), t).alias("x")).where("x >= 0.76").collect()}
    assert got == want and len({t for t, _ in got}) == 4
    assert sounds.sound_alike(words, pairs, [], "i").count() == 0
    with pytest.raises(ValueError):
        sounds.sound_alike(words, pairs, ["위젯"], "i", least=0.4)


def test_floors_without_an_ending():
    assert floors("plan B3, b-13 and B2F") == ((True, 3), (True, 13), (True, 2)) and floors("ab3 b3x 1234층") == ()


def test_extensions_as_they_are_written():
    assert explicit_extensions("*.c++ .7z_old x.y .tar.gz") == {".c++", ".7z_old"}
    assert compile_intent("한글 문서 찾아줘", NOW).extensions == {".hwp", ".hwpx"}


def test_script_clauses():
    assert script_clauses("한글로 작성된 문서").predicates == (("Hangul", "Content", "Predominantly"),)
    assert script_clauses("숫자가 없는 파일명").predicates == (("Digit", "Name", "Excludes"),)
    found = script_clauses("영문만 포함된 파일")
    assert found.predicates == (("Latin", "Name", "Only"),) and found.files_only and not found.hwp


def test_sorts_and_wishes():
    assert sort_mode(compile_intent("보고서 최신순", NOW)) == "ModifiedNewest" and sort_mode(compile_intent("오래된 순 생성일", NOW)) == "CreatedOldest"
    assert compile_intent("최신순", NOW).has_criteria and compile_intent("폴더를 찾아줘", NOW).folders_only
    assert not lanes(compile_intent("키", NOW)).precision_first and lanes(compile_intent("강아지", NOW)).visual and lanes(compile_intent("*.png", NOW)).visual
    i = compile_intent("aws key", NOW)
    assert needs_targeted_scan(i, 0, 0, 10) and needs_targeted_scan(i, 5, 0, 10) and not needs_targeted_scan(i, 5, 1, 10)
    assert needs_targeted_scan(compile_intent("*.stl", NOW), 3, 0, 10)


def test_image_profiles_and_prompts():
    named = compile_intent("사오토메 란마 이미지", NOW)
    p = visual.profile(named)
    assert (p.kind, p.named, p.least, p.margin, p.lift) == ("Character", True, 0.075, 0.015, 0.02)
    assert "saotome" in visual.identity_aliases(named) and "ranma" in visual.identity_aliases(named)
    dog = compile_intent("강아지 사진", NOW)
    assert visual.profile(dog) == visual.Profile("General", False, 0.055, 0.1) and "dog" in visual.tag_aliases(dog)
    assert visual.prompts(dog.query, visual.profile(dog))[1].startswith("강아지 사진, dog photo, ")
    assert visual.profile(compile_intent("프로그램 화면 스크린샷", NOW)).kind == "UserInterface"
    assert visual.tag_terms("saotome_ranma (girl)") == ["saotomeranmagirl", "saotome", "ranma", "girl"]


def test_plans_of_a_model():
    i = compile_intent("그 중 계약 보고서", NOW)
    own = model_plan.from_intent(i, 3)
    assert own.use_previous and own.target == "Any" and [t for t, _ in own.terms] == [t.original for t in i.terms]
    raw = {"termGroups": [{"term": " a\n b ", "alternatives": ["x", "X", "", 3]}, {"term": ""}, 7], "requestedExtensions": [".PDF", ".pdf"], "target": "FILE", "sort": "large_first", "confidence": 3, "interpretation": "q" * 500, "usePreviousResults": True}
    p = model_plan.parse(json.dumps(raw), i.query, own, 3)
    assert p.terms == (("a b", ("x",)),) and p.extensions == (".PDF",) and (p.target, p.sort, p.confidence, len(p.summary)) == ("File", "LargeFirst", 1.0, 200)
    weak = model_plan.parse('{"confidence": 0.3, "target": "folder"}', i.query, own)
    assert (weak.target, weak.confidence, weak.by_model) == ("Any", 0.3, True) and model_plan.parse("null", "", own) is own
    run = model_plan.interpret(i, lambda q: json.dumps(raw), 3)
    assert run.extensions == () and run.target == "Any" and run.by_model and not run.use_previous  # a model never widens a search
    assert model_plan.interpret(i, lambda q: "no json", 3) == own and model_plan.sanitize("a\r\n  b", 3) == "a b"
