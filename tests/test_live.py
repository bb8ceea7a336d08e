"""Live scans: the stream of folders, and what a search makes of it."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import metadata
from lodestone.plans.intent import Intent, Term
from lodestone.sources.files import scan
from lodestone.sources.live import FolderReader, LiveSearch, folders, walk

RING = Intent("ring report", (Term("ring", ("ring",), ("ring",)), Term("report", ("report",), ("report",))))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for i in range(7):
        for j in range(3):
            folder = top / f"a{i}" / f"b {j}"
            folder.mkdir(parents=True)
            (folder / f"ring_{i}_{j}.txt").write_text("x" * i)
            (folder / ("report_ring.txt" if (i + j) % 5 == 0 else f"other{j}.png")).write_text("y")
    (top / "~hidden").mkdir()
    (top / "~hidden" / "ring.txt").write_text("no")
    (top / "a1!").mkdir()  # sorts before a1's own folders by path, after them in a walk
    return top


def test_a_walk_goes_on_after_any_folder(tree):
    whole = list(walk([str(tree), str(tree / "a0")]))
    assert len(whole) == len(set(whole)) == 1 + 7 + 21 + 1 + 4
    for n, at in enumerate(whole):
        assert list(walk([str(tree), str(tree / "a0")], at)) == whole[n + 1 :]
    assert list(walk([str(tree / "none")])) == [(0, str(tree / "none"))]


def test_links_back_are_not_followed(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "back").symlink_to(tmp_path)
    assert [f for _, f in walk([str(tmp_path)])] == [str(tmp_path), f"{tmp_path}/a"]


def test_batches_again_are_the_same(tree):
    reader = FolderReader({"path": f"{tree};{tree}/a0", "folders": "4"})
    at, seen = reader.initialOffset(), []
    while not at["end"]:
        rows, end = reader.read(at)
        rows = list(rows)
        assert list(reader.readBetweenOffsets(at, end)) == rows and len(rows) <= 4
        seen += rows
        at = end
    assert [f for (f,) in seen] == [f for _, f in walk([str(tree), f"{tree}/a0"])] and list(reader.read(at)[0]) == []


def wanted(spark, tree, intent, k):
    rows = scan(spark, [str(tree)]).where("NOT is_directory").withColumn("file_id", F.lower("full_path")).dropDuplicates(["file_id"])
    return {(r["file_id"], round(r["score"], 6)) for r in metadata.search(rows, intent, k).collect() }


def test_at_the_end_the_rows_are_those_of_a_scan(spark, tree, tmp_path):
    given = []
    search = LiveSearch(spark, str(tmp_path / "best"), RING, 50, 0, listener=lambda rows: given.append([r["name"] for r in rows]))
    search.run([str(tree)], str(tmp_path / "at"), each=6, batches=1)
    first = {r["path_key"] for r in search.best().collect()}
    assert first and given and max(map(len, given)) <= 24  # hits before the scan has ended
    best = LiveSearch(spark, str(tmp_path / "best"), RING, 50, 0).run([str(tree)], str(tmp_path / "at"), each=12)  # another run goes on
    got = {(r["path_key"], round(r["score"], 6)) for r in best.collect()}
    assert got == wanted(spark, tree, RING, 50) and {p for p, _ in got} > first
    search(folders_again(spark, tree), 0)  # a repeated batch
    assert {(r["path_key"], round(r["score"], 6)) for r in search.best().collect()} == got


def folders_again(spark, tree):
    return spark.createDataFrame([(f,) for _, f in walk([str(tree)])][:6], "folder string")


def test_types_end_the_scan_and_the_visual_lane_gets_more(spark, tree, tmp_path):
    png = Intent("png", (), extensions=frozenset({".png"}))
    search = LiveSearch(spark, str(tmp_path / "types"), png, 3, 0)
    rows = search.run([str(tree)], str(tmp_path / "at"), each=4).collect()
    assert len(rows) == 3 and search.full and len(search.log.entries()) < 7
    visual = LiveSearch(spark, str(tmp_path / "visual"), RING, 5, 0, visual=True)
    assert (visual.capacity, LiveSearch(spark, str(tmp_path / "v"), RING, 500, 0, visual=True).capacity, search.capacity) == (4000, 20000, 3)
    rows = visual.scored(scan(spark, [str(tree / "a1"), str(tree / "a2")], recursive=True)).collect()
    assert {r["extension"] for r in rows if r["visual"]} == {".png"} and {r["extension"] for r in rows if not r["visual"]} >= {".txt"}


def test_the_stream_ends_where_there_is_nothing(spark, tmp_path):
    assert folders(spark, [str(tmp_path)]).isStreaming
    search = LiveSearch(spark, str(tmp_path / "best"), RING, 5, 0)
    assert search.best().count() == 0
