import io
import os
import time
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.operators import counts, maintenance, results
from lodestone.schema import FILE_RECORD, SEMANTIC_VECTOR
from lodestone.sources.documents import decode, extract, extract_text, read_texts
from lodestone.sources.files import TreeReader, current_folder, is_complete, read_binary, scan
from lodestone.sources.index import Index
from lodestone.sources.log import live
from lodestone.streaming.incremental import IndexUpdates, ProgressiveResults, exhaust, read_rows
from lodestone.streaming.state import PROVIDER, ROCKS, attempts


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def workbook():
    ns = 'xmlns="http://x"'
    return zipped(
        xl__workbook_xml=f'<workbook {ns}><sheets><sheet name="계정 목록"/></sheets></workbook>',
        xl__sharedStrings_xml=f"<sst {ns}><si><t>NEPTUNE-FW-8842</t></si><si><t>a</t></si></sst>",
        xl__worksheets__sheet1_xml=f'<worksheet {ns}><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>1</v></c><c><v>42</v></c></worksheet>',
    )


def test_decoding():
    assert decode("é".encode()) == "é" and decode("가".encode("cp949")) == "가" and decode("\ufeffa".encode("utf-16-le")) == "a"
    assert decode(b"a\0b") is None and decode(b"") == ""
    assert decode(("x" * 262_143 + "é").encode()) == "x" * 262_143


def test_extraction():
    assert extract(workbook(), ".xlsx") == ("계정 목록 NEPTUNE-FW-8842 a 42", "Spreadsheet", False, None)
    docx = zipped(word__document_xml="<d><p>Hello</p><p>there</p></d>", other_xml="<d>no</d>")
    assert extract(docx, ".docx")[:2] == ("Hello there", "ArchiveDocument")
    assert extract(b"not a zip", ".docx")[3] and extract(None, ".txt")[3] == "no content"
    assert extract(b"a  b\n" * 9000, ".txt")[2]


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "~hidden").mkdir()
    (tmp_path / "~hidden" / "x.txt").write_text("no")
    (tmp_path / "top.txt").write_text("top")
    (tmp_path / "a" / "b" / "book.XLSX").write_bytes(workbook())
    return tmp_path


def test_scan(spark, tree):
    rows = {r["name"]: r for r in scan(spark, [str(tree)]).collect()}
    assert set(rows) == {"a", "b", "top.txt", "book.XLSX"}
    assert rows["a"]["is_directory"] and rows["a"]["size_bytes"] is None and rows["book.XLSX"]["extension"] == ".xlsx"
    assert {r["name"] for r in scan(spark, [str(tree)], recursive=False).collect()} == {"a", "top.txt"}


def test_read_and_extract(spark, tree):
    got = {r["path_key"].rsplit("/", 1)[1]: r["text"] for r in extract_text(read_binary(spark, str(tree), 48 << 20)).collect()}
    assert "NEPTUNE-FW-8842" in got["book.xlsx"] and got["top.txt"] == "top"


def test_index_versions(spark, tmp_path):
    index = Index(spark, str(tmp_path), "semantic", SEMANTIC_VECTOR)
    row = lambda n: spark.createDataFrame([("p", n, 1, 1, "h", "m", [1, 2])], SEMANTIC_VECTOR)
    assert index.read().count() == 0
    index.write("C:\\x", row(1), 1_000_000_000)
    index.write("C:\\x", row(2), 2_000_000_000)
    assert [r["modified"] for r in index.read(["c:\\X"]).collect()] == [2]
    assert index.read(fresh=2_000_000_000 + 31 * 60_000_000).count() == 0
    assert index.read(["D:\\"]).count() == 0


def test_stream_gives_what_a_batch_gives(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("path_key"), F.length("text").cast("long").alias("size"), "text")
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    schema = "path_key string, size long, n long"
    updates = IndexUpdates(spark, str(tmp_path / "out"), ["size"], lambda d: d.select("path_key", "size", F.size(F.split("text", " ")).cast("long").alias("n")), 0)
    for _ in range(2):  # a second pass finds nothing to do
        stream = read_rows(spark, str(tmp_path / "in"), "path_key string, size long, text string")
        exhaust(stream, updates.sink(schema), str(tmp_path / "check")).awaitTermination()
    got = {(r["path_key"], r["n"]) for r in updates.rows(schema).collect()}
    assert got == {(r["path_key"], len(r["text"].split(" "))) for r in docs.collect()}
    assert results.pending(docs, updates.rows(schema), ["size"]).count() == 0


def test_progressive_results(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i % 30}", i % 3, float(i % 17), 0.0, f"n{i}") for i in range(100)], "path_key string, priority int, score double, percent double, name string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    sink = ProgressiveResults(spark, str(tmp_path / "out"), 20)
    exhaust(read_rows(spark, str(tmp_path / "in"), "path_key string, priority int, score double, percent double, name string"), sink, str(tmp_path / "check")).awaitTermination()
    got = sink.current().collect()
    assert len(got) == 20 and len({r["path_key"] for r in got}) == 20
    again = ProgressiveResults(spark, str(tmp_path / "out"), 20)  # a restart goes on from what is there
    assert again.last == sink.last >= 0 and {r["path_key"] for r in again.current().collect()} == {r["path_key"] for r in got}


def test_failures_wait_a_day_and_indexes_are_compacted(spark, tmp_path):
    schema, calls, hour, clock = "path_key string, size long", [], 3_600_000_000, [0]

    def work(waiting):
        calls.append(sorted(r["path_key"] for r in waiting.collect()))
        return waiting.where("path_key <> 'bad'").select("path_key", "size")

    batch = spark.createDataFrame([("a", 1), ("bad", 1)], schema)
    index = IndexUpdates(spark, str(tmp_path / "i"), ["size"], work, lambda: clock[0], compact_each=2)
    add = index.sink(schema)  # one sink for all: its clock goes on
    for at, rows, number in ((100, batch, 0), (110, batch, 1), (125, batch, 2), (126, spark.createDataFrame([("a", 2), ("bad", 2)], schema), 3)):
        clock[0] = at * hour
        add(rows, number)
    # neither the current nor the failed one, then the failed one, then other versions at once
    assert calls == [["a", "bad"], [], ["bad"], ["a", "bad"]]
    assert [tuple(r) for r in index.rows(schema).collect()] == [("a", 2)]
    assert len(live(index.log.entries())) == 1 and index.attempts().count() == 2 and len(index.log.children("attempts")) < 6


def test_a_repeated_batch_loses_nothing(spark, tmp_path):
    schema, calls = "path_key string, size long", []

    def work(waiting):
        calls.append(waiting.count())
        return waiting

    index = IndexUpdates(spark, str(tmp_path), ["size"], work)
    first, second = (spark.createDataFrame(x, schema) for x in ([("a", 1), ("b", 1)], [("a", 2), ("c", 1), ("c", 1), ("a", 1)]))
    add = index.sink(schema)
    add(first, 0)
    add(second, 1)
    add(second, 1)  # its checkpoint was lost after the commit
    assert sorted(map(tuple, index.rows(schema).collect())) == [("a", 2), ("b", 1), ("c", 1)] and calls == [2, 2, 0]
    part = index.log.new_part("index")  # a writer that died before its commit
    first.withColumn("size", F.lit(99).cast("long")).write.parquet(index.log.path(part))
    add(first, 0)  # a stream that begins anew: an older version comes again as a newer row
    assert sorted(map(tuple, index.rows(schema).collect())) == [("a", 1), ("b", 1), ("c", 1)]


def test_state_of_a_stream(spark, tmp_path):
    schema = "path_key string, version long, text string, seen timestamp"
    day = lambda n: datetime(2024, 1, n)
    batches = [
        [("a", 1, "x", day(1)), ("bad", 1, "fails once", day(1)), ("never", 1, "fails", day(1)), (None, 1, "x", day(1))],
        [("a", 1, "x", day(1)), ("bad", 1, "fails once", day(1)), ("a", 0, "older", day(1))],
        [("b", 1, None, day(2)), ("b", 2, "y", day(2))],
        [("c", 1, "z", day(4)), ("a", 2, "xx", day(4))],
        [("d", 1, "z", day(6))],
        [("e", 1, "z", day(20))],
        [("f", 1, "z", day(21))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i:02}"))
        for f in (tmp_path / "in" / f"{i:02}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i:02}-{f.name}")
            os.utime(tmp_path / "in" / f"{i:02}-{f.name}", (1000 + i, 1000 + i))

    def work(key, version, text):
        if text == "fails" or (text == "fails once" and not os.path.exists(marker)):
            open(marker, "w").close()
            raise ValueError("no")
        return f"{key}-{version}"

    marker, got = str(tmp_path / "failed-once"), str(tmp_path / "got")
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for end in (2, 99):  # a stop in the middle, and another run from the checkpoint
            left = [end]

            def sink(batch, number):
                if left[0] == 0:
                    raise RuntimeError("stopped")
                left[0] -= 1
                batch.write.mode("overwrite").parquet(f"{got}/{number}")

            stream = attempts(read_rows(spark, str(tmp_path / "in"), schema), work, most=2)
            query = stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            except Exception:
                assert end == 2
    finally:
        spark.conf.unset(PROVIDER)
    rows = [r for n in sorted(os.listdir(got)) for r in spark.read.parquet(f"{got}/{n}").collect()]
    made = sorted((r["path_key"], r["version"]) for r in rows if not r["failed"])
    assert made == [("a", 1), ("a", 2), ("b", 2), ("bad", 1), ("c", 1), ("d", 1), ("e", 1), ("f", 1)]
    assert sorted((r["path_key"], r["attempt"]) for r in rows if r["failed"]) == [("bad", 1), ("never", 1), ("never", 2)]
    again = next(r for r in rows if r["path_key"] == "bad" and not r["failed"])
    assert again["attempt"] == 2 and again["at"] - next(r["at"] for r in rows if r["path_key"] == "bad" and r["failed"]) == 24 * 3_600_000


def test_a_reader_opens_only_files_that_may_hold_its_rows(spark, tmp_path):
    index = Index(spark, str(tmp_path), "metadata", FILE_RECORD)
    rows = [(f"f{i}", f"/R/d{i // 100}/f{i:04}", f"/R/d{i // 100}", "", False, 1, i, i) for i in range(1000)]
    index.write("/R", spark.createDataFrame(rows, FILE_RECORD).repartition(5), 1, files=10)
    index.write("/S", spark.createDataFrame([("x", None, None, "", False, 1, 1, None)], FILE_RECORD), 1)
    everything = index.files()
    assert len(everything) >= 9 and index.read().count() == 1001
    assert index.read(below="/r/D3/").count() == 100 and len(index.files(below="/r/d3")) <= 3
    assert index.read(modified=(250, 260)).count() == 10 and len(index.files(["/R"], modified=(250, 260))) <= 2
    assert index.read(below="/r/d3", modified=(None, 305)).count() == 5 and index.read(below="/r/d33").count() == 0


def test_two_writers_leave_whole_versions(spark, tmp_path):
    one, other = (Index(spark, str(tmp_path), "semantic", SEMANTIC_VECTOR, keep=1) for _ in range(2))
    rows = lambda n: spark.createDataFrame([(f"p{i}", n, 1, 1, "h", "m", [1, 2]) for i in range(n)], SEMANTIC_VECTOR)
    put = one.log.put

    def late(number, entry):  # the other writer commits first
        one.log.put = put
        other.write("/r", rows(7), 2)
        return put(number, entry)

    one.log.put = late
    one.write("/r", rows(5), 1)
    assert {r["modified"] for r in one.read().collect()} == {5} and one.read().count() == 5 and one.headers().count() == 1
    assert len(one.log.children("rows")) == len(one.log.children("bounds")) == 1  # old versions are gone


def test_counts_in_passing(spark, tmp_path):
    rows = spark.range(100).withColumn("odd", F.col("id") % 2 == 1)
    shown, seen = counts.top_with_total(rows, [F.desc("id")], 3, odd=F.count_if("odd"))
    assert [r["id"] for r in shown.collect()] == [99, 98, 97] and seen.get == {"total": 100, "odd": 50}
    same, seen = counts.readiness_in_passing(rows, F.col("id") < 60, F.col("id") >= 90)
    same.write.parquet(str(tmp_path / "rows"))
    assert seen.get == {"documents": 100, "current": 60, "stale": 10} and spark.read.parquet(str(tmp_path / "rows")).count() == 100


def test_progress_of_a_stream(spark, tmp_path):
    listener = counts.Progress()
    spark.streams.addListener(listener)
    try:
        for i in range(3):
            spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = counts.watch(read_rows(spark, str(tmp_path / "in"), "id long"), "seen", odd=F.count_if(F.col("id") % 2 == 1))
        query = exhaust(stream, lambda batch, number: batch.count(), str(tmp_path / "at"))
        query.awaitTermination()
        for _ in range(100):
            if listener.of(query.id)["ended"]:
                break
            time.sleep(0.1)
        found = listener.of(query.id)
        assert found["rows"] == 30 and found["batches"] >= 3 and found["observed"]["seen"] == {"rows": 30, "odd": 15}
        assert listener.percent(query.id, 60) == 100 and listener.percent("other", 5) == 0
    finally:
        spark.streams.removeListener(listener)


def test_budgets_quotas_and_progress(spark):
    assert maintenance.budget(False, 4).texts == 0 and maintenance.budget(True, 0).texts == 48 and maintenance.next_delay(True, True) == 20
    assert [maintenance.recognition_quota(n) for n in (10, 1600, 10**6)] == [96, 200, 512]
    assert [maintenance.progress(1, 3), maintenance.progress(1, 9, 40), maintenance.progress(9, 9), maintenance.progress(9, 9, 99, True)] == [33, 40, 99, 100]
    rows = spark.range(10).select(F.concat(F.lit("p"), "id").alias("path_key"))
    now, later = maintenance.split_by_quota(rows, 4)
    assert (now.count(), later.count()) == (4, 6)


def test_preparation_goes_on_until_nothing_is_left(spark):
    docs = spark.createDataFrame([(f"p{i}", "/a", True, i, i) for i in range(10)], "path_key string, directory_path string, has_text boolean, modified long, size long")
    made = []
    index = lambda: spark.createDataFrame(made, "path_key string, size long")
    out = maintenance.prepare(docs, index, lambda d: made.extend((r["path_key"], r["size"]) for r in d.collect()), ["size"], each=4)
    assert out == {"passes": 3, "pending": 0, "documents": 10} and [p for p, _ in made[:4]] == ["p9", "p8", "p7", "p6"]
    assert maintenance.prepare(docs, index, lambda d: None, ["path_key", "size"], each=4)["passes"] == 0


def test_deep_folders_are_several_partitions(spark, tmp_path):
    for i in range(5):
        for j in range(4):
            (tmp_path / "one" / f"a{i}" / f"b{j}").mkdir(parents=True)
            (tmp_path / "one" / f"a{i}" / f"b{j}" / "x.txt").write_text("x")
    (tmp_path / "one" / "back").symlink_to(tmp_path / "one")
    reader = TreeReader({"path": str(tmp_path), "folders": "6"})
    assert sum(p.recursive for p in reader.partitions()) >= 6
    rows = scan(spark, [str(tmp_path / "one" / "a0"), str(tmp_path / "one" / "a1")])
    assert rows.count() == 16 and is_complete(rows, 16) and not is_complete(rows, 15)
    assert {r["name"] for r in current_folder(spark, str(tmp_path / "one" / "a0")).collect()} == {f"b{j}" for j in range(4)}


def test_texts_are_read_where_their_files_are(spark, tree):
    files = scan(spark, [str(tree)])
    chosen = maintenance.content_order(files, 10)
    got = {r["path_key"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in read_texts(chosen).collect()}
    assert got["top.txt"] == ("top", None) and "NEPTUNE-FW-8842" in got["book.xlsx"][0]
    gone = chosen.withColumn("full_path", F.lit("/no/such/file"))
    assert all(r["error"] and r["text"] is None for r in read_texts(gone).collect())
    assert [r["name"] for r in maintenance.content_order(files, 1).collect()] == ["book.XLSX"]


def test_a_snapshot_is_built_once(spark, tmp_path):
    index, built = Index(spark, str(tmp_path), "semantic", SEMANTIC_VECTOR), []

    def build():
        built.append(1)
        return spark.createDataFrame([("p", len(built), 1, 1, "h", "m", [1, 2])], SEMANTIC_VECTOR)

    hour = 3_600_000_000
    get = lambda now: [r["modified"] for r in index.get_or_build("/r", build, now).collect()]
    assert get(hour) == [1] and get(hour + 1) == [1] and get(2 * hour) == [2] and len(built) == 2


def test_model_hooks(spark):
    image = np.zeros((10, 20, 3), np.uint8)
    image[:, 10:] = 255
    whole, middle = models.frames(image)
    assert len(whole) == len(middle) == 3 * 224 * 224 and whole[0] == -1.0 and whole[223] == 1.0 and len(models.frames(image[:, :10])) == 1
    df = spark.createDataFrame([(b"ab",), (b"bad",), (None,)], "x binary")

    def decoder():
        def decode(raw):
            if raw == b"bad":
                raise ValueError
            return np.full((4, 4, 3), 255, np.uint8)

        return decode

    assert [len(r[0]) for r in df.select(models.image_frames(F.col("x"), decoder)).collect()] == [1, 0, 0]
    rows = df.select(models.recognize_pages(F.col("x"), lambda: (len, lambda d, i: f"page {i}"), 9).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in rows] == [("page 0 pa", 2, 2, True), ("page 0 pa", 3, 3, True), (None, 0, 0, False)]
    assert [r[0] for r in df.select(models.recognize_text(F.col("x"), lambda: lambda raw: raw.decode(), most_bytes=2)).collect()] == ["ab", None, None]
    assert models.pages_of(9) == [0, 4, 8]


def test_pieces_of_prompts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    long = "word " * 200
    got = [tuple(r[0]) for r in spark.createDataFrame([("A  Red\nFox",), (long,), (None,)], "t string").select(models.prompt_pieces(F.col("t"), path)).collect()]
    red = [*model.encode("a red fox"), model.eos_id()]
    assert got[0][0][: len(red)] == red and sum(got[0][1]) == len(red) and len(got[0][0]) == 64
    assert got[1][0][-1] == model.eos_id() and sum(got[1][1]) == 64 and sum(got[2][1]) == 1


def test_a_path_costs_two_looks_at_its_state():
    """Each look is a call to the JVM, so a path of a batch takes one to read and one to write."""
    import pandas as pd

    from lodestone.streaming.state import Attempts

    calls, kept = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def get(self):
            calls.append("get")
            return kept.get(self.name)

        def update(self, value):
            calls.append("update")
            kept[self.name] = value

        def clear(self):
            calls.append("clear")
            kept.pop(self.name, None)

    class Handle:
        getValueState = staticmethod(lambda name, schema: State(name))  # noqa: N815
        listTimers = staticmethod(lambda: [])  # noqa: N815

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)  # noqa: N815

    a = Attempts(lambda key, version, text: None if version == 3 else f"{version}{text}", 1, 1)
    a.init(Handle())
    batch = lambda *rows: iter([pd.DataFrame([(*r, pd.Timestamp(1000, unit="s")) for r in rows], columns=["version", "text", "seen"])])
    made = [[tuple(x) for df in a.handleInputRows(("k",), batch(*rows), Times()) for x in df[["version", "payload", "failed", "attempt"]].itertuples(index=False)] for rows in ([(1, "a"), (2, None), (2, "b")], [(2, "c")], [(3, "x")], [(3, "y"), (1, "z")], [(4, None)])]
    assert made == [[(2, "2b", False, 1)], [], [(3, None, True, 1)], [], [(4, "4None", False, 1)]]
    assert len(calls) == 2 + 1 + 2 + 1 + 2
