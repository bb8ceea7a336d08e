"""GIF, WARC and vectors: round trips and brute force."""

import gzip
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import gif, multi_index, warc
from lodestone.llm.common import new_path


@pytest.mark.parametrize("n", [1, 2, 253, 254, 255, 256, 508, 5000])
@pytest.mark.parametrize("values", [2, 256])
def test_lzw_round_trip(n, values):
    data = np.random.default_rng(n).integers(0, values, n).astype(np.uint8)
    for stream in (gif.lzw_literal(data), gif.lzw_compress(data.tobytes())):
        assert gif.lzw_decode(stream, 8, n).tobytes() == gif._by_code(stream, 8, n).tobytes() == data.tobytes()


def test_a_full_table_is_cleared():
    data = np.random.default_rng(1).integers(0, 256, 30_000).astype(np.uint8)
    assert gif.lzw_decode(gif.lzw_compress(data.tobytes()), 8, len(data)).tobytes() == data.tobytes()


def test_frames_and_histograms():
    data = bytes(range(256)) * 2
    m = gif.decode_gif(gif.encode_gif(data, width=16, most_rows=20, delay_ms=70), with_rgba=True)
    assert m.error is None and [(f.width, f.height, f.delay_ms) for f in m.frames] == [(16, 20, 70), (16, 12, 70)]
    assert b"".join(f.samples.tobytes() for f in m.frames) == data
    assert [int(f.histogram.sum()) for f in m.frames] == [320, 192]  # the canvas is cleared between them
    assert tuple(m.frames[0].rgba[0, 5]) == (5, 5, 5, 255)


@pytest.mark.parametrize(("disposal", "second"), [(1, 9), (2, 0), (3, 0)])
def test_transparency_and_disposal(disposal, second):
    """The second frame shows through where it is transparent: what the first left, nothing, or what was before."""
    first = gif.encode_gif(bytes([9]) * 16, width=4, disposal=disposal)
    nine, clear = bytes([9]) * 16, bytes([7]) * 16
    one = first[: first.rindex(b"\x3b")]
    frame = gif.encode_gif(clear, width=4, disposal=1, transparent=7)
    m = gif.decode_gif(one + frame[frame.index(b"\x21\xf9") :], with_rgba=True)
    assert m.frames[0].samples.tobytes() == nine and int(m.frames[1].rgba[0, 0, 0]) == second and (m.frames[1].rgba[0, 0, 3] == 255) == (second == 9)


def test_broken_media():
    whole = gif.encode_gif(bytes(64 * 4))
    assert gif.decode_gif(None).error == gif.decode_gif(b"JFIF").error == "not a GIF"
    for cut in (5, 12, 400, 800, len(whole) - 30):
        assert gif.decode_gif(whole[:cut]).error


def test_gif_of_odd_documents(odd_docs, no_docs):
    rows = gif.decode_media(gif.encode_texts(odd_docs)).select("doc_id", "error", F.expr("transform(frames, f -> f.samples)").alias("s")).collect()
    want = sorted((str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd_docs.collect())
    texts = {r["doc_id"]: len((r["text"] or "").encode()) for r in odd_docs.collect()}
    assert sorted((str(r["doc_id"]), hashlib.sha256(b"".join(r["s"])[: texts[r["doc_id"]]]).hexdigest()) for r in rows) == want
    assert all(r["error"] is None for r in rows) and gif.encode_texts(no_docs).count() == 0


def test_op6(spark, sf_dir):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = gif.op6_gif_media(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]]
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = gif.encode_gif(payload, palette=gif.INK, delay_ms=None, disposal=gif.DISPOSALS, transparent=gif.BLANK)
        shown = gif.decode_gif(media)
        histogram = np.sum([f.histogram for f in shown.frames], axis=0)
        feature = f"{len(shown.frames)}x64x{shown.height};{sum(f.delay_ms for f in shown.frames)}ms;" + ",".join(f"{i}:{n}" for i, n in enumerate(histogram) if n)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), feature)
    assert sum(r["media_bytes"] for r in rows) < sum(r["n_bytes"] for r in rows)


def test_frames_coded_together_are_those_coded_alone():
    rng = np.random.default_rng(3)
    frames = [rng.integers(0, k, n).astype(np.uint8) for n in (1, 2, 64, 640, 4096, 9000) for k in (1, 2, 30, 256) for _ in range(10)]
    streams = gif.lzw_compress_all(frames)
    assert streams == [gif.lzw_compress(f.tobytes()) for f in frames]
    for f, stream, decoded in zip(frames, streams, gif.lzw_decode_all(streams, 8, [len(f) for f in frames]), strict=True):
        assert decoded.tobytes() == gif._by_code(stream, 8, len(f)).tobytes() == f.tobytes()


@pytest.mark.parametrize("depth", [2, 5, 8])
def test_streams_of_small_palettes(depth):
    data = np.random.default_rng(depth).integers(0, 2**depth, 20_000).astype(np.uint8)
    stream = gif.lzw_compress(data.tobytes(), depth)
    assert gif.lzw_decode(stream, depth, len(data)).tobytes() == data.tobytes() and gif.lzw_decode(stream, depth, 777).tobytes() == data[:777].tobytes()


def test_a_stream_goes_on_with_a_full_table():
    """No clear code when the table is full: all later codes have 12 bits and make no entries."""
    data = np.random.default_rng(2).integers(0, 8, 40_000).astype(np.uint8).tobytes()
    codes, known, now = [256], {bytes([i]): i for i in range(256)}, b""
    for b in data:
        if (longer := now + bytes([b])) in known:
            now = longer
        else:
            codes.append(known[now])
            if len(known) + 2 < 4096:
                known[longer] = len(known) + 2
            now = bytes([b])
    codes += [known[now], 257]
    stream = gif._pack(np.array(codes), np.array([0, len(codes)]), 8)[0]
    assert len(codes) > 8000 and gif.lzw_decode(stream, 8, len(data)).tobytes() == data == gif._by_code(stream, 8, len(data)).tobytes()


def test_a_code_without_an_entry_ends_its_own_stream_only():
    good = gif.lzw_compress(b"abcabcabc")
    bad = gif._pack(np.array([256, 97, 98, 300, 97, 257]), np.array([0, 6]), 8)[0]
    assert [x.tobytes() for x in gif.lzw_decode_all([good, bad, good], 8, [9, 9, 9])] == [b"abcabcabc", b"ab", b"abcabcabc"]
    broken = gif.encode_gif(bytes(64 * 3), compress=False).replace(gif.lzw_literal(np.zeros(192, np.uint8)), bad.ljust(len(gif.lzw_literal(np.zeros(192, np.uint8))), b"\0"))
    assert gif.decode_gif(broken).error and not gif.decode_gif(broken).frames


def test_huge_canvases_are_errors():
    head = gif.encode_gif(bytes(64))
    assert "pixels" in gif.decode_gif(head[:6] + b"\xff\xff\xff\xff" + head[10:]).error


def test_texts_use_the_dictionary_palette_transparency_and_disposal(spark):
    prose = " ".join(f"the {w} of a day in spring" for w in ("light", "rain", "song", "end", "heat")) + "\n"
    text = prose * 70
    raw = text.encode()
    payload = raw + bytes(-len(raw) % 64)
    row = gif.encode_texts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    m = gif.decode_gif(bytes(row["media"]), with_rgba=True)
    assert len(row["media"]) < len(raw) // 2 and m.error is None
    assert [f.disposal for f in m.frames] == [1, 2, 3] and {f.transparent for f in m.frames} == {32}
    assert [f.delay_ms for f in m.frames] == [f.height * 20 for f in m.frames] and b"".join(f.samples.tobytes() for f in m.frames) == payload
    ink = np.frombuffer(gif.INK, np.uint8).reshape(256, 3)
    canvas = np.zeros((64, 64, 4), int)  # brute force: pixel by pixel
    for f in m.frames:
        before = canvas.copy()
        for y in range(f.height):
            for x in range(64):
                if (v := int(f.samples[y, x])) != 32:
                    canvas[y, x] = [*ink[v], 255]
        assert np.array_equal(f.rgba, canvas)
        want = np.zeros(64, int)
        for r, g, b, a in canvas.reshape(-1, 4):
            if a:
                want[(r >> 6) * 16 + (g >> 6) * 4 + (b >> 6)] += 1
        assert list(f.histogram) == list(want)
        if f.disposal == 2:
            canvas[: f.height] = 0
        elif f.disposal == 3:
            canvas = before


PAGES = [(1, "http://a/1", "x"), (2, None, "x"), (3, "http://a/3", None), (4, "http://b/\r\nX: y", ""), (5, "u", "é" * 5000), (None, "n", "x"), (7, "u", "only"), (7, "u", "only")]


def test_warc_round_trip(spark):
    path = new_path(spark, "warc-test")
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload int")
    warc.archive_pages(pages, path)
    got = sorted(map(str, map(tuple, warc.read_pages(spark, path).collect())))
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = max(p for p, _, h in PAGES if (h or "") == (html or "") and p is not None)
        want.append(str((i, len(raw), warc.digest(raw), "response" if i == first else "revisit", None if i == first else first)))
    assert got == sorted(want)


def test_small_payloads_are_not_revisited(spark):
    path = new_path(spark, "warc-test")
    warc.archive_pages(spark.createDataFrame([(1, "a", "xx"), (2, "a", "xx"), (3, "a", "long text"), (4, "a", "long text")], "page_id long, url string, html string"), path, least_bytes=5)
    assert {r["page_id"]: r["record_type"] for r in warc.read_pages(spark, path).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_warc_is_gzip_and_filters_reach_the_reader(spark):
    path = new_path(spark, "warc-test")
    warc.archive_pages(spark.createDataFrame(PAGES[:5], "page_id long, url string, html string"), path)
    import glob

    raw = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file://") + "/*.gz"))
    assert raw.count(b"WARC/1.1\r\n") == 5
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("target_uri",), ("http://a/1", "u")), GreaterThan(("offset",), 3)]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1
    rows = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'response'")
    assert rows.count() == 3 and rows.where("payload IS NOT NULL").count() == 0


def test_archives_of_others_without_lengths(tmp_path):
    record = lambda i: warc.record(f"urn:{i}", "response", "u", b"pay" * i, "D", None, "1970-01-01T00:00:00Z")
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in range(4)))
    (tmp_path / "y.warc").write_bytes(b"".join(record(i) for i in range(4)))
    reader = warc.WarcReader({"path": str(tmp_path)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["payload"] for r in rows] == [b"pay" * i for i in range(4)] * 2
    (tmp_path / "z.warc.gz").write_bytes(gzip.compress(record(1))[:-12])
    with pytest.raises(ValueError, match="cut off"):
        list(b for p in reader.partitions() for b in reader.read(p))


def test_archives_of_one_stream_and_broken_records(tmp_path):
    record = lambda i: warc.record(f"urn:{i}", "response", "u", b"pay" * i, "D", None, "1970-01-01T00:00:00Z")
    read = lambda: [r["payload"] for p in warc.WarcReader({"path": str(tmp_path)}).partitions() for b in warc.WarcReader({"path": str(tmp_path)}).read(p) for r in b.to_pylist()]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(record(i) for i in (1, 50_000, 0, 3))) + gzip.compress(record(2)))
    assert read() == [b"pay" * i for i in (1, 50_000, 0, 3, 2)]
    reader = warc.WarcReader({"path": str(tmp_path), "record_id": "urn:3,urn:2"})
    assert [r["record_id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == ["urn:3", "urn:2"]
    for name, raw in (("b.warc.gz", gzip.compress(b"no headers here")), ("b.warc", b"no headers here")):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(ValueError, match="without headers"):
            read()
        (tmp_path / name).unlink()


def test_lengths_over_32_bits():
    head = b"\x1f\x8b\x08\x04" + bytes(6) + (20).to_bytes(2, "little") + b"sl" + (16).to_bytes(2, "little") + (5 << 32).to_bytes(8, "little") + bytes(8)
    assert warc._skip_length(head) == 5 << 32 and warc._skip_length(warc.member(b"abc")) == len(warc.member(b"abc"))


def test_appending_keeps_and_overwriting_replaces(spark):
    warc.register(spark)
    path = new_path(spark, "warc-test")
    rows = lambda *ids: spark.createDataFrame([(f"urn:page:{i}", "response", bytearray(b"x%d" % i)) for i in ids], "record_id string, record_type string, payload binary")
    have = lambda: sorted(r["record_id"][-1] for r in spark.read.format("warc").load(path).collect())
    rows(1, 2).write.format("warc").mode("append").save(path)
    rows(3).write.format("warc").mode("append").save(path)
    assert have() == ["1", "2", "3"]
    rows(4).write.format("warc").mode("overwrite").save(path)
    assert have() == ["4"]


def test_a_large_group_of_equal_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "GROUP", 7)
    path = new_path(spark, "warc-test")
    warc.archive_pages(spark.range(100).selectExpr("id AS page_id", "concat('u', id) AS url", "if(id % 10 < 8, 'same', concat('own', id)) AS html"), path)
    for r in warc.read_pages(spark, path).collect():
        same = r["page_id"] % 10 < 8
        assert (r["record_type"], r["refers_to"]) == (("revisit", 97) if same and r["page_id"] != 97 else ("response", None))


def test_empty_pages(spark):
    path = new_path(spark, "warc-test")
    warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_pages(spark, path).count() == 0


def exact(rows, queries, k):
    out = {}
    for i, q in queries:
        scored = sorted(((-float((np.array(q) * np.array(v)).sum()), j) for j, v in rows if j != i))[:k]
        out[i] = [(j, -s) for s, j in scored]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_all_cells_are_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    bad = [(400, None), (401, [0.0] * 6), (402, [float("nan")] * 6), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (404, [float("inf")] * 6), (405, [1.0]), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, first int").repartition(3)
    queries = df.where("vec_id % 20 = 0 OR vec_id IN (401, 402)")
    got = found(multi_index.search(df, queries, 20, probe=1.0))
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert {i: [j for j, _ in x] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for i in want for a, b in zip(got[i], want[i]))


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert {i: len(x) for i, x in found(multi_index.search(df, df.where("vec_id % 20 = 0"), 20)).items()} == {0: 2, 20: 2}
    assert multi_index.search(df.where("vec_id < 0"), df, 5).count() == 0


def test_recall_where_cells_are_left_out(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(multi_index.search(df, df.where("vec_id % 100 = 0"), 20, centroids=16, probe=0.4, least=100))
    scores = x[::100] @ x.T
    hits = 0
    for n, row in enumerate(scores):
        row[n * 100] = -9
        hits += len({j for j, _ in got[n * 100]} & set(np.argsort(-row)[:20].tolist()))
    assert len(got) == 40 and hits >= 0.7 * 800


def test_walk_takes_pairs_in_order():
    rng = np.random.default_rng(7)
    a, b = rng.random(6), rng.random(5)
    reach = multi_index.walk(a, b, np.ones((6, 5), np.int64), 11)
    cells = multi_index.in_reach([a[None], b[None]], np.array([reach]))[0]
    assert set(zip(*map(list, np.nonzero(cells)), strict=True)) == {divmod(int(x), 5) for x in np.argsort((a[:, None] + b[None]).ravel())[:11]}


def recall(spark, x, every=20):
    """Of the production parameters, by brute force; and the share of rows that a query has looked at can't be all."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = found(multi_index.search(df, df.where(f"vec_id % {every} = 0")))
    scores, hits = x[::every] @ x.T, 0
    for n, row in enumerate(scores):
        row[n * every] = -np.inf
        hits += len({j for j, _ in got[n * every]} & set(np.argsort(-row)[:20].tolist()))
    assert len(got) == len(scores)
    return hits / 20 / len(scores)


@pytest.mark.parametrize("lengths", [0.0, 0.5])
def test_recall_at_the_defaults(spark, lengths):
    """12,000 random vectors, the hardest case: of one length, and of log-normal ones."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(12_000, 64))
    x *= np.exp(rng.normal(size=(12_000, 1)) * lengths) / np.linalg.norm(x, axis=1)[:, None]
    assert 0.9 <= recall(spark, x, 60) < 1


def test_malformed_vectors_do_not_decide_the_size(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(200)] + [(1000 + i, [1.0] * (4 + i)) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert set(found(multi_index.search(df, df))) == set(range(200))


def test_a_hot_cell_is_dealt_into_blocks(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(700)] + [(1000 + i, rng.normal(size=4).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(multi_index.search(df, df.where("vec_id IN (0, 60, 1020)"), probe=1.0, block=64))
    want = exact(rows, [r for r in rows if r[0] in (0, 60, 1020)], 20)
    assert {i: [j for j, _ in x] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}


def test_op9(spark, sf_dir):
    rows = multi_index.op9_multi_index(spark, sf_dir)
    data = [(r["vec_id"], [float(v) for v in r["embedding"]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = exact(data, [r for r in data if r[0] % 20 == 0], 20)
    got = found(rows)
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
