import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import common


def test_hash_sample(spark):
    df = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    want = sorted(r["h"] for r in df.collect())
    assert [r["h"] for r in common.hash_sample(df, "h", 100).collect()] == want[:100]
    for k in (4600, 4999, 5000):  # the cut is above all hashes
        assert [r["h"] for r in common.hash_sample(df, "h", k).collect()] == want[:k]
    assert common.hash_sample(df, "h", 9000).count() == 5000 and common.hash_sample(df.where("id < 0"), "h", 5).count() == 0


def test_most_frequent(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [4] * 5 + [1000] * 3)], "w long, n long")
    count = lambda k: common.most_frequent(df, "n", k).count()
    assert (count(100), count(57), count(8), count(7), count(3), count(2)) == (58, 8, 8, 3, 3, 0)


def test_slices_hold_every_row_once():
    texts = ["", None, "a" * 50, "b", "c" * 500, "d"] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    for most, rows in ((1, 100), (60, 4), (1 << 20, 7)):
        parts = list(common.slices([batch, batch.slice(0, 0)], "t", most, rows))
        assert [x for p in parts for x in p.column(0).to_pylist()] == texts and max(p.num_rows for p in parts) <= rows


def test_words_hash_alike_wherever_they_are(monkeypatch):
    texts = ["The cat  sat", "sat\tthe\ncat", "", "  ", "THE", "cat" * 400 + " the"]
    data, offsets = common.utf8(pa.array(texts))
    words, first = common.word_hashes(data, offsets)
    assert list(np.diff(first)) == [3, 3, 0, 0, 1, 2]
    assert list(words[:3]) == [words[4], words[5], words[3]] and words[6] == words[0] == words[8]
    monkeypatch.setattr(common, "AT_ONCE", 5)
    again = [np.concatenate([common._word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0] for a, b in common.row_groups(offsets, 5)])]
    assert np.array_equal(again[0], words)


def test_what_a_task_has_freed_goes_back_to_the_system():
    rss = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1])
    held = [np.ones(8000) for _ in range(2000)]  # 128 MB in pieces that the C library keeps
    pins, full = held[::100], rss()
    del held
    common.trim()
    assert len(pins) == 20 and rss() < full - 100_000


def test_batches_of_a_materialized_step_are_bounded(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    kept = common.materialize(rows.mapInArrow(sizes, "n long"), "sizes", batch=1 << 20)
    assert kept.agg(F.max("n")).first()[0] < 250 and kept.agg(F.sum("n")).first()[0] == 2000
    assert spark.conf.get(common.BATCH, None) != str(1 << 20)
