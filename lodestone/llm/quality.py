"""Quality by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

One model is of the target (rows that labels call good), one of the raw text (all rows). A bucket's log ratio compares the
target's count with the count that the raw model expects there, both with SHRINK pseudo-counts, so that rare n-grams decide
little. A document's log weight is the sum over its n-grams, its own n-grams left out of both models: labelled and
unlabelled documents are measured alike. Longer documents' sums are scaled to LENGTH n-grams, so that length alone decides
nothing. Rows are resampled without replacement: log weight plus Gumbel noise, the k largest. k is the number of rows whose
log weight is at least what all but a small share of the target's documents reach, less a slack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, hash_sample, materialize, mix, slices, table, utf8

BUCKETS, GRAM, SHRINK = 1 << 18, 4, 5.0
#: The share of the target's documents below which the threshold lies, and how far below.
SHARE, SLACK = 0.005, 40.0
#: n-grams to which a longer document's log weight is scaled.
LENGTH = 200
#: Target keys that the target's model is fitted on and the threshold is taken from: a bounded sample, the smallest hashes.
SAMPLE = 100_000
BLOCKS, ADDERS = 256, 64
#: Text bytes whose n-grams are counted at once: the arrays for a byte take about 60 more.
AT_ONCE = 2 << 20
_random = np.random.Generator(np.random.PCG64(97))
_PLACE = _random.integers(1, 2**63, (GRAM, 256), dtype=np.uint64)


def grams(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the hashed byte n-grams of each text, sorted; a null or too short text has none."""
    data, offsets = utf8(array)
    n = len(data) - GRAM + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    h = _PLACE[0][data[:n]].copy()
    for i in range(1, GRAM):
        h += _PLACE[i][data[i : n + i]]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[:n] == row[GRAM - 1 :]
    key = (row[:n][whole] * BUCKETS) + (mix(h[whole]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    key.sort()
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    row, bucket = np.divmod(key[starts], BUCKETS)
    return row, bucket, np.diff(np.append(starts, len(key)))


def among(ids: pa.Array, target: np.ndarray) -> np.ndarray:
    """Which ids are in the sorted target."""
    ids = ids.to_numpy()
    return target[np.minimum(np.searchsorted(target, ids), len(target) - 1)] == ids if len(target) else np.zeros(len(ids), bool)


def learn(rows: DataFrame, target: Broadcast) -> np.ndarray:
    """rows: text, id; target: sorted ids. Counts by bucket of the target and of all rows (2 x BUCKETS)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches, "text", AT_ONCE):
            row, bucket, n = grams(batch.column("text"))
            sums[1] += np.bincount(bucket, n, BUCKETS).astype(np.int64)
            good = among(batch.column("id"), target.value)[row]
            sums[0] += np.bincount(bucket[good], n[good], BUCKETS).astype(np.int64)
        yield out({i: sums[:, i * size : (i + 1) * size] for i in range(BLOCKS)} if sums.any() else {})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(v, np.int64).reshape(2, size)
        yield out(sums)

    def out(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"])

    size = BUCKETS // BLOCKS
    counts = np.zeros((2, BUCKETS), np.int64)
    kind = "block int, counts binary"
    for r in rows.select("text", "id").mapInArrow(count, kind).repartition(ADDERS, "block").mapInArrow(add, kind).toLocalIterator():
        counts[:, r["block"] * size : (r["block"] + 1) * size] += np.frombuffer(r["counts"], np.int64).reshape(2, size)
    return counts


def log_weights(array: pa.Array, good: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weight and number of n-grams of each text, without its own share in the models."""
    row, bucket, n = grams(array)
    total = np.bincount(row, n, len(array))
    target, raw = counts[0].sum(), counts[1].sum()
    own = n * good[row]
    share = np.maximum(target - total * good, 0) / np.maximum(raw - total, 1)
    ratio = np.log((counts[0][bucket] - own + SHRINK) / ((counts[1][bucket] - n) * share[row] + SHRINK))
    return np.bincount(row, ratio * n, len(array)) * LENGTH / np.maximum(total, LENGTH), total.astype(np.int64)


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a long column, 16 bits at a time; the driver gets 65536 counts at most each time."""
    prefix, known = 0, 0
    for shift in (48, 32, 16, 0):
        part = rows.where(F.shiftright(column, shift + 16) == prefix) if shift < 48 else rows
        digits = part.groupBy(F.shiftright(column, shift).alias("d")).count().collect()
        for r in sorted(digits, key=lambda r: -r["d"]):
            if known + r["count"] >= k:
                prefix = r["d"]
                break
            known += r["count"]
        else:
            return None
    return prefix


class Sampler:
    """The models fitted on docs and labels, and the least sample key that is selected (None: all are).

    labels: doc_id, quality, toxic; a row is of the target if some label of its key has quality 1 and toxic 0 (of more than
    `sample` such keys, those with the smallest hashes; the raw model is of all rows). k: how many rows to sample; by default
    set from the threshold. Without target rows all are selected.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE, slack: float = SLACK, sample: int = SAMPLE, k: int | None = None, seed: int = 0):
        self.key, self.text, self.seed, context = key, text, seed, docs.sparkSession.sparkContext
        rows = self.rows(docs)
        chosen = labels.where("quality = 1 AND toxic = 0").select(F.xxhash64(F.col("doc_id").cast(docs.schema[key].dataType)).alias("id")).distinct()
        chosen = hash_sample(chosen, "id", sample).toArrow()
        self.target = context.broadcast(np.sort(chosen.column("id").to_numpy()))
        self.counts = context.broadcast(learn(rows, self.target))
        names = ["key", "good", "mark", "n_grams", "log_weight", "sample_key", "order"]
        weigh = self.weigh

        def table_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", AT_ONCE):
                yield pa.RecordBatch.from_arrays([batch.column("key"), *weigh(batch)], names)

        kind = docs.schema[key].dataType.simpleString()
        self.weighed = materialize(rows.mapInArrow(table_of, f"key {kind}, good boolean, mark long, n_grams long, log_weight double, sample_key double, order long"), "weights")
        self.k = k
        if k is None:
            low = hash_sample(self.weighed.where("good"), "mark", sample).select("log_weight").toArrow().column(0).to_numpy()
            self.k = self.weighed.where(F.col("log_weight") >= float(np.quantile(low, share)) - slack).count() if len(low) else None
        self.least = (2**63 - 1 if self.k == 0 else kth_largest(self.weighed, "order", self.k)) if self.k is not None else None

    def rows(self, docs: DataFrame) -> DataFrame:
        rows = docs.select(F.col(self.key).alias("key"), F.col(self.text).cast("string").alias("text"))
        return rows.withColumns({"mark": F.xxhash64("key", "text"), "id": F.xxhash64("key")})

    @property
    def weigh(self) -> Callable[[pa.RecordBatch], list[pa.Array]]:
        target, counts, seed = self.target, self.counts, self.seed

        def weigh(batch: pa.RecordBatch) -> list[pa.Array]:
            """Of a batch of rows(): whether of the target, mark, n-grams, log weight, sample key, and its order as a long."""
            is_good = among(batch.column("id"), target.value)
            weight, n = log_weights(batch.column("text"), is_good, counts.value)
            mark = mix(batch.column("mark").to_numpy().view(np.uint64) + np.uint64(seed))
            sample = weight - np.log(-np.log(((mark >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53))
            bits = sample.view(np.int64)
            order = np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)
            return [pa.array(is_good), pa.array(mark.view(np.int64)), pa.array(n), pa.array(weight), pa.array(sample), pa.array(order)]

        return weigh


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per row of docs: key, n_grams, log_weight, sample_key (log weight plus noise), selected. Options: see Sampler.

    Rows whose sample_key equals the k-th are selected too, so repeated rows stand or fall together. Null and short texts
    weigh 0. Other columns are ignored; an empty table gives no rows.
    """
    fitted = Sampler(docs, labels, key, **options)
    selected = F.lit(True) if fitted.least is None else F.col("order") >= fitted.least
    return fitted.weighed.select(F.col("key").alias(key), "n_grams", "log_weight", "sample_key", selected.alias("selected"))


def sample_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that resample() selects, whole: weighed again where they are read, so that no text is shuffled."""
    fitted = Sampler(docs, labels, key, text, **options)
    if fitted.least is None:
        return docs
    least, weigh, columns = fitted.least, fitted.weigh, docs.columns
    extra = [fresh(columns, x) for x in ("__key", "__text", "__mark", "__id")]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, extra[1], AT_ONCE):
            inner = pa.RecordBatch.from_arrays([batch.column(c) for c in extra], ["key", "text", "mark", "id"])
            yield batch.select(columns).filter(pa.array(weigh(inner)[-1].to_numpy() >= least))

    text_column = F.col(text).cast("string")
    marked = docs.withColumns(dict(zip(extra, (F.col(key), text_column, F.xxhash64(F.col(key), text_column), F.xxhash64(F.col(key))), strict=True)))
    return marked.mapInArrow(keep, docs.schema)


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
