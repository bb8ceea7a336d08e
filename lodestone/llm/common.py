"""What the training-data operators share: the shared folder, written cut points, row keys and byte-level word hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space, tab, LF, VT, FF, CR.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's spark.checkpoint.dir. Only where that is unset, and all run in one process (tests), is a temporary
    folder taken; a cluster without a shared folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch of rows that goes to Python: JVM and worker hold one each.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialize(df: DataFrame, name: str, once: bool = False, batch: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, computes once, survives lost executors.

    once: nothing else uses df, so its shuffle files go as soon as it is written. batch: bytes of a batch that goes to Python."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    wanted = ({CLEANUP: "true"} if once else {}) | ({BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.select("*").write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the cleaner take away shuffle files that nothing refers to any more, such as those behind a written cut point: it
    learns of them by the driver's garbage collection, which may be far off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: The C library's, where it has one (glibc).
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give the system back what a task has freed. Else a Python worker, which goes on to other tasks or idles, keeps the most that it ever had."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores after it until no column has it (whatever its case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(df: DataFrame, hashed: str, k: int) -> DataFrame:
    """The rows with the k smallest values of a column of 64-bit hashes (all, if there are no more), in order.

    A cut that leaves about k rows comes first, so that the task that orders them never sees more than some above k.
    """
    n = df.count()
    if n > k:
        df = df.where(F.col(hashed) <= min(2**63 - 1, int(2**64 * (k + 8 * k**0.5) / n) - 2**63))
    return df.orderBy(hashed).limit(k)


def most_frequent(df: DataFrame, count: str, k: int) -> DataFrame:
    """At most k rows with the largest counts: whole classes of like counts, so that no task has to order rows."""
    kind = F.floor(F.log2(count) * 16).cast("int")
    total, low = 0, None
    for r in sorted(df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["kind"]):  # 1024 classes at most
        total += r["n"]
        if total > k:
            break
        low = r["kind"]
    return df.where(F.lit(False)) if low is None else df.where(kind >= low)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about most_bytes of a column's text and most_rows rows, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column_array = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(column_array).to_numpy(zero_copy_only=False), dtype=np.float64)))
        start = 0
        while start < n:
            base = sizes[start - 1] if start else 0.0
            end = min(start + most_rows, max(start + 1, int(np.searchsorted(sizes, base + most_bytes, side="right"))))
            yield batch.slice(start, end - start)
            start = end


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and row offsets from 0; null is empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BYTE[list(SEPARATORS)] = 0
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes that are hashed at once: the arrays for a byte take about 50 more.
AT_ONCE = 1 << 20


def row_groups(offsets: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Rows from and to, of about most bytes together, one at least."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, end
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, most: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of each row, and each row's first word's place (with the end: rows + 1). most: bytes
    that are hashed at once."""
    words, firsts, n = [np.zeros(0, np.uint64)], [], 0
    for a, b in row_groups(offsets, most):
        if offsets[b] - offsets[a] > 2 * most:  # one long text: in pieces that end before a separator
            firsts.append(np.array([n]))
            at = int(offsets[a])
            while at < offsets[b]:
                end = _cut(data, at + most, int(offsets[b]))
                words.append(_word_hashes(data[at:end], np.array([0, end - at]))[0])
                n += len(words[-1])
                at = end
            continue
        w, first = _word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        words.append(w)
        firsts.append(first[:-1] + n)
        n += len(w)
    return np.concatenate(words), np.concatenate([*firsts, [n]]).astype(np.int64)


def _cut(data: np.ndarray, at: int, end: int) -> int:
    """The first separator's place from at on, or the end."""
    while at < end:
        found = np.flatnonzero(_IS_SEPARATOR[data[at : min(end, at + 65536)]])
        if len(found):
            return at + int(found[0])
        at += 65536
    return end


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < len(data)]
    begins[row_starts] = inside[row_starts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))])
    weight = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    weight ^= weight >> np.uint64(32)
    weight |= np.uint64(1)
    weight *= _BYTE[data]
    words = mix(np.add.reduceat(weight, starts))
    return words, np.searchsorted(starts, offsets)
