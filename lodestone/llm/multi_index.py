"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors have a codebook each, fitted on a bounded sample. Every vector has a cell: the pair of its
halves' nearest centroids. A query walks the pairs by summed distance with a heap (the multi-sequence order) until the cells
it has seen hold enough rows, and all rows of those cells are reranked by the exact inner product. Nearness is the inner
product, so the distance of a half is how far below zero the centroid's inner product lies, less SPREAD deviations of what
its rows add to that: long vectors, whose cells are wide, aren't passed over.
Cells are dealt into blocks of rows, hot ones into several; queries go in blocks too, each with the distance of the last cell
it has walked to, and meet every block that holds a cell of theirs. A pair of blocks is one matrix product, whose unwanted
entries are masked. Rows are shuffled once; a task keeps the best k of each query. The k-th best score among the sample's
rows in a query's cells is a floor: rows below it can't be among the query's k best.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import hash_sample, materialize, mix, table

#: Centroids of a half (64 at most: a mask is a long), rows the codebooks are fitted on, rounds of fitting.
CENTROIDS, SAMPLE, ROUNDS = 64, 10_000, 12
#: A query looks at cells that hold this share of all rows (near-random vectors need it this high), and at least so many rows
#: for each neighbour wanted. Deviations of a cell's rows that count for it.
PROBE, LEAST, SPREAD = 0.5, 4, 2.0
#: Rows of a block at most, blocks that even a small table has, and queries of a query block.
BLOCK, BLOCKS, QUERIES = 32_768, 16, 256
#: Candidates that a task holds.
HELD = 500_000
RESULT = "query_id long, rank int, vec_id long, score double"


def fit(sample: np.ndarray, centroids: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced distinct rows."""
    distinct = np.unique(sample, axis=0)
    k = min(centroids, len(distinct))
    c = distinct[np.linspace(0, len(distinct) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        a = nearest(sample, c)
        n = np.bincount(a, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, a, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)


def spreads(sample: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each centroid, the deviation of its rows from it in one direction, drawn towards that of all rows."""
    a = nearest(sample, c)
    r = ((sample - c[a]) ** 2).sum(axis=1)
    return np.sqrt((np.bincount(a, r, len(c)) + r.mean()) / (np.bincount(a, minlength=len(c)) + 1) / c.shape[1])


def distances(q: np.ndarray, c: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Of queries' halves to centroids: small where large inner products are to be expected."""
    return -(q @ c.T) - SPREAD * np.linalg.norm(q, axis=1)[:, None] * spread[None]


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> float:
    """The summed distance of the last pair to look at: pairs in order of it until their cells hold enough rows."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db, size = first[a].tolist(), second[b].tolist(), counts[np.ix_(a, b)].tolist()
    n, m = len(da), len(db)
    taken = [0] * n  # how many of a row's pairs have been taken: pairs of a row come in order
    seen, last = 0, -np.inf
    heap = [(da[0] + db[0], 0, 0)]
    while heap and seen < enough:
        last, i, j = heapq.heappop(heap)
        seen += size[i][j]
        taken[i] = j + 1
        if j + 1 < m and (i == 0 or taken[i - 1] > j + 1):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if i + 1 < n and taken[i + 1] == j:
            heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
    return last


def in_reach(d: list[np.ndarray], reach: np.ndarray) -> np.ndarray:
    """queries x firsts x seconds: the cells that each query looks at."""
    return d[0][:, :, None] + d[1][:, None, :] <= (reach + 1e-9 * (1 + np.abs(reach)))[:, None, None]


def best_in_block(q: np.ndarray, q_ids: np.ndarray, cells: np.ndarray, x: np.ndarray, x_ids: np.ndarray, cell: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows of the block, ties by id; scores are summed in one fixed order.
    cells: queries x cells, those looked at; cell: each row's."""
    out = []
    step = max(1, HELD // len(x))
    for s in range(0, len(q), step):
        part, ids = q[s : s + step], q_ids[s : s + step]
        scores = part @ x.T
        wanted = cells[s : s + step][:, cell] & (scores >= floors[s : s + step, None]) & (ids[:, None] != x_ids[None])
        scores[~wanted] = -np.inf
        least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(part), -np.inf)
        i, j = np.nonzero(wanted & (scores >= (least - 1e-9 * (1 + np.abs(least)))[:, None])) if np.isfinite(least).any() else np.nonzero(wanted)
        for t in range(0, len(i), HELD):
            exact = (part[i[t : t + HELD]] * x[j[t : t + HELD]]).sum(axis=1)
            out.append((ids[i[t : t + HELD]], x_ids[j[t : t + HELD]], exact))
    return best(*map(np.concatenate, zip(*out, strict=True)), k) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def floor(q: np.ndarray, q_ids: np.ndarray, cells: np.ndarray, x: np.ndarray, x_ids: np.ndarray, cell: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k best rows reach: the k-th best of some rows that it looks at."""
    scores = q @ x.T
    scores[~cells[:, cell] | (q_ids[:, None] == x_ids[None])] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(q), -np.inf)
    least = np.partition(scores, -k, axis=1)[:, -k]
    return np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return q[rank < k], ids[rank < k], score[rank < k]


def vectors(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that take part, and their vectors: whole, finite, not zero, of the given size."""
    column = column.cast(pa.list_(pa.float64()))
    size = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.float64), nan=-1)
    keep = np.flatnonzero(size == dimensions)
    x = np.asarray(column.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(keep), dimensions)
    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
    return keep[good], x[good]


def search(rows: DataFrame, queries: DataFrame, k: int = 20, centroids: int = CENTROIDS, probe: float = PROBE, least: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """rows, queries: vec_id long, embedding. Per query its k nearest rows found: query_id, rank (from 1), vec_id, score.

    Nearness is the inner product in double precision, ties go to the smaller vec_id; rows with the query's own vec_id aren't
    candidates. Null, zero, non-finite or incomplete vectors, null ids, and vectors of another size than the most common
    (among like counts, the largest) take no part. Repeated rows are candidates each. Other columns are ignored. Empty tables
    give an empty result. least: rows that a query looks at at least (default LEAST for each neighbour).
    """
    spark = rows.sparkSession
    short = isinstance(rows.schema["embedding"].dataType.elementType, FloatType) and rows.schema["embedding"].dataType == queries.schema["embedding"].dataType
    kind, stored_as = ("array<float>", np.float32) if short else ("array<double>", np.float64)
    rows, queries = (x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL") for x in (rows, queries))
    common = rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    dimensions = common["size"]
    fit_for = rows.where((F.size("embedding") == dimensions) & F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0))
    some = hash_sample(fit_for.withColumn("mark", F.xxhash64("vec_id")), "mark", sample).toArrow()
    if not some.num_rows:
        return spark.createDataFrame([], RESULT)
    chosen = vectors(some.column("embedding").combine_chunks(), dimensions)[1]
    half = max(1, dimensions // 2)
    halves = (slice(0, half), slice(half, dimensions)) if dimensions > 1 else (slice(0, 1), slice(0, 1))
    books = [fit(chosen[:, h], min(centroids, 64)) for h in halves]
    books = spark.sparkContext.broadcast([(c, spreads(chosen[:, h], c)) for h, c in zip(halves, books, strict=True)])
    shape = tuple(len(c) for c, _ in books.value)

    def cell_of(x: np.ndarray) -> np.ndarray:
        i, j = (nearest(x[:, h], c) for h, (c, _) in zip(halves, books.value, strict=True))
        return i * shape[1] + j

    def far(q: np.ndarray) -> list[np.ndarray]:
        return [distances(q[:, h], c, spread) for h, (c, spread) in zip(halves, books.value, strict=True)]

    anchors = spark.sparkContext.broadcast((chosen, some.column("vec_id").to_numpy(), cell_of(chosen)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = vectors(batch.column("embedding"), dimensions)
            raw, size = x.astype(stored_as).tobytes(), dimensions * stored_as().itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * size).astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep)), packed, pa.array(cell_of(x) if len(x) else keep, pa.int32())], ["vec_id", "vector", "cell"])

    index = materialize(rows.mapInArrow(assign, "vec_id long, vector binary, cell int"), "multi-index")
    counts = np.zeros(shape[0] * shape[1], np.int64)
    for r in index.groupBy("cell").count().toLocalIterator():  # 4096 rows at most
        counts[r["cell"]] = r["count"]
    total = int(counts.sum())
    enough = max(LEAST * k if least is None else least, math.ceil(probe * total))
    size = max(1, min(block, -(-total // BLOCKS)))
    base, salts, blocks, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for c, n in enumerate(counts.tolist()):  # cells of a first centroid lie together; a hot cell has blocks of its own
        if n >= size or held + n > size:
            blocks, held = blocks + (held > 0), 0
        base[c], salts[c] = blocks, max(1, -(-n // size))
        held += n
        if n >= size:
            blocks, held = blocks + int(salts[c]), 0
    owned = [np.flatnonzero((counts > 0) & (base <= b) & (b < base + salts)) for b in range(blocks + (held > 0))]
    layout = spark.sparkContext.broadcast((base, salts, owned))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a batch that go to one block, packed."""
        base, salts, _ = layout.value
        for batch in batches:
            ids, cell = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
            to = base[cell] + (mix(ids.astype(np.uint64)) % salts[cell].astype(np.uint64)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                if len(part):
                    raw = b"".join(batch.column("vector").take(pa.array(part)).to_pylist())
                    yield message(int(to[part[0]]), 0, ids[part], raw, cell[part].astype(np.int16).tobytes(), b"")

    def message(to: int, asks: int, ids: np.ndarray, raw: bytes, cells: bytes, floors: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([asks], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), raw, cells, floors))], names)

    names, sent = ["block", "asks", "ids", "vectors", "cells", "floors"], "block int, asks int, ids binary, vectors binary, cells binary, floors binary"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_cell = counts.reshape(shape)
        for batch in batches:
            keep, x = vectors(batch.column("embedding"), dimensions)
            ids = batch.column("vec_id").take(pa.array(keep)).to_numpy()
            for s in range(0, len(x), QUERIES):
                part, mine = x[s : s + QUERIES], ids[s : s + QUERIES]
                d = far(part)
                reach = np.array([walk(a, b, by_cell, enough) for a, b in zip(*d, strict=True)])
                cells = in_reach(d, reach).reshape(len(part), -1)
                floors = floor(part, mine, cells, *anchors.value, k)
                for b, own in enumerate(layout.value[2]):
                    if len(used := np.flatnonzero(cells[:, own].any(axis=1))):
                        yield message(b, 1, mine[used], part[used].astype(stored_as).tobytes(), reach[used].tobytes(), floors[used].tobytes())

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block: its vectors, then the queries that want some of them."""
        read = lambda raw: np.frombuffer(raw, stored_as).reshape(-1, dimensions).astype(np.float64)
        now, parts, whole, found, n = None, [], None, [], 0
        out = lambda x: pa.RecordBatch.from_arrays(list(map(pa.array, x)), ["query_id", "vec_id", "score"])
        cut = lambda: best(*map(np.concatenate, zip(*found, strict=True)), k)
        for batch in batches:
            for to, asks, ids, raw, cells, floors in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if to != now:
                    now, parts, whole = to, [], None
                ids = np.frombuffer(ids, np.int64)
                if not asks:
                    parts.append((read(raw), ids, np.frombuffer(cells, np.int16)))
                    continue
                if parts:
                    whole, parts = [np.concatenate(x) for x in zip(*parts, strict=True)], []
                q = read(raw)
                found.append(best_in_block(q, ids, in_reach(far(q), np.frombuffer(cells)).reshape(len(q), -1), *whole, k, np.frombuffer(floors)))
                n += len(found[-1][0])
                if n > HELD:
                    found = [cut()]
                    if (n := len(found[0][0])) > HELD // 2:
                        yield out(found.pop())
                        n = 0
        if found:
            yield out(cut())

    met = index.mapInArrow(deal, sent).union(queries.mapInArrow(route, sent)).repartition("block").sortWithinPartitions("block", "asks")
    found = met.mapInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0"))
