"""Vector best-fit packing of token sequences.

A piece of n tokens demands (n tokens, 1 document, n * n attention cost); a sequence has a capacity in each. Pieces are taken
longest first, and each goes where it fits under every constraint and the weighted residual norm after it is smallest, or
(criterion "dot") the weighted dot product of demand and residual is largest. Pieces of equal length are interchangeable, so
the plan is made over the histogram of lengths: at most `capacity` lengths, however many documents. Sequences with equal
contents are one group in the plan, and a chosen sequence takes as many pieces of the length as fit. A piece then finds its
place by its rank among the pieces of its length: its rank within the task that cut it, plus how many the tasks before have.
No step sorts or gathers the pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, slices, table
from .tokens import byte_bpe

CAPACITY = 2048
#: The id put after each document.
END = 0
_RANK_BITS = 50


@dataclass
class Plan:
    """Runs of ranks: the pieces of one length from a rank on, `each` of them to a sequence, from `sequence` on at `offset`."""

    key: np.ndarray  # length << _RANK_BITS | first rank, sorted
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << _RANK_BITS) | rank
        i = np.searchsorted(self.key, key, side="right") - 1
        within = key - self.key[i]
        return self.sequence[i] + within // self.each[i], self.offset[i] + within % self.each[i] * length


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY, documents: int | None = None, cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), criterion: str = "norm") -> Plan:
    """histogram: pieces by length. documents, cost: a sequence's other capacities (else as many as its tokens allow)."""
    if criterion not in ("norm", "dot"):
        raise ValueError(f"no criterion {criterion!r}")
    limits = np.array([capacity, documents or capacity, cost or capacity * capacity], dtype=np.int64)
    scale = np.asarray(weights, dtype=np.float64)
    residual, count, first = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs: list[tuple[int, int, int, int]] = []
    sequences, lengths = 0, sorted((n for n, c in histogram.items() if c), reverse=True)
    if lengths and (lengths[0] > capacity or lengths[0] ** 2 > limits[2] or lengths[-1] < 1):
        raise ValueError("a piece must have a token at least and fit into an empty sequence")
    for length in lengths:
        demand, left, rank = np.array([length, 1, length * length], dtype=np.int64), int(histogram[length]), 0
        while left:
            fits = np.flatnonzero((residual >= demand).all(axis=1))
            if len(fits):
                part = residual[fits]
                score = np.sum(scale * ((part - demand) / limits) ** 2, axis=1) if criterion == "norm" else -np.sum(scale * (demand / limits) * (part / limits), axis=1)
                g = int(fits[np.argmin(score)])
            else:
                each = int((limits // demand).min())
                residual, count, first = np.vstack([residual, limits]), np.append(count, -(-left // each)), np.append(first, sequences)
                sequences += int(count[-1])
                g = len(count) - 1
            each = int((residual[g] // demand).min())
            full, odd = min(left // each, int(count[g])), 0
            if full:
                runs.append((length << _RANK_BITS | rank, each, int(first[g]), int(capacity - residual[g, 0])))
            if full < count[g]:
                odd = left - full * each
                if odd:
                    runs.append((length << _RANK_BITS | (rank + full * each), odd, int(first[g]) + full, int(capacity - residual[g, 0])))
            rest = int(count[g]) - full - bool(odd)
            groups = [(residual[g] - demand * each, full, first[g]), (residual[g] - demand * odd, int(bool(odd)), first[g] + full), (residual[g], rest, first[g] + full + bool(odd))]
            groups = [x for x in groups if x[1] and x[0][0] >= lengths[-1] and x[0][1] >= 1 and x[0][2] >= lengths[-1] ** 2]
            keep = np.arange(len(count)) != g
            residual = np.vstack([residual[keep], *(x[0][None] for x in groups)])
            count, first = np.append(count[keep], [x[1] for x in groups]).astype(np.int64), np.append(first[keep], [x[2] for x in groups]).astype(np.int64)
            rank += full * each + odd
            left -= full * each + odd
    runs.sort()
    key, each, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*runs, strict=True)) if runs else [np.zeros(0, np.int64)] * 4
    return Plan(key, each, sequence, offset, sequences)


def cut_pieces(docs: DataFrame, path: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) to a row a piece: doc_id, piece, start, length, ids_crc32, the task that made it and its rank there."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task = byte_bpe(path), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            rows, out, ids_out = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(bpe.ids(text or ""), np.uint32(END)).astype("<u4")
                end, piece, start = (len(ids) - 1) % capacity + 1, 0, 0
                while start < len(ids):
                    part = ids[start:end]
                    rows.append(i)
                    out.append((piece, start, len(part), zlib.crc32(part.tobytes()), ranks[len(part)]))
                    if with_ids:
                        ids_out.append(part)
                    ranks[len(part)] += 1
                    piece, start, end = piece + 1, end, end + capacity
            columns = list(zip(*out, strict=True)) or [[]] * 5
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)] + [pa.array([task] * len(rows), pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.uint32())).cast(pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long, task long" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, documents: int | None = None, cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), criterion: str = "norm", with_ids: bool = False) -> DataFrame:
    """Per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (with_ids: and ids).

    A null or empty text is the end id alone. Texts of more than capacity tokens are cut; the first piece takes the
    remainder. Repeated rows are packed each. A null doc_id is kept. Other columns are ignored; an empty table gives no rows.
    """
    pieces = materialize(cut_pieces(docs.select("doc_id", F.col("text").cast("string").alias("text")), path or public_tokenizers.path("byte_bpe_50k.json"), capacity, with_ids), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = docs.sparkSession.sparkContext.broadcast(best_fit(histogram, capacity, documents, cost, weights, criterion))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.value.place(b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("base").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = ", ".join(f"{n} {pieces.schema[n].dataType.simpleString()}" for n in names)
    return pieces.join(base, ["task", "length"]).mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
