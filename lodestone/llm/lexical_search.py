"""Ranked lexical search by sort-based accumulation, for a set of queries over all documents.

1. One pass over the texts: every document's number of terms, and which terms of the queries it holds how often, written in
   blocks of documents; numbers of documents, terms and documents holding a term are summed from the same rows.
2. Each block: of the queries' terms the postings (document, impact) in the block are concatenated query by query, as packed
   keys of query and document; a radix sort by 16 bits at a time brings equal keys together, and reduceat sums their impacts.
   Of each query the best k of a block are selected with a heap.
3. The blocks' best are written and dealt out by ranges of query and document: a range's best k of a query go on, sorted, to
   the query's own task, which passes the first k and holds one batch.
Queries go in groups whose texts have at most QUERY_BYTES: what is broadcast never exceeds that; more queries are more groups.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

#: Bytes of texts of one group of queries.
QUERY_BYTES = 16 << 20
#: Text bytes and documents of a block.
BLOCK_BYTES, BLOCK = 8 << 20, 8192
#: Postings that are accumulated at once.
AT_ONCE = 1 << 21
#: Bytes of a long text that are split at once.
PIECE = 4 << 20
#: A-Z as a-z, other signs of ASCII but digits and letters as a space.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, a few megabytes at a time."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
    start = 0
    while start < len(raw):
        end = len(raw)
        if end - start > PIECE and (end := raw.find(b" ", start + PIECE)) < 0:
            end = len(raw)
        yield raw[start:end].split()
        start = end


def radix_argsort(keys: np.ndarray) -> np.ndarray:
    """A stable order of unsigned keys, 16 bits at a time from the lowest."""
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in range(16, int(keys.max(initial=0)).bit_length(), 16):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)[order]
        order = order[np.argsort(digit, kind="stable")]
    return order


def accumulate(keys: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their impacts."""
    if not len(keys):
        return keys, impacts
    order = radix_argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(impacts[order], starts)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id), ties to smaller ids. Rows under the k-th score go first, so that the heap sees few."""
    if len(scores) > 4 * k:
        keep = scores >= np.partition(scores, -k)[-k]
        ids, scores = ids[keep], scores[keep]
    return [(-s, i) for s, i in heapq.nsmallest(k, zip((-scores).tolist(), ids.tolist(), strict=True))]


class Queries:
    """One group of queries: their ids, each one's terms (once each), and the group's vocabulary."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids, self.vocabulary, self.terms = [i for i, _ in rows], {}, []
        for _, text in rows:
            own = dict.fromkeys(w for part in terms_of(text or "") for w in part)
            self.terms.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own], np.int64))


def blocks_of(docs: DataFrame, queries) -> DataFrame:
    """docs: doc_id, text. A row a block: its documents' ids and numbers of terms (of those with any), and, sorted by term, the
    vocabulary's terms in it with document and count, all packed; beside it the block's own df of each term."""
    names = ["docs", "lengths", "terms", "places", "counts", "n_docs", "n_terms"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = queries.value.vocabulary
        v = max(1, len(known))
        for batch in slices(batches, "text", BLOCK_BYTES, BLOCK):
            ids, lengths, found = batch.column("doc_id").to_numpy(), np.zeros(batch.num_rows, np.int64), []
            for i, text in enumerate(batch.column("text")):
                own = np.zeros(0, np.int64)
                for words in terms_of(text.as_py() or ""):
                    lengths[i] += len(words)
                    hits = np.fromiter((x for x in map(known.get, words) if x is not None), np.int64)
                    own = np.append(own, hits)
                term, n = np.unique(own, return_counts=True)
                found.append((term, np.full(len(term), i, np.int64), n))
            term, place, n = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True))
            order = radix_argsort(term.astype(np.uint64))
            packed = [x.tobytes() for x in (ids, lengths, term[order].astype(np.int32), place[order].astype(np.int32), n[order])]
            full = int((lengths > 0).sum())
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in packed), pa.array([full], pa.int64()), pa.array([int(lengths.sum())], pa.int64())], names)

    return docs.mapInArrow(read, "docs binary, lengths binary, terms binary, places binary, counts binary, n_docs long, n_terms long")


def document_frequencies(blocks: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary: each task sums its blocks, terms are added up by a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                sums += np.bincount(np.frombuffer(raw, np.int32), minlength=size)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["term", "n"])

    out = np.zeros(size, np.int64)
    got = blocks.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # the vocabulary at most
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out


def rank_group(docs: DataFrame, rows: list[tuple[int, str | None]], k: int) -> DataFrame:
    """query_id, rank, doc_id, score of one group's queries."""
    spark = docs.sparkSession
    own = Queries(rows)
    queries = spark.sparkContext.broadcast(own)
    blocks = materialize(blocks_of(docs, queries), "postings")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = document_frequencies(blocks, len(own.vocabulary))
    weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_by_query, w = queries.value.terms, weights.value
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("docs", "lengths", "terms", "places", "counts")), strict=True):
                ids, lengths, term, place, tf = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int64, np.int32, np.int32, np.int64), strict=True))
                m = 50 + 50 * lengths * n_docs // max(1, n_terms)
                impact = w[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[place])) if len(term) else np.zeros(0, np.int64)
                edges = np.searchsorted(term, np.arange(len(w) + 1))
                many = np.diff(edges)
                made: list[tuple[int, int, int]] = []
                start = 0
                while start < len(terms_by_query):
                    end, held = start, 0
                    while end < len(terms_by_query) and (end == start or held < AT_ONCE):
                        held += int(many[terms_by_query[end]].sum())
                        end += 1
                    q = np.repeat(np.arange(end - start), [len(x) for x in terms_by_query[start:end]])
                    t = np.concatenate(terms_by_query[start:end]).astype(np.int64)
                    n = many[t]
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(edges[:-1][t], n)
                    keys, sums = accumulate((np.repeat(q, n) * len(ids) + place[at]).astype(np.uint64), impact[at])
                    keys, sums = keys[sums > 0].astype(np.int64), sums[sums > 0]
                    bounds = np.searchsorted(keys, np.arange(end - start + 1) * len(ids))
                    for j in range(end - start):
                        a, b = bounds[j], bounds[j + 1]
                        made += [(start + j, s, i) for s, i in best(ids[keys[a:b] - j * len(ids)], sums[a:b], k)]
                    start = end
                q, s, i = np.array(made, np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([pa.array(q.copy()), pa.array(s.copy()), pa.array(i.copy())], ["q", "score", "doc_id"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by query, then score and doc_id: each query's first k pass. Held: one batch."""
        now, n = None, 0
        for batch in batches:
            q = batch.column("q").to_numpy()
            if not len(q):
                continue
            starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
            if q[0] == now:
                first = starts[1] if len(starts) > 1 else len(q)
                rank[:first] += n
            now, n = q[-1], int(rank[-1]) + 1
            kept = pa.array(np.flatnonzero(rank < k))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(kept) for c in ("q", "score", "doc_id")), pa.array((rank + 1)[rank < k].astype(np.int32))], ["q", "score", "doc_id", "rank"])

    kind = "q long, score long, doc_id long"
    found = materialize(blocks.drop("n_docs", "n_terms").mapInArrow(score, kind), "block-best")
    order = ["q", F.desc("score"), "doc_id"]
    near = found.repartitionByRange("q", "doc_id").sortWithinPartitions(*order).mapInArrow(select, f"{kind}, rank int").drop("rank")
    last = near.repartition("q").sortWithinPartitions(*order).mapInArrow(select, f"{kind}, rank int")
    names = spark.createDataFrame(pa.table({"q": pa.array(range(len(own.ids)), pa.int64()), "query_id": pa.array(own.ids, pa.int64())}))
    return last.join(names, "q").select("query_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 50, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), doc_id, score: of each query (query_id, text) its k best documents (doc_id, text), scores above 0.

    Equal scores by ascending doc_id. Null texts, and those without a term, are no documents and count nowhere; a query
    without terms, or whose terms no document holds, has no rows. Rows of one doc_id are documents of their own; rows without
    a doc_id take no part, nor do queries without a query_id; of several queries with one id each is ranked. Empty tables give
    no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text")).where("query_id IS NOT NULL")
    size = queries.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64), F.lit(0))).first()[0]
    groups = max(1, math.ceil(size / query_bytes))
    out = None
    for g in range(groups):
        part = queries if groups == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        found = rank_group(docs, [(r["query_id"], r["text"]) for r in part.collect()], k)
        out = found if out is None else out.union(found)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return rank_documents(table(spark, sf_dir, "documents"), items).withColumnRenamed("query_id", "item_id")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE doc_id IS NOT NULL),
lens AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
s AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lens),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
w AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, s),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * n * big_n) // big_l) AS m FROM lens, s),
scored AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored JOIN lens USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50"""
