"""Phrase collocation mining: phrases of two to four words that occur more often together than their parts let expect.

1. Texts are cut into pieces; equal pieces of a language become one row with a multiplicity.
2. N-grams are counted level by level, one word to four. Each task turns its pieces into weighted n-grams, adds up equal ones
   and deals them by hash; a task of a bucket counts its n-grams in duckdb, which spills to Spark's own scratch folder beyond
   its memory, and keeps those with LEAST occurrences. An n-gram can only be one of them if both its shorter halves are: a
   bit map of fixed size of the level before (no false negatives) leaves out nearly all others before they are shuffled.
3. Candidates ask for the counts of their parts: a request for each part and bucket of candidates, never one for each
   candidate, meets the counts in a shuffled join, and the answers go back to the bucket that asked.
4. The longest count around each candidate comes by a grouped maximum; what is left is ranked in two steps.
Phrases are counted and compared as they are written; hashes only place rows and bits.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections import Counter, defaultdict
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, mix, slices, table

#: Occurrences of a candidate, words of the longest, and the share (in 100) of its occurrences that a longer one takes away.
LEAST, WORDS, INSIDE = 30, 4, 80
#: Phrases of a language that are reported, and the scale of a score.
MOST, SCALE = 2000, 2_000_000
#: Bits of the map of frequent n-grams: 8 MB are broadcast, whatever the corpus. Bytes of its blocks.
BITS, BLOCK = 1 << 26, 2048
#: Bytes of pieces that are turned into n-grams at once, memory of a bucket's duckdb, buckets of candidates, salts of a language.
AT_ONCE, MEMORY, BUCKETS, SALTS = 4 << 20, "192MB", 256, 64
#: A-Z as a-z, every end of a piece as a line feed, a tab as a space.
_PIECE_BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_random = np.random.Generator(np.random.PCG64(1212))
_PLACE = _random.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHT = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # by place in a word; later places begin anew


def pieces_of(text: str) -> list[bytes]:
    """The pieces with a word, lower-cased, words joined by one space."""
    raw = text.encode("utf-8", "surrogatepass").translate(_PIECE_BYTES)
    raw = re.sub(rb" *\n[ \n]*", b"\n", re.sub(rb"  +", b" ", raw))
    return raw.strip(b" \n").split(b"\n") if raw.strip(b" \n") else []


def distinct_pieces(docs: DataFrame) -> DataFrame:
    """(lang, text) to lang, piece, m (how often), n_words; each piece of a language once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                seen[lang].update(pieces_of(text.as_py() or ""))
            langs = [x for lang, c in seen.items() for x in [lang] * len(c)]
            pieces = pa.array([p for c in seen.values() for p in c], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pieces, pa.array([m for c in seen.values() for m in c.values()], pa.int64())], ["lang", "piece", "m"])

    rows = docs.mapInArrow(read, "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))
    return rows.withColumn("n_words", (F.octet_length("piece") - F.octet_length(F.replace("piece", F.lit(" "), F.lit(""))) + 1).cast("long"))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; data has one byte after each word."""
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    weight = _WEIGHT[place & 255] * (data.astype(np.uint64) + np.uint64(1))
    weight[np.append(starts[1:] - 1, len(data) - 1)] = 0  # the space or end after a word
    return mix(np.add.reduceat(weight, starts) + lengths.astype(np.uint64))


def grams(langs: pa.Array, pieces: pa.Array, n: int, marks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Data, and of each n-gram whose both (n-1)-grams are marked: its piece, start, end in data and hash."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces.cast(pa.string()))
    data = np.frombuffer(pc.binary_join(whole, "\n")[0].as_buffer().to_pybytes() + b"\n", np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))  # every word has one sign after it
    starts = np.append(0, ends[:-1] + 1)
    last = data[ends] == 10
    owner = np.append(0, np.cumsum(last)[:-1])
    coded = langs.dictionary_encode()
    salt = np.array([int.from_bytes(x.encode()[:64].ljust(8, b"\0"), "little") % (1 << 64) for x in coded.dictionary.to_pylist()], np.uint64)
    h = word_hashes(data, starts, ends - starts) ^ mix(salt)[coded.indices.to_numpy()[owner]]

    def of(width: int) -> tuple[np.ndarray, np.ndarray]:
        """Begins of whole runs of width words, and a hash for each begin."""
        m = len(h) - width + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        mixed = sum((h[i : i + m] * _PLACE[i] for i in range(width)), np.zeros(m, np.uint64))
        return np.flatnonzero(owner[:m] == owner[width - 1 :]), mix(mixed + np.uint64(width))

    at, hashes = of(n)
    if marks is not None and len(at):
        shorter, own = of(n - 1)
        known = np.zeros(len(h) + 1, bool)
        known[shorter] = marked(marks, own[shorter])
        at = at[known[at] & known[at + 1]]
    return data, owner[at], starts[at], ends[at + n - 1], hashes[at]


def marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(BITS - 1)
    return (marks[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The parts of data from starts to ends."""
    n = ends - starts
    offsets = np.append(0, np.cumsum(n)).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], n)
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def gathered(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches put together until they have about most_bytes of a column's text: more equal rows meet."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, column, most_bytes, 1 << 20):
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def weighted(pieces: DataFrame, n: int, marks: Broadcast | None) -> DataFrame:
    """lang, phrase, f: n-grams of the pieces (with their multiplicities), equal ones of a chunk added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "piece", AT_ONCE):
            data, owner, starts, ends, _ = grams(batch.column("lang"), batch.column("piece"), n, None if marks is None else marks.value)
            coded = batch.column("lang").dictionary_encode()
            for a in range(0, len(starts), 1 << 20):
                part = slice(a, a + (1 << 20))
                who = pa.array(owner[part])
                rows = pa.table({"lang": coded.indices.take(who), "phrase": strings(data, starts[part], ends[part]), "f": batch.column("m").take(who)})
                out = rows.group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"})
                langs = coded.dictionary.take(out.column("lang").combine_chunks())
                yield from pa.table({"lang": langs, "phrase": out.column("phrase").cast(pa.string()), "f": out.column("f")}).combine_chunks().to_batches()

    return pieces.where(F.col("n_words") >= n).select("lang", "piece", "m").mapInArrow(count, "lang string, phrase string, f long")


def counted(rows: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f of at least `least` occurrences: a bucket of phrases a task, counted out of core in duckdb."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        scratch = tempfile.mkdtemp(prefix="phrases-", dir=(os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")[0])  # where Spark itself spills
        base = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": scratch, "preserve_insertion_order": False})
        try:
            given = pa.RecordBatchReader.from_batches(first.schema, _and(first, batches))
            base.register("given", given)
            found = base.sql(f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM given GROUP BY lang, phrase HAVING sum(f) >= {int(least)}")
            for batch in found.to_arrow_reader(1 << 16):
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string()), batch.column(2)], ["lang", "phrase", "f"])
        finally:
            base.close()
            shutil.rmtree(scratch, ignore_errors=True)

    return rows.repartition("lang", "phrase").mapInArrow(count, "lang string, phrase string, f long")


def _and(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def bit_map(counts: DataFrame, n: int) -> np.ndarray:
    """The bits of counted n-grams: blocks of the map, or-ed by a shuffle, are all that the driver gets."""

    def out(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], ["block", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in slices(batches, "phrase", AT_ONCE, 1 << 20):
            _, _, _, _, hashes = grams(batch.column("lang"), batch.column("phrase"), n, None)
            bit = np.unique(hashes & np.uint64(BITS - 1)).astype(np.int64)
            block = bit // (8 * BLOCK)
            for b, part in zip(np.unique(block).tolist(), np.split(bit, np.flatnonzero(np.diff(block)) + 1), strict=True):
                np.bitwise_or.at(blocks.setdefault(b, np.zeros(BLOCK, np.uint8)), part // 8 % BLOCK, (1 << (part % 8)).astype(np.uint8))
        yield out(blocks)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks[b] = blocks.get(b, np.zeros(BLOCK, np.uint8)) | np.frombuffer(raw, np.uint8)
        yield out(blocks)

    kind = "block int, bits binary"
    marks = np.zeros(BITS // 8, np.uint8)
    for r in counts.select("lang", "phrase").mapInArrow(mark, kind).repartition("block").mapInArrow(join, kind).toLocalIterator():
        marks[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["bits"], np.uint8)
    return marks


def part_counts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, f, l, r, score of each candidate's lowest-scoring cut."""
    words = F.split("phrase", " ")
    bucketed = candidates.withColumns({"bucket": F.pmod(F.xxhash64("lang", "phrase"), F.lit(BUCKETS)), "words": words, "k": F.explode(F.sequence(F.lit(1), F.size(words) - 1))})
    cuts = bucketed.select("bucket", "lang", "phrase", "f", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"))
    asked = cuts.select("bucket", "lang", F.explode(F.array("first", "rest")).alias("part")).distinct()
    answers = materialize(asked.join(counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("n")), ["lang", "part"]), "answers")
    told = lambda c, n: answers.select("bucket", "lang", F.col("part").alias(c), F.col("n").alias(n))
    rows = cuts.join(told("first", "l"), ["bucket", "lang", "first"]).join(told("rest", "r"), ["bucket", "lang", "rest"])
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(8,0)) * CAST(f AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    return rows.withColumn("score", score).groupBy("lang", "phrase", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "f", "c.l", "c.r", "c.score")


def longest_around(longer: DataFrame) -> DataFrame:
    """lang, phrase, around: the largest count of a longer counted phrase (of three words or more) that holds phrase."""
    words, n = F.col("w"), F.size("w")
    inner = [F.array_join(F.slice("w", i, F.lit(k)), " ") for k in (2, 3) for i in (1, 2, 3) if i + k - 1 <= WORDS]
    sizes = [(k, i) for k in (2, 3) for i in (1, 2, 3) if i + k - 1 <= WORDS]
    parts = F.array(*(F.when((n > k) & (i + k - 1 <= n), x) for (k, i), x in zip(sizes, inner, strict=True)))
    rows = longer.select("lang", "f", F.split("phrase", " ").alias("w")).select("lang", "f", F.explode(F.array_compact(parts)).alias("phrase"))
    return rows.groupBy("lang", "phrase").agg(F.max("f").alias("around"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most: int = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases (all numbers long).

    a, l, r: occurrences of the phrase and of the two parts of its lowest-scoring cut (ties to the shorter first part);
    n: all word occurrences of the language; score: SCALE * a div (l + r). A null lang is `und`, a null text is empty.
    Phrases in a longer one that has INSIDE hundredths of their occurrences are left out. Ties by a, then the phrase's bytes.
    Repeated rows count again; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession
    pieces = materialize(distinct_pieces(docs), "pieces")
    totals = pieces.groupBy("lang").agg(F.sum(F.col("m") * F.col("n_words")).alias("n"))
    levels, marks = [], None
    for n in range(1, WORDS + 1):
        levels.append(materialize(counted(weighted(pieces, n, marks), least), f"phrases-{n}"))
        if n < WORDS:
            if marks is not None:
                marks.unpersist()
            marks = spark.sparkContext.broadcast(bit_map(levels[-1], n))
    candidates = levels[1].union(levels[2]).union(levels[3])
    counts = levels[0].union(levels[1]).union(levels[2])
    around = longest_around(levels[2].union(levels[3]))
    kept = candidates.join(around, ["lang", "phrase"], "left").where("around IS NULL OR 5 * around < 4 * f").select("lang", "phrase", "f")
    scored = part_counts(materialize(kept, "candidates"), counts)
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most).drop("salt", "rank")
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return last.join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT lang, ws, len(ws) AS n FROM p WHERE len(ws) > 0),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, n, k, unnest(range(1, n - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE n >= k)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM c WHERE k >= 2),
sub AS (SELECT lang, f, array_to_string(ws[i:i + j - 1], ' ') AS phrase FROM (SELECT lang, f, ws, k, j, unnest(range(1, k - j + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS j) WHERE k > j)),
around AS (SELECT lang, phrase, max(f) AS around FROM sub GROUP BY lang, phrase),
kept AS (SELECT cand.* FROM cand LEFT JOIN around USING (lang, phrase) WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * f),
cut AS (SELECT lang, phrase, f, i, array_to_string(ws[1:i], ' ') AS p1, array_to_string(ws[i + 1:k], ' ') AS p2 FROM (SELECT *, unnest(range(1, k)) AS i FROM kept)),
s AS (SELECT cut.lang, cut.phrase, cut.f AS a, a1.f AS l, a2.f AS r, i, (2000000::HUGEINT * cut.f) // (a1.f + a2.f)::HUGEINT AS score FROM cut JOIN c a1 ON a1.lang = cut.lang AND a1.phrase = p1 JOIN c a2 ON a2.lang = cut.lang AND a2.phrase = p2),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS o FROM s) WHERE o = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score::BIGINT AS score FROM one)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
