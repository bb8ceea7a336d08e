"""Token counts: pieces are counted once per distinct pre-token and joined to per-document pre-token frequencies.

No ids are made for a document. Two passes over the text: the first counts pre-tokens within each task, then over all
tasks; the distinct ones are encoded once. The most frequent FREQUENT of them (a fixed bound, a few MB) are joined inside
the second pass as a broadcast table; all others, in full, by a shuffled join, so that no frequent word's rows meet in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, most_frequent, slices, table
from .tokens import byte_bpe

#: Rows of the broadcast part of the vocabulary, whatever the corpus.
FREQUENT = 100_000
#: Distinct pre-tokens that a task holds before it passes its counts on.
HELD = 400_000


def vocabulary_counts(docs: DataFrame, text: str, path: str) -> DataFrame:
    """(pre_token, uses long, n_pieces long) of all distinct pre-tokens; each is encoded once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = byte_bpe(path), Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pre_token", "uses"])
            seen.clear()
            return made

        for batch in batches:
            for x in batch.column(0):
                if x := x.as_py():
                    seen.update(bpe.pre_tokens(x)[0])
                    if len(seen) > HELD:
                        yield out()
        yield out()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            yield batch.append_column("n_pieces", pa.array(map(bpe.count, batch.column(0).to_pylist()), pa.int64()))

    uses = docs.select(text).mapInArrow(count, "pre_token string, uses long").groupBy("pre_token").agg(F.sum("uses").alias("uses"))
    return uses.mapInArrow(encode, "pre_token string, uses long, n_pieces long")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = 512, frequent: int = FREQUENT) -> DataFrame:
    """Per row of docs: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Rows with equal key and text give one result row each; a null key is
    a key like others. Other columns of docs are ignored, whatever their names. Empty tables give an empty result.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    pieces = materialize(vocabulary_counts(docs, "text", path), "pre-tokens")
    top = most_frequent(pieces, "uses", frequent).select("pre_token", "n_pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, have = byte_bpe(path), known.value
        for part in slices(batches, "text", 4 << 20, 500):
            rows, marks, sizes, words, uses, sums = [], [], [], [], [], []
            for i, x in enumerate(part.column(1).to_pylist()):
                x = x or ""
                raw = x.encode()
                mark = xxhash.xxh3_128_intdigest(raw)
                low = (mark & (2**64 - 1)) - 2**63
                found, n = bpe.pre_tokens(x)
                rest = {}
                for w, f in Counter(found).items():
                    if (k := have.get(w)) is not None:
                        n += k * f
                    else:
                        rest[w] = f
                rows += [i] * (len(rest) + 1)
                marks += [low] * (len(rest) + 1)
                sizes += [len(raw), *[None] * len(rest)]
                sums += [n, *[0] * len(rest)]
                words += [f"\x00{mark:x}", *rest]  # no pre-token: digits never follow other signs in one
                uses += [0, *rest.values()]
            keys = part.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(words, pa.string()), pa.array(uses, pa.int64())], names)

    names = ["key", "mark", "n_bytes", "n_known", "pre_token", "uses"]
    kind = docs.schema["key"].dataType.simpleString()
    rows = docs.mapInArrow(frequencies, f"key {kind}, mark long, n_bytes long, n_known long, pre_token string, uses long")
    counted = rows.join(pieces.select("pre_token", "n_pieces"), "pre_token", "left").groupBy("key", "mark").agg(
        F.count("n_bytes").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n_known") + F.col("uses") * F.coalesce("n_pieces", F.lit(0))).alias("total")
    )
    n = (F.col("total") / F.col("copies")).cast("long")
    return counted.select(F.col("key").alias(key), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_")).drop("_")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
