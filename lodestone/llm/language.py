"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters' vectors, each rotated by its place, by
multiplication; a text's is the bundle (sum) of its trigrams'. The prototype of a language is the bundle of its training
texts. A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import mix, slices, table

DIMENSIONS, SEED = 1024, 7
#: Of the crc32 of doc_id as text, these remainders are held out.
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
#: Text bytes whose trigrams are counted at once: the arrays for a letter take about 50 bytes.
AT_ONCE = 2 << 20
#: Tasks that add up the other tasks' partial prototypes.
ADDERS = 64


@functools.lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Of each code point, the lower-case letter's, or 0 for other signs."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            out[i] = ord(c.lower()[0])
    return out


def letter_vectors(letters: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """+1 and -1 by a hash of letter, seed and place: the same on every worker."""
    places = np.arange(-(-dimensions // 64), dtype=np.uint64)
    words = mix(mix(letters.astype(np.uint64)[:, None] + np.uint64(seed << 32)) + places[None] * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(letters), -1), axis=1, bitorder="little")[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the text, trigram and count of each pair that occurs (sorted by text), the distinct trigrams as
    letters (n x 3), and how many letters each text has. Runs of other signs, and the ends, count as one letter 0."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = _lower()[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    letters = np.bincount(owner[raw > 0], minlength=len(texts))
    keep = np.append(True, (raw[1:] > 0) | (raw[:-1] > 0))
    raw, owner = raw[keep], owner[keep]
    # the sign before a text's first letter is the end of the text before it, or its own
    raw = np.append(np.uint32(0), raw)
    owner = np.append(owner[:1], owner)
    alphabet, code = np.unique(raw, return_inverse=True)
    m = len(alphabet)
    key = (code[:-2] * m + code[1:-1]) * m + code[2:]
    middle = owner[1:-1]
    real = (raw[1:-1] > 0) | ((owner[:-2] == middle) & (middle == owner[2:]) & (raw[:-2] > 0) & (raw[2:] > 0))
    key = np.sort(middle[real] * np.int64(m) ** 3 + key[real])
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(key)))
    text, gram = np.divmod(key[starts], m**3)
    distinct, gram = np.unique(gram, return_inverse=True)
    return text, gram, count, alphabet[np.stack([distinct // m // m, distinct // m % m, distinct % m], axis=1)], letters


def bind(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """A row a trigram (three letters): rotated letter vectors, multiplied."""
    alphabet, code = np.unique(grams, return_inverse=True)
    base, code = letter_vectors(alphabet, dimensions, seed), code.reshape(-1, 3)
    return np.roll(base, 2, axis=1)[code[:, 0]] * np.roll(base, 1, axis=1)[code[:, 1]] * base[code[:, 2]]


def _read(batch: pa.RecordBatch, column: str) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def learn_prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """The bundle of each non-null lang's texts (columns text, lang): one vector a language, the only thing collected."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", AT_ONCE):
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            number = {n: i for i, n in enumerate(names)}
            text, gram, count, grams, _ = trigrams(_read(batch, "text"))
            by = np.zeros((len(names), len(grams)), np.float64)
            np.add.at(by, (np.array([number[x] for x in langs], np.int64)[text], gram), count)
            made = by @ bind(grams, dimensions, seed).astype(np.float64)  # whole numbers under 2**53: exact
            for n, v in zip(names, made.astype(np.int64), strict=True):
                sums[n] = sums.get(n, 0) + v
        yield _vectors(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[n] = sums.get(n, 0) + np.frombuffer(v, np.int64)
        yield _vectors(sums)

    def _vectors(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "vector"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(bundle, "lang string, vector binary").repartition(ADDERS).mapInArrow(add, "lang string, vector binary")
    sums: dict[str, np.ndarray] = {}
    for r in parts.collect():
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["vector"], np.int64)
    return {n: v for n, v in sorted(sums.items()) if v.any()}


def predict(texts: list[str], names: list[str], prototypes: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """prototypes: rows of length 1. Ties go to the first name; without letters or languages: UNKNOWN, 0."""
    text, gram, count, grams, letters = trigrams(texts)
    vectors = bind(grams, dimensions, seed).astype(np.float32)
    bundles = np.zeros((len(texts), dimensions), np.float32)
    edges = np.searchsorted(text, np.arange(len(texts) + 1))
    count = count.astype(np.float32)
    for i in np.flatnonzero(np.diff(edges)):
        a, b = edges[i], edges[i + 1]
        bundles[i] = count[a:b] @ vectors[gram[a:b]]
    norms = np.linalg.norm(bundles.astype(np.float64), axis=1)
    if not len(names):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    cosines = bundles.astype(np.float64) @ prototypes.T / np.maximum(norms, 1e-12)[:, None]
    best = cosines.argmax(axis=1)
    known = letters > 0
    return [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0)


def held_out(key: F.Column) -> F.Column:
    """A null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train: F.Column | None = None, dimensions: int = DIMENSIONS, seed: int = SEED, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs and lang_pred, score (cosine, 0 to 1), or what names calls these two.

    Learns from rows where train holds (default: not held out) and lang isn't null; lang, key and others are never inputs of a
    prediction. Null texts and texts without letters get UNKNOWN and 0. Repeated rows get a row each. Columns of docs that are
    named so are replaced. Without training rows all are UNKNOWN.
    """
    found = learn_prototypes(docs.where(~held_out(F.col(key)) if train is None else train).select(F.col(text).alias("text"), F.col(lang).alias("lang")), dimensions, seed)
    langs_known = list(found)
    shared = docs.sparkSession.sparkContext.broadcast(np.array([v / np.linalg.norm(v) for v in found.values()]).reshape(-1, dimensions))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, AT_ONCE):
            langs, score = predict(_read(batch, text), langs_known, shared.value, dimensions, seed)
            yield batch.append_column(names[0], pa.array(langs, pa.string())).append_column(names[1], pa.array(score))

    docs = docs.drop(*names).withColumn(text, F.col(text).cast("string"))
    return docs.mapInArrow(label, StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
