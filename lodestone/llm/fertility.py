"""Quality rules by tokeniser fertility: how public vocabularies take a text, held against its language's or script's own bands.

Of every text: characters per token in two vocabularies, the share of pieces that fall back to bytes, and the entropy of the
tokens in windows of WINDOW (a share of the most that a window can have, so that it doesn't depend on a text's length). The
byte-level vocabulary takes the whole text; the one of pieces, whose pieces never go across white space, takes each distinct
word once.
Each group (a language; a script where the language is null) has a band for each measure: the quartiles of the group's
distinct measurements, widened by WIDTHS interquartile ranges. A text outside a band of its group is rejected. Counting rules
on words, signs and lines come before: what fails them has no part in the bands.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table
from .tokens import byte_bpe

#: Bytes of signs that are counted, and of white space between words.
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: Words of a window that may repeat, the least words of a text, and the share of repeated words (in 100) that it may have.
REPEAT, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Tokens of an entropy window; texts a group needs for bands of its own; salts of a group's rows.
WINDOW, LEAST_TEXTS, SALTS = 64, 30, 64
#: Interquartile ranges that a band goes beyond the quartiles on either side, and the least range that counts.
WIDTHS = {"chars_per_token": (4.0, 0.05), "chars_per_piece": (4.0, 0.05), "fallback_share": (4.0, 0.02), "entropy": (3.0, 0.01)}
#: Measures that are rejected on one side only: few fallbacks and much entropy are no fault.
ONE_SIDED = {"fallback_share": "high", "entropy": "low"}
#: Bytes of text that are split or encoded at once: a longer text is taken in pieces that end before white space.
AT_ONCE = 1 << 20
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Hangul", "Han", "Hiragana", "Katakana", "Arabic", "Hebrew", "Devanagari", "Thai")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bool]]:
    """The library's model and which ids are single bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, [model.is_byte(i) for i in range(model.get_piece_size())]


def cut(text: str, most: int) -> Iterator[str]:
    """The text in pieces of about most characters that end before white space (or at four times that, where none comes)."""
    start = 0
    while len(text) - start > most:
        found = regex.search(r"[ \t-\r]", text, pos=start + most, endpos=start + 4 * most)
        end = found.start() if found else min(len(text), start + 4 * most)
        yield text[start:end]
        start = end
    yield text[start:]


def word_ids(raw: bytes, index: defaultdict[bytes, int], most: int | None = None) -> np.ndarray:
    """A number for each word, equal words equal; index numbers new words."""
    most = most or AT_ONCE
    out, start = [], 0
    while start < len(raw):
        end = len(raw)
        if end - start > most:
            found = regex.search(rb"[ \t-\r]", raw, pos=start + most)
            end = found.start() if found else end
        words = raw[start:end].split()
        out.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_words(ids: list[np.ndarray], width: int = REPEAT) -> np.ndarray:
    """Of each text's words: how many lie in a window of width words (8: a power of two) that occurs twice or more in the text.

    Windows of 2, 4 and 8 words get numbers by pairs of shorter ones, so equal numbers are equal words of one text; windows whose
    first or second half occurs once in the text have none.
    """
    n = np.array([len(x) for x in ids], np.int64)
    code, owner = np.concatenate([np.zeros(0, np.int64), *ids]), np.repeat(np.arange(len(ids)), n)
    begins, size = np.arange(len(code)), 1
    while size < width and len(begins):
        two = begins[begins + size < len(code)]
        two = two[(owner[two + size] == owner[two]) & (code[two + size] >= 0)]
        first, second, text = code[two], code[two + size], owner[two] if size == 1 else np.zeros(len(two), np.int64)  # longer ones are of one text
        base = int(code.max(initial=0)) + 1
        if (int(text.max(initial=0)) + 1) * base * base >= 1 << 62:
            first, base = np.unique(text * base + first, return_inverse=True)[1], base + len(two)
            text = np.zeros(len(two), np.int64)
        key = (text * base + first) * base + second
        ordered = np.sort(key)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        at = np.minimum(np.searchsorted(again, key), max(0, len(again) - 1))
        keep = again[at] == key if len(again) else np.zeros(len(key), bool)
        code, begins, size = np.full(len(code), -1, np.int64), two[keep], 2 * size
        code[begins] = at[keep]
    change = np.zeros(len(code) + 1, np.int64)
    if len(begins):
        np.add.at(change, begins, 1)
        np.add.at(change, begins + width, -1)
    return np.bincount(owner[np.cumsum(change[:-1]) > 0], minlength=len(ids)).astype(np.int64)


def base_counts(texts: list[str]) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[bytes]]:
    """The counts of BASE for each text, the numbers of its words, and the distinct words by number."""
    index: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    ids, chars, signs, lines = [], [], [], []
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        ids.append(word_ids(raw, index))
        chars.append(len(text) - len(raw) + len(raw.translate(None, SPACES)))
        signs.append(len(raw) - len(raw.translate(None, SYMBOLS)))
        own = [x for x in raw.split(b"\n") if x.strip()]
        lines.append(len(own) - len(set(own)))
    counts = ([len(x) for x in ids], chars, signs, lines, repeated_words(ids))
    return {c: np.array(v, np.int64) for c, v in zip(BASE, counts, strict=True)}, ids, list(index)


#: Words whose pieces a worker remembers, and their counts: pieces above 32 bits of those that are bytes. Bytes of a longest word
#: that is encoded whole.
REMEMBERED, LONGEST = 500_000, 4096
_known: dict[str, dict[bytes, int]] = {}


def piece_counts(words: list[bytes], pieces_path: str) -> np.ndarray:
    """words x 2: pieces of each word alone, and how many of them are bytes."""
    model, is_byte = _pieces(pieces_path)
    known = _known.setdefault(pieces_path, {})
    if len(known) > REMEMBERED:
        known.clear()
    new = [w for w in words if w not in known and len(w) <= LONGEST]
    for w, ids in zip(new, model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1) if new else [], strict=True):
        known[w] = len(ids) << 32 | sum(map(is_byte.__getitem__, ids))
    out = [known[w] if len(w) <= LONGEST else _long(w.decode("utf-8", "replace"), model, is_byte) for w in words]
    out = np.array(out, np.int64).reshape(-1, 1)
    return np.concatenate([out >> 32, out & 0xFFFFFFFF], axis=1)


def _long(word: str, model: sentencepiece.SentencePieceProcessor, is_byte: list[bool]) -> int:
    """The counts of a very long word, from parts of it."""
    total = 0
    for a in range(0, len(word), LONGEST):
        ids = model.encode(word[a : a + LONGEST], num_threads=1)
        total += len(ids) << 32 | sum(map(is_byte.__getitem__, ids))
    return total


def window_entropy(ids: np.ndarray, window: int = WINDOW) -> float:
    """Mean entropy of the tokens of whole windows, 1 if all differ; of a shorter text, its own."""
    window = min(window, len(ids))
    if window < 2:
        return 1.0
    m = len(ids) // window
    x = np.sort(ids[: m * window].reshape(m, window), axis=1)
    new = np.append(np.ones((m, 1), bool), x[:, 1:] != x[:, :-1], axis=1).ravel()
    n = np.diff(np.append(np.flatnonzero(new), m * window))
    return float(1 - (n * np.log2(n)).sum() / (m * window) / np.log2(window))


def tokens_of(text: str, path: str) -> np.ndarray:
    bpe = byte_bpe(path)
    return np.concatenate([bpe.ids(part) for part in cut(text, AT_ONCE)])


def measures_of(texts: list[str], counts: dict[str, np.ndarray], ids: list[np.ndarray], words: list[bytes], wanted: np.ndarray, path: str, pieces_path: str) -> list[tuple[float, float, float, float] | None]:
    """The four measures of WIDTHS of the wanted texts (each has a word); None for others."""
    by_word, out = piece_counts(words, pieces_path), []
    for i, text in enumerate(texts):
        if not wanted[i]:
            out.append(None)
            continue
        tokens, (pieces, fallbacks) = tokens_of(text, path), by_word[ids[i]].sum(axis=0).tolist()
        out.append((len(text) / max(1, len(tokens)), float(counts["word_chars"][i]) / max(1, pieces), fallbacks / max(1, pieces), window_entropy(tokens)))
    return out


def script_of(text: str) -> str:
    """The script that most letters are of; of none: Other."""
    found = {s: sum(1 for _ in regex.finditer(rf"\p{{Script={s}}}", text)) for s in SCRIPTS}
    best = max(SCRIPTS, key=lambda s: found[s])
    return best if found[best] else "Other"


def measure(docs: DataFrame, key: str, text: str, lang: str, path: str, pieces_path: str) -> DataFrame:
    """key, grp, the counts of BASE, base_failed and the measures (null where the base failed)."""
    names = ["key", "grp", *BASE, "base_failed", *WIDTHS]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            counts, ids, words = base_counts(texts)
            failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
            found = measures_of(texts, counts, ids, words, ~failed, path, pieces_path)
            groups = [f"lang {g}" if g is not None else f"script {script_of(x)}" for x, g in zip(texts, batch.column("lang").to_pylist(), strict=True)]
            measures = [pa.array([None if x is None else x[i] for x in found], pa.float64()) for i in range(len(WIDTHS))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(groups, pa.string()), *(pa.array(counts[c]) for c in BASE), pa.array(failed), *measures], names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    kind = rows.schema["key"].dataType.simpleString()
    counts, measures = ", ".join(f"{c} long" for c in BASE), ", ".join(f"{m} double" for m in WIDTHS)
    return rows.mapInArrow(one, f"key {kind}, grp string, {counts}, base_failed boolean, {measures}")


def bands(measured: DataFrame, widths: dict[str, tuple[float, float]], least: int) -> DataFrame:
    """grp and low_m, high_m of each measure m, from the quartiles of the group's distinct measurements (in thousandths, so that a
    group's distinct values stay few). Groups of fewer than least distinct texts have none."""
    thousandths = [F.round(m, 3).alias(m) for m in widths]
    distinct = measured.where(F.col("entropy").isNotNull()).select("grp", "n_words", *widths).distinct().select("grp", *thousandths)
    quartiles = distinct.groupBy("grp").agg(F.count("*").alias("n"), *(F.percentile(m, F.array(F.lit(0.25), F.lit(0.75))).alias(m) for m in widths)).where(F.col("n") >= least)
    out = []
    for m, (width, least_range) in widths.items():
        q1, q3 = F.col(m)[0], F.col(m)[1]
        reach = width * F.greatest(q3 - q1, F.lit(least_range))
        out += [(q1 - reach if ONE_SIDED.get(m) != "high" else F.lit(None).cast("double")).alias(f"low_{m}"), (q3 + reach if ONE_SIDED.get(m) != "low" else F.lit(None).cast("double")).alias(f"high_{m}")]
    return quartiles.select("grp", "n", *out)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None, pieces_path: str | None = None, widths: dict[str, tuple[float, float]] | None = None, least: int = LEAST_TEXTS) -> DataFrame:
    """Per row of docs: key, grp, the counts of BASE, base_failed, the measures, rejected_by (names of the measures out of
    band, by comma) and kept.

    A null text has no words and fails the base. A null lang is judged by script. Groups of fewer than least distinct texts
    have no bands and reject nothing. Repeated rows get a row each, a null key is a key like others; other columns are
    ignored, and an empty table gives no rows. Special strings inside texts count as the tokens that they stand for.
    """
    widths = widths or WIDTHS
    path, pieces_path = path or public_tokenizers.path("byte_bpe_50k.json"), pieces_path or public_tokenizers.path("piece_bpe_32k.model")
    measured = materialize(measure(docs, key, text, lang, path, pieces_path), "fertility")
    salted = bands(measured, widths, least).drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = measured.withColumn("salt", F.pmod(F.xxhash64("key", "n_words", "word_chars", "entropy"), F.lit(SALTS)).cast("int")).join(salted, ["grp", "salt"], "left")
    out = {m: F.coalesce((F.col(m) < F.col(f"low_{m}")) | F.coalesce(F.col(m) > F.col(f"high_{m}"), F.lit(False)), F.col(m) > F.col(f"high_{m}"), F.lit(False)) for m in widths}
    rejected = F.concat_ws(",", *(F.when(test, m) for m, test in out.items()))
    return rows.select(F.col("key").alias(key), "grp", *BASE, "base_failed", *widths, rejected.alias("rejected_by"), (~F.col("base_failed") & (rejected == "")).alias("kept"))


def op11_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
