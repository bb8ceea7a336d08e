"""Names that sound like Hangul words, found by an index of their words' pairs of letters.

Two words that are near by edits share pairs of letters: of a reading of n letters, any word (or part of a word) within d edits
has at least n - 1 - 2d. So it has one of the reading's 2d + 1 rarest pairs, and only words with one of these are compared. The
same holds for the consonants by sound. All of it is joins and built-in functions; each distinct word is compared once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phonetic
from ..functions.phonetic import LEAST, SHORTEST_SKELETON, SHORTEST_WORD, aliases, phonetic_similarity


def words_of(names: DataFrame, key: str, name: str = "name") -> DataFrame:
    """key, word: the Latin words of each name that are long enough, once each."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= SHORTEST_WORD))
    return names.select(key, F.explode(found).alias("word"))


def _pairs(text: Column, mark: str) -> Column:
    n = F.length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(2)))))).otherwise(F.array().cast("array<string>"))


def pairs_of(words: DataFrame) -> DataFrame:
    """pair, word: the pairs of letters of each distinct word, and those of its consonants by sound."""
    return words.select("word").distinct().select("word", F.explode(F.concat(_pairs(F.col("word"), "w"), _pairs(phonetic.skeleton_of(F.col("word")), "s"))).alias("pair")).select("pair", "word")


def edits(length: int, least: float = LEAST) -> int:
    """The most edits between a reading of so many letters and a text that is as like as least."""
    return math.floor((1 - least) * length / least + 1e-9)


def wanted_pairs(text: str, mark: str, counts: dict[str, int], least: float = LEAST) -> list[str]:
    """The rarest pairs of a reading, of which a text that is like enough has one at least."""
    pairs = [mark + text[i : i + 2] for i in range(len(text) - 1)]
    shared = len(pairs) - 2 * edits(len(text), least)
    if shared < 1:
        raise ValueError("texts that are so little alike may share no pair of letters")
    return sorted(set(sorted(pairs, key=lambda p: (counts.get(p, 0), p))[: len(pairs) - shared + 1]))


def sound_alike(words: DataFrame, pairs: DataFrame, terms: list[str], key: str, least: float = LEAST) -> DataFrame:
    """term, key, likeness of the names with a word that sounds like a term, least or more. words and pairs: tables of words_of and
    pairs_of. Terms without Hangul, or whose reading is too short, have none. ValueError where least is so low that a
    word may share no pair of letters with a reading."""
    readings = {t: aliases(t) for t in dict.fromkeys(terms)}
    texts = {(r, "w") for rs in readings.values() for r in rs} | {(s, "s") for rs in readings.values() for r in rs if len(s := phonetic.skeleton(r)) >= SHORTEST_SKELETON}
    every = sorted({mark + x[i : i + 2] for x, mark in texts for i in range(len(x) - 1)})
    counts = {r["pair"]: r["count"] for r in pairs.where(F.col("pair").isin(*every)).groupBy("pair").count().collect()} if every else {}  # the readings' pairs at most
    out = []
    for term, rs in readings.items():
        asked = set()
        for r in rs:
            asked |= set(wanted_pairs(r, "w", counts, least))
            if len(s := phonetic.skeleton(r)) >= SHORTEST_SKELETON:
                asked |= set(wanted_pairs(s, "s", counts, least))
        if asked:
            near = pairs.where(F.col("pair").isin(*sorted(asked))).select("word").distinct()
            out.append(near.select(F.lit(term).alias("term"), "word", phonetic_similarity(F.col("word"), term).alias("likeness")).where(F.col("likeness") >= least))
    if not out:
        return words.select(F.lit(None).cast("string").alias("term"), key, F.lit(0.0).alias("likeness")).limit(0)
    return words.join(reduce(DataFrame.union, out), "word").groupBy("term", key).agg(F.max("likeness").alias("likeness"))
