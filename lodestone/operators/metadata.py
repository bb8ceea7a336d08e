"""The metadata lane: names, paths and types of files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scores as S
from ..functions import text as T
from ..functions.phonetic import LEAST, sounds_like
from ..plans.intent import Intent

#: Rows that a lane passes on.
MOST = 5000


def hard_filters(intent: Intent, modified: Column, from_micros: int | None = None, to_micros: int | None = None) -> Column:
    """Folder or file only, date range, categories or extensions (folders pass both)."""
    tests = [F.lit(True)]
    if intent.folders_only:
        tests.append(F.col("is_directory"))
    if intent.files_only:
        tests.append(~F.col("is_directory"))
    if from_micros is not None:
        tests.append(modified >= from_micros)
    if to_micros is not None:
        tests.append(modified < to_micros)
    if intent.extensions:
        tests.append(F.col("is_directory") | F.col("extension").isin(*sorted(intent.extensions)))
    elif intent.categories:
        tests.append(F.col("is_directory") | P.category(F.col("extension")).isin(*sorted(intent.categories)))
    return reduce(lambda a, b: a & b, tests)


#: A file's text isn't known to this lane: a predicate on it is neither met nor failed.
UNKNOWN = "struct<hangul: bigint, latin: bigint, digits: bigint, letters: bigint>"


def script_tests(predicates: tuple[tuple[str, str, str], ...], name: Column, path: Column, is_directory: Column, content: Column | None = None) -> list[Column]:
    """Each predicate in three-valued logic; a file's extension isn't part of its name. content: a profile, null if unknown."""
    own = F.when(is_directory, name).otherwise(P.stem(name))
    known = F.lit(None).cast(UNKNOWN) if content is None else content
    return [T.attribute(p, own, path, known) for p in predicates]


def _long_enough(word: str, letters: int) -> bool:
    return len(word) >= (2 if any("가" <= c <= "힣" or "\u3400" <= c <= "\u9fff" for c in word) else letters)


def by_sound(likeness: Column) -> Column:
    """The strength of a Hangul term that sounds like one of the words."""
    return F.when(likeness >= LEAST, 0.62 + F.least(F.lit(0.16), likeness - LEAST)).otherwise(0.0)


def strength(words: Column, wanted: list[str], values: tuple[float, float, float]) -> Column:
    """How well the best of a list of words fits one of the wanted: equal, at the begin (3 letters or more), inside (4 or more;
    Hangul from 2 on). One pass over the list, however many words are wanted."""
    equal, prefix, inside = values
    heads, parts = ("|".join(re.escape(w) for w in wanted if _long_enough(w, n)) for n in (3, 4))

    def one(w: Column) -> Column:
        c = F.when(w.isin(*wanted), equal)
        if heads:
            c = c.when(w.rlike(f"^(?:{heads})"), prefix)
        if parts:
            c = c.when(w.rlike(parts), inside)
        return c.otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(words, one)), F.lit(0.0)) if wanted else F.lit(0.0)


OWN, OTHER = (1.0, 0.92, 0.80), (0.78, 0.68, 0.56)


def search(files: DataFrame, intent: Intent, k: int, now_micros: int = 0, from_micros: int | None = None, to_micros: int | None = None) -> DataFrame:
    """files: file_id, name, full_path, directory_path, extension, is_directory, size_bytes, created, modified (microseconds).

    Per row kept: file_id, name_matches, path_matches, type_matches, matched, tier, score, ranking_score, best first. Rows of a
    wrong floor or script go; what isn't known of a script (a text) doesn't count against a file.
    """
    terms = intent.all_terms
    n = len(terms)
    rows = files.where(hard_filters(intent, F.col("modified"), from_micros, to_micros))
    if intent.floors:
        rows = rows.where(T.has_all_floors(F.concat_ws(" ", "name", "directory_path"), intent.floors))
    scripts = script_tests(intent.predicates, F.col("name"), F.col("directory_path"), F.col("is_directory"))
    for test in scripts:
        rows = rows.where(F.coalesce(test, F.lit(True)))
    known = reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(False)).cast("int") for x in scripts), F.lit(0))
    rows = rows.withColumns({"_name": T.tokens(F.col("name")), "_path": T.tokens(F.col("directory_path")), "_type": T.tokens(F.concat_ws(" ", F.substring("extension", 2, 32), F.concat_ws(" ", P.concepts(F.col("extension"))))), "_scripts": known})
    fits = []
    hangul = [i for i, t in enumerate(terms) if re.search("[가-힣]", t.original)]
    sounds = {f"_s_{part}_{i}": sounds_like(F.array_join(f"_{part}", " "), terms[i].original) for i in hangul for part in ("name", "path", "type")}
    rows = rows.withColumns(sounds) if sounds else rows
    for i, t in enumerate(terms):
        for part in ("name", "path", "type"):
            fits += [strength(F.col(f"_{part}"), [t.original], OWN).alias(f"_o_{part}_{i}"), F.greatest(strength(F.col(f"_{part}"), [a.lower() for a in t.names if a.lower() != t.original], OTHER), by_sound(F.col(f"_s_{part}_{i}")) if i in hangul else F.lit(0.0)).alias(f"_a_{part}_{i}")]
    rows = rows.select("*", *fits)
    each = [(p, i) for i in range(n) for p in ("name", "path", "type")]
    best = [F.greatest(f"_o_{p}_{i}", f"_a_{p}_{i}").alias(f"_{p}_{i}") for p, i in each]
    own = [((F.col(f"_o_{p}_{i}") >= F.col(f"_a_{p}_{i}")) & (F.col(f"_o_{p}_{i}") > 0)).alias(f"_{p}_own_{i}") for p, i in each]  # the original wins ties
    # filters on what is counted stay above it: pushed down, they would repeat every expression below
    rows = rows.select("*", *best, *own, F.monotonically_increasing_id().alias("_row"))
    c = F.col
    total = F.lit(0.0)
    counts = {x: F.lit(0) for x in ("name", "path", "type", "name_own", "path_own", "type_own", "matched", "own", "both", "core", "literal")}
    core, literal = {t.original for t in intent.terms}, {t.original for t in intent.literal_terms}
    for i, t in enumerate(terms):
        special = 1 + min(len(t.original), 8) * 0.08
        name, path, kind = (c(f"_{p}_{i}") for p in ("name", "path", "type"))
        own = {p: c(f"_{p}_own_{i}") for p in ("name", "path", "type")}
        total = total + F.when(own["name"], 185.0).otherwise(128.0) * special * name
        total = total + F.when(own["path"], 58.0).otherwise(39.0) * special * path * F.when(name > 0, 0.65).otherwise(1.0)
        total = total + F.when(own["type"], 115.0).otherwise(82.0) * special * kind * F.when(name > 0, 0.72).otherwise(1.0)
        hit = (name > 0) | (path > 0) | (kind > 0)
        for key, value in (("name", name > 0), ("path", path > 0), ("type", kind > 0), ("name_own", (name > 0) & own["name"]), ("path_own", (path > 0) & own["path"]), ("type_own", (kind > 0) & own["type"]), ("matched", hit), ("own", own["name"] | own["path"] | own["type"]), ("both", (name > 0) & ((path > 0) | (kind > 0))), ("core", hit & F.lit(t.original in core)), ("literal", ((name > 0) | (path > 0)) & F.lit(t.original in literal))):
            counts[key] = counts[key] + value.cast("int")
    rows = rows.withColumns({f"n_{k_}": v for k_, v in counts.items()} | {"_sum": total})
    requested = bool(intent.extensions or intent.categories)
    keep = c("_row") >= 0
    if intent.is_name_lookup:
        keep = keep & (c("n_name") > 0)
    if intent.terms:
        keep = keep & ((c("n_core") > 0) | (c("n_literal") > 0))
    elif n and not (requested or intent.floors or intent.folders_only):
        keep = keep & (c("n_matched") > 0)
    if requested and not intent.floors:
        keep = keep & (~c("is_directory") | (c("n_name") > 0) | (c("n_path") > 0))
    coverage = c("n_matched") / float(max(n, 1))
    score = c("_sum") + 240.0 * c("_scripts")
    if n > 1:
        score = F.when(coverage < 0.5, score * 0.72).otherwise(score) + 28.0 * c("n_own") - 18.0 * (n - c("n_matched"))
    if n:
        phrase = " ".join(t.original for t in terms)
        score = score + 170.0 * coverage * coverage + 26.0 * c("n_name") + 34.0 * c("n_name_own") + 8.0 * c("n_path_own") + 18.0 * c("n_type") + 12.0 * c("n_type_own")
        score = score + F.when(c("n_matched") == n, 190.0).otherwise(0.0) + F.when(c("n_name") == n, 230.0).otherwise(0.0) + 42.0 * c("n_both")
        if len(phrase) >= 3:
            score = score + F.when(F.contains(F.array_join("_name", " "), F.lit(phrase)), 260.0).otherwise(0.0)
    score = score + (180.0 if intent.extensions else 120.0 if intent.categories else 0.0) + (70.0 if from_micros is not None or to_micros is not None else 0.0) + (80.0 if intent.folders_only else 0.0) + (210.0 if intent.floors else 0.0)
    tier = F.when((c("n_name") == n) & F.lit(n > 0), 3).when((c("n_matched") == n) & F.lit(n > 0), 2).otherwise(1)
    signals = {"NameMatch": c("n_name") / float(max(n, 1)), "PathMatch": c("n_path") / float(max(n, 1)), "TypeMatch": c("n_type") / float(max(n, 1)), "created": c("created"), "modified": c("modified"), "size": c("size_bytes")}
    wish = S.preference(intent.directives, signals, now_micros)
    rows = rows.withColumns({"tier": tier, "score": score}).where(keep & (c("score") > 0))
    rows = rows.withColumn("ranking_score", c("tier") * 1e6 + c("score") + wish * 1000.0)
    out = rows.select("file_id", c("n_name").alias("name_matches"), c("n_path").alias("path_matches"), c("n_type").alias("type_matches"), c("n_matched").alias("matched"), "tier", "score", "ranking_score", "modified", "name")
    return out.orderBy(F.desc("ranking_score"), F.desc("modified"), "name", "file_id").limit(min(MOST, k)).drop("modified", "name")
