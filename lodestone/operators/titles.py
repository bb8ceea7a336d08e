"""Title search: matching as you type, character postings, and the score ladder of sentence queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import patterns
from ..functions import scores as S
from ..functions import text as T
from ..functions.phonetic import LEAST, sounds_like
from ..plans.intent import Intent, Term, tokenize
from .metadata import hard_filters, script_tests


def on_paths(query: str) -> bool:
    """Whether a query is one on whole paths: it has a separator or colon."""
    return re.search(r"[\\/:]", query) is not None


def matcher(query: str, whole_word: bool = False, match_case: bool = False, use_regex: bool = False, kind: str = "all", name: str = "name", path: str = "full_path") -> Column:
    """A filter on names, or on full paths if the query has a separator or colon. kind: all, files or folders. A pattern is matched
    in linear time (functions/patterns.py): ValueError for one that can't be."""
    target = F.col(path if on_paths(query) and not use_regex else name)
    if not match_case and not use_regex:
        target, query = F.lower(target), query.lower()
    if use_regex:
        test = patterns.matches(target, query, match_case)
    else:
        test = T.whole_word(target, query) if whole_word else F.contains(target, F.lit(query))
    return test & {"all": F.lit(True), "files": ~F.col("is_directory"), "folders": F.col("is_directory")}[kind]


def search(files: DataFrame, test: Column, k: int, sort: str = "name", descending: bool = False) -> DataFrame:
    """The first k matches by name, path, size or modified, then path."""
    by = {"name": F.lower("name"), "path": F.lower("full_path"), "size": F.coalesce("size_bytes", F.lit(-1)), "modified": F.col("modified")}[sort]
    return files.where(test).orderBy(by.desc() if descending else by.asc(), F.lower("full_path"), "full_path").limit(k)


def postings(files: DataFrame, key: str = "file_id", chunk: int = 1 << 20) -> DataFrame:
    """ch, chunk, n, ids (sorted): the files whose upper-case name holds a character. A file counts once a character.

    Keys are numbers; a list holds the files of one chunk of them, so that a common character's list stays bounded.
    """
    chars = F.array_distinct(F.filter(F.split(F.upper("name"), ""), lambda x: x != ""))
    rows = files.select(F.explode(chars).alias("ch"), F.floor(F.col(key) / chunk).alias("chunk"), key)
    return rows.groupBy("ch", "chunk").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("ids"))


def rarest(posting_sizes: DataFrame, query: str) -> DataFrame:
    """The query's character with the fewest files; no row if one of its characters has none. posting_sizes: ch, n (of any chunks)."""
    chars = sorted(set(query.upper()))
    sizes = posting_sizes.where(F.col("ch").isin(*chars)).groupBy("ch").agg(F.sum("n").alias("n"))
    found = sizes.agg(F.min_by("ch", F.struct("n", "ch")).alias("ch"), F.min("n").alias("n"), F.count("*").alias("_c"))
    return found.where(F.col("_c") == len(chars)).drop("_c")


def normal(text: str) -> str:
    """A query's word as T.normalized has titles."""
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def holds(where: Column, term: Term) -> Column:
    """Whether a normalized text has a term: phrases and Hangul anywhere, Latin words whole, or by sound."""
    tests = []
    for w in dict.fromkeys(normal(x) for x in term.names):
        if w:
            tests.append(T.has_word(where, w) if re.fullmatch("[a-z0-9]+", w) else F.contains(where, F.lit(w)))
    if re.search("[가-힣]", term.original) and any(re.fullmatch("[a-z0-9]+", normal(x)) for x in term.names):
        tests.append(sounds_like(where, term.original) >= LEAST)
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _count(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (x.cast("int") for x in tests), F.lit(0))


def ladder(files: DataFrame, intent: Intent, k: int, now_micros: int = 0, from_micros: int | None = None, to_micros: int | None = None) -> DataFrame:
    """file_id, score, percent, exact, rung by the first rung that holds; best first.

    The rungs: type only, folder only, floors only, literal words only, scripts only; then the whole query as the title or in it,
    literal words, the terms as one phrase, all as they were typed, all in the title, all in title and folders, and some.
    A wish (newest first, say) is added to the score. Words of the query stand in for terms where it has no condition at all.
    """
    c, terms, literals = F.col, intent.terms, intent.literal_terms
    kinds = bool(intent.extensions or intent.categories)
    if not (terms or literals or kinds or intent.floors or intent.predicates or intent.folders_only or intent.files_only):
        terms = tuple(Term(w, (w,), (w,)) for w in dict.fromkeys(tokenize(intent.query)) if len(w) >= 2)
    n, words = len(terms), normal(intent.query)
    rows = files.where(hard_filters(intent, c("modified"), from_micros, to_micros))
    place = P.parent_context(c("directory_path"))
    if intent.floors:
        rows = rows.where(T.has_all_floors(F.concat_ws(" ", c("name"), place), intent.floors))
    scripts = script_tests(intent.predicates, c("name"), place, c("is_directory"))
    for test in scripts:  # what isn't known doesn't count against a title
        rows = rows.where(F.coalesce(test, F.lit(True)))
    keep = ["file_id", "name", "is_directory", *(x for x in ("created", "modified", "size_bytes") if x in files.columns)]
    rows = rows.select(*keep, T.normalized(c("name")).alias("_title"), T.normalized(place).alias("_context"), T.compact(c("name")).alias("_compact"), _count([F.coalesce(x, F.lit(False)) for x in scripts]).alias("_scripts"))
    in_title, in_path = ([holds(c(w), t) for t in terms] for w in ("_title", "_context"))
    original = [F.contains(c("_title"), F.lit(normal(t.original))) for t in terms]
    rows = rows.withColumns({
        "_t": _count(in_title), "_p": _count(in_path), "_o": _count(original), "_m": _count([a | b for a, b in zip(in_title, in_path, strict=True)]),
        "_lt": _count([holds(c("_title"), t) for t in literals]), "_lp": _count([holds(c("_context"), t) for t in literals]),
    })
    literal, phrase = c("_lt") + c("_lp") > 0, "".join(normal(t.original) for t in terms)
    equal = (c("_title") == words) & F.lit(bool(words))
    inside = F.contains(c("_title"), F.lit(words)) & F.lit(len(words) >= 2)
    none, no = F.lit(n == 0), F.lit(0.0)
    few = F.when(c("_lt") > 0, F.lit(1)).otherwise(F.lit(0))
    coverage = c("_m") / float(max(n, 1))
    typed = F.when(~c("is_directory") & F.lit(kinds), 80.0).otherwise(0.0)
    strict = c("_t") > 0 if intent.is_name_lookup else F.lit(True)
    rungs = (
        ("type", none & ~c("is_directory") & F.lit(kinds), F.lit(880.0 if intent.extensions else 760.0), F.lit(96.0 if intent.extensions else 88.0)),
        ("folder", none & c("is_directory") & F.lit(intent.folders_only), F.lit(760.0), F.lit(88.0)),
        ("floor", none & F.lit(bool(intent.floors)), F.lit(820.0), F.lit(92.0)),
        ("literal", none & literal, 805.0 + 25.0 * c("_lt"), 86.0 + 7.0 * few),
        ("script", none & (c("_scripts") > 0), 835.0 + 20.0 * c("_scripts"), F.lit(94.0)),
        ("equal", equal, F.lit(1000.0), F.lit(100.0)),
        ("inside", inside, F.lit(930.0), F.lit(98.0)),
        ("word", F.lit(n > 0) & strict & (c("_m") == 0) & literal, 790.0 + 25.0 * c("_lt"), 84.0 + 8.0 * few),
        ("phrase", F.lit(len(phrase) >= 2) & strict & (c("_m") == n) & F.contains(c("_compact"), F.lit(phrase)), F.lit(900.0 + min(40, len(phrase))), F.lit(96.0)),
        ("typed", F.lit(n > 0) & strict & (c("_m") > 0) & (c("_o") == n), F.lit(850.0 + min(40, 5 * n)), F.lit(92.0)),
        ("title", F.lit(n > 0) & strict & (c("_t") == n), F.lit(825.0 + min(35, 5 * n)), F.lit(90.0)),
        ("path", F.lit(n > 0) & strict & (c("_m") == n), 760.0 + 18.0 * c("_t") + 10.0 * c("_p"), F.lit(88.0)),
        ("some", F.lit(n > 0) & strict & (c("_m") > 0), 540.0 + 190.0 * coverage + 10.0 * c("_o") + 9.0 * c("_t") + 4.0 * c("_p") + typed, S.clamp(60.0 + 28.0 * coverage, 61.0, 88.0)),
    )
    # the first rung that holds, once; score and percent by its number
    number = reduce(lambda w, r: w.when(r[1][1], F.lit(r[0])), enumerate(rungs), F)
    rows = rows.withColumns({"_exact": equal | inside, "_rung": number}).where("_rung IS NOT NULL")
    pick = lambda i: reduce(lambda w, r: w.when(c("_rung") == r[0], F.lit(r[1][0]) if i == 0 else r[1][i]), enumerate(rungs), F)
    score = pick(2).cast("double")
    if intent.directives:
        signals = {x: c(y) if y in files.columns else F.lit(None).cast("long") for x, y in (("created", "created"), ("modified", "modified"), ("size", "size_bytes"))}
        score = score + S.adjustment(intent.directives, signals, now_micros)
    out = rows.select("file_id", "name", score.alias("score"), F.coalesce(pick(3).cast("double"), no).alias("percent"), c("_exact").alias("exact"), pick(0).alias("rung"))
    return out.orderBy(F.desc("score"), F.desc("exact"), F.lower("name"), "file_id").limit(k).drop("name")


def merge_titles(previous: DataFrame, incoming: DataFrame, k: int = 3000) -> DataFrame:
    """path_key, name, score, percent: the better row of each path, best first."""
    best = previous.unionByName(incoming).groupBy("path_key").agg(F.max(F.struct("score", "percent", "name")).alias("_b")).select("path_key", "_b.*")
    return best.orderBy(F.desc("score"), F.desc("percent"), F.lower("name"), "path_key").limit(k)


def live_hits(indexed: DataFrame, live: DataFrame) -> DataFrame:
    """path_key, score, percent: what is seen in the current folder counts for more than what an index says, and each path once."""
    seen = live.select("path_key", F.greatest(F.lit(930.0), F.col("score") + 140.0).alias("score"), F.greatest(F.lit(94.0), F.col("percent")).alias("percent"))
    return seen.unionByName(indexed.select("path_key", "score", "percent").join(seen.select("path_key"), "path_key", "left_anti"))


def posting_order(posting_sizes: DataFrame, queries: list[str]) -> DataFrame:
    """query, ch, n: each query's rarest character, queries of rare characters first; a query whose character has no file is left out."""
    spark = posting_sizes.sparkSession
    wanted = spark.createDataFrame([(q, c) for q in queries for c in sorted(set(q.upper()))], "query string, ch string")
    sizes = posting_sizes.groupBy("ch").agg(F.sum("n").alias("n"))
    found = F.broadcast(wanted).join(sizes, "ch", "left") if queries else wanted.join(sizes, "ch", "left")
    return found.groupBy("query").agg(F.min_by("ch", F.struct("n", "ch")).alias("ch"), F.min("n").alias("n"), F.count_if(F.col("n").isNull()).alias("_none")).where("_none = 0").drop("_none").orderBy("n", "query")
