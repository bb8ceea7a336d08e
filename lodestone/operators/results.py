"""Operators on result sets and index maintenance: refinement, order, quotas, pending work, readiness."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scores as S
from ..functions import text as T
from ..plans import fixed, visual
from ..plans.intent import Intent, Term, once
from .metadata import script_tests


def read_forms(text: Column, name: str) -> dict[str, Column]:
    """What terms are looked for in: a text's words with one space around each, and the text without gaps."""
    narrow = T.narrow(text)
    return {f"_words_{name}": F.concat(F.lit(" "), T.normalized(narrow), F.lit(" ")), f"_bare_{name}": T.compact(narrow)}


def term_in(words: Column, bare: Column, term: Term) -> Column:
    """Of a text's read_forms. A phrase anywhere; Hangul and Han anywhere in the text without gaps; a word whole, or as a beginning
    from three letters on. All of a term's words but Hangul and Han are one pattern: these texts have only letters, digits and
    spaces."""
    plain, joined = [], []
    for w in term.names:
        w = " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", w).lower()))
        if not w:
            continue
        if " " not in w and re.search("[가-힣\u3400-\u9fff]", w):
            joined.append(F.contains(bare, F.lit(w)))
        else:
            plain.append(w if " " in w else f" {w}" if len(w) >= 3 else f" {w} ")
    tests = joined + ([words.rlike("|".join(dict.fromkeys(plain)))] if plain else [])
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def term_holds(text: Column, term: Term) -> Column:
    """term_in of a text."""
    return term_in(*read_forms(text, "").values(), term)


def refine(source: DataFrame, intent: Intent, now_micros: int = 0, from_micros: int | None = None, to_micros: int | None = None, profile: Column | None = None) -> DataFrame:
    """source: orig_idx (the place in the result), name, directory_path, extension, is_directory, modified, and what wishes look at
    (created, size_bytes, kind, percent, analyzed). Rows with enough of the terms, by match, then wishes, then original order.

    Script predicates are three-valued: rows where one is unknown go too, and unknown_count tells how many. profile: the script
    profile of a row's text, null where no text is known.
    """
    c, terms = F.col, intent.all_terms
    n = len(terms)
    rows = source
    if intent.floors:
        rows = rows.where(T.has_all_floors(F.concat_ws(" ", "name", "directory_path", P.type_display(c("extension"), c("is_directory"))), intent.floors))
    scripts = script_tests(intent.predicates, c("name"), c("directory_path"), c("is_directory"), profile)
    for test in scripts:
        rows = rows.where(F.coalesce(test, F.lit(False)))
    shown = P.type_display(c("extension"), c("is_directory"))
    # concepts count for the type's match, but not for a term's being matched at all
    meant = F.concat_ws(" ", shown, "extension", F.substring("extension", 2, 255), F.concat_ws(" ", P.concepts(c("extension"))))
    # each text is brought to its forms once; a row number in the condition keeps the filter above what it counts
    texts = {"name": c("name"), "path": c("directory_path"), "type": meant, "shown": F.concat_ws(" ", shown, "extension")}
    rows = rows.withColumns({k: v for name, text in texts.items() for k, v in read_forms(F.coalesce(text, F.lit("")), name).items()} | {"_row": F.monotonically_increasing_id()})
    in_name, in_path, in_type, plain = ([term_in(c(f"_words_{x}"), c(f"_bare_{x}"), t) for t in terms] for x in texts)
    count = lambda tests: reduce(lambda a, b: a + b, (x.cast("int") for x in tests), F.lit(0))
    rows = rows.withColumns({"matched": count([a | b | d for a, b, d in zip(in_name, in_path, plain, strict=True)]), "in_name": count(in_name), "in_path": count(in_path), "in_kind": count(in_type)})
    rows = rows.where((c("matched") >= (max(1, -(-n // 2)) if n else 0)) & (c("_row") >= 0)).drop("_row", *(f"_{k}_{x}" for k in ("words", "bare") for x in texts))
    if intent.folders_only or intent.files_only:
        rows = rows.where(c("is_directory") if intent.folders_only else ~c("is_directory"))
    if intent.categories or intent.extensions:
        direct = c("is_directory") & ((c("in_name") > 0) | (c("in_path") > 0) | F.lit(bool(intent.floors)))
        fits = ~c("is_directory")
        if intent.categories:
            fits = fits & P.category(c("extension")).isin(*sorted(intent.categories))
        if intent.extensions:
            fits = fits & c("extension").isin(*sorted(intent.extensions))
        rows = rows.where(fits | direct)
    if from_micros is not None:
        rows = rows.where(c("modified") >= from_micros)
    if to_micros is not None:
        rows = rows.where(c("modified") < to_micros)
    share = lambda x: S.clamp(c(x) / float(max(n, 1)))
    have = lambda x, other: c(x) if x in source.columns else other
    shown_share = have("percent", F.lit(0.0)) / 100.0
    signals = {
        "NameMatch": share("in_name"), "PathMatch": share("in_path"), "TypeMatch": share("in_kind"),
        "ContentMatch": F.when(have("kind", F.lit("")).isin("Content", "Combined"), shown_share).otherwise(0.0),
        "SemanticMatch": F.when(have("analyzed", F.lit(False)), shown_share).otherwise(0.0),
        "created": have("created", c("modified")), "modified": c("modified"), "size": have("size_bytes", F.lit(None).cast("long")),
    }
    score = 100 * c("matched") + 55 * c("in_name") + 22 * c("in_path") + 18 * c("in_kind") + 80 * len(intent.floors) + 120 * len(scripts)
    return rows.withColumns({"match": score, "wish": S.preference(intent.directives, signals, now_micros)}).orderBy(F.desc("match"), F.desc("wish"), "orig_idx")


def _above(path_key: Column, itself: bool) -> Column:
    """The folders that a path lies in (and itself), as keys without a last separator: that of / is empty."""
    parts = F.split(path_key, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return every if itself else F.slice(every, F.lit(1), F.size(parts) - 1)


def outermost(roots: DataFrame) -> DataFrame:
    """root: the roots (whatever their case) that lie in no other, once each, as keys."""
    keys = roots.where("root IS NOT NULL").select(F.regexp_replace(F.lower("root"), "/+$", "").alias("root")).distinct()
    inner = keys.where("root <> ''").select("root", F.explode(_above(F.col("root"), False)).alias("above")).join(keys.select(F.col("root").alias("above")), "above", "left_semi")
    return keys.join(inner.select("root").distinct(), "root", "left_anti")


def in_any_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (path_key) that are a root of the table (root) or lie below one, once each.

    A path meets its own folders' names in a join, so the plan is the same for one root and for any number of them; as no
    root that counts lies in another, a path meets one at most.
    """
    near = rows.withColumn("_root", F.explode(_above(F.col("path_key"), True)))
    return near.join(outermost(roots).select(F.col("root").alias("_root")), "_root", "left_semi").drop("_root")


def unknown_count(source: DataFrame, attribute: Column) -> DataFrame:
    """One row: rows of source, those that surely hold, and those where nothing is known."""
    return source.agg(F.count("*").alias("total"), F.count_if(attribute).alias("holds"), F.count_if(attribute.isNull()).alias("unknown"))


def sort_results(results: DataFrame, mode: str) -> DataFrame:
    """Relevance (as they came), TopLevelPath, Name or Modified (newest first)."""
    order = {"Relevance": [F.col("orig_idx")], "TopLevelPath": [F.lower("top_level"), F.lower("name"), F.col("orig_idx")], "Name": [F.lower("name"), F.col("orig_idx")], "Modified": [F.desc("modified"), F.col("orig_idx")]}
    return results.orderBy(*order[mode])


def list_folder(files: DataFrame, folder: str, mode: str = "Name") -> DataFrame:
    """A folder's entries, folders first."""
    order = {"Name": [F.lower("name")], "Modified": [F.desc("modified"), F.lower("name")], "Type": [F.col("extension"), F.lower("name")], "Size": [F.desc(F.coalesce("size_bytes", F.lit(0))), F.lower("name")]}
    return files.where(F.col("directory_path") == folder).orderBy(F.desc("is_directory"), *order[mode], "full_path")


def round_robin(pending: DataFrame, budget: int, group: str, priority: str, key: str) -> DataFrame:
    """At most budget rows: every group's best first, then every group's second, groups by their best priority."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(priority), key))
    # no group can use more than the budget: Spark cuts each task's rows to that before it brings a group together
    rows = pending.withColumn("turn", turn).where(F.col("turn") <= budget).withColumn("best", F.max(priority).over(Window.partitionBy(group)))
    return rows.orderBy("turn", F.desc("best"), group).limit(budget)


def with_quota(pending: DataFrame, budget: int, explicit: Column, share: float, group: str, priority: str, key: str) -> DataFrame:
    """Explicit matches fill up to a share of the budget, the rest goes round the groups."""
    head = pending.where(explicit).orderBy(F.desc(priority), key).limit(int(budget * share))
    rest = pending.join(head.select(key), key, "left_anti")
    tail = round_robin(rest, budget, group, priority, key).drop("turn", "best")
    return head.withColumn("quota", F.lit(0)).unionByName(tail.withColumn("quota", F.lit(1))).orderBy("quota", F.desc(priority), key).limit(budget)


def pending(documents: DataFrame, index: DataFrame, versions: list[str]) -> DataFrame:
    """Documents without a current index row: none of the same path and versions."""
    return documents.join(index.select("path_key", *versions), ["path_key", *versions], "left_anti")


def split_reusable(scan: DataFrame, previous: DataFrame, versions: list[str], payload: str) -> DataFrame:
    """The scan with the payload of unchanged rows; null where it is to be made anew."""
    return scan.join(previous.select("path_key", *versions, payload), ["path_key", *versions], "left")


def without_recent_failures(work: DataFrame, attempts: DataFrame, now_micros: int, hours: int = 24, version: str = "version") -> DataFrame:
    """Work that hasn't failed, in this version, within the last hours. version: how work calls the column of attempts."""
    recent = attempts.where(F.col("attempted") > now_micros - hours * 3_600_000_000).select("path_key", F.col("version").alias(version)).distinct()
    return work.join(recent, ["path_key", version], "left_anti")


def usable(headers: DataFrame, version: int, now_micros: int, cap: int, minutes: int = 30) -> DataFrame:
    """Snapshots of this version, young enough, and complete or made under a larger cap. Where headers tell: the root hasn't
    changed since (root_modified is at most built), and no recognition of texts was put off (deferred is 0)."""
    rows = headers.where((F.col("format_version") == version) & (F.col("built") >= now_micros - minutes * 60_000_000) & (F.col("is_complete") | (F.col("cap") >= cap)))
    if "root_modified" in headers.columns:
        rows = rows.where(F.col("root_modified").isNull() | (F.col("root_modified") <= F.col("built")))
    if "deferred" in headers.columns:
        rows = rows.where(F.coalesce("deferred", F.lit(0)) == 0)
    return rows


def readiness(documents: DataFrame, index: DataFrame, versions: list[str]) -> DataFrame:
    """One row: documents, those with a current index row, those with a stale one, and those with none."""
    have = index.select("path_key", F.struct(*versions).alias("_v"))
    joined = documents.select("path_key", F.struct(*versions).alias("_now")).join(have, "path_key", "left")
    return joined.agg(F.count("*").alias("documents"), F.count_if(F.col("_v").isNotNull() & (F.col("_v") == F.col("_now"))).alias("current"), F.count_if(F.col("_v").isNotNull() & (F.col("_v") != F.col("_now"))).alias("stale"), F.count_if(F.col("_v").isNull()).alias("missing"))


def text_facts(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """path_key and the script profile of its text; null where no text is known."""
    known = documents.select("path_key", T.script_profile(F.col("text")).alias("profile"))
    return candidates.select("path_key").join(known, "path_key", "left")


def first_by_key(lists: list[DataFrame], key: str) -> DataFrame:
    """The union of ordered lists with each key (whatever its case) once: the first list's row wins."""
    rows = reduce(DataFrame.unionByName, (x.withColumn("lane", F.lit(i)) for i, x in enumerate(lists)))
    w = Window.partitionBy(F.lower(key)).orderBy("lane", key)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def all_present(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """One row: whether every wanted key is there."""
    return wanted.join(have.select(key).distinct(), key, "left_anti").agg((F.count("*") == 0).alias("all_present"))


def best_tags(tags: DataFrame, thresholds: dict[str, tuple[float, int]], key: str) -> DataFrame:
    """tags: key, name, category, confidence. The best of each category: over its threshold, at most so many."""
    w = Window.partitionBy(key, "category").orderBy(F.desc("confidence"), "name")
    keep = reduce(lambda a, b: a | b, ((F.col("category") == c) & (F.col("confidence") >= low) & (F.col("rank") <= most) for c, (low, most) in thresholds.items()))
    return tags.withColumn("rank", F.row_number().over(w)).where(keep)


def search_applications(catalog: DataFrame, terms: tuple[Term, ...], k: int) -> DataFrame:
    """catalog: app_id, name, source (a label; may be missing). app_id, name, score, percent, exact, best first.

    All of two terms or fewer must match, else two and 60 %; a term matches in the name with or without its gaps.
    """
    n = len(terms)
    need = n if n <= 2 else max(2, -(-n * 6 // 10))
    title, compact = T.normalized(F.col("name")), T.compact(F.col("name"))
    bare = lambda w: " ".join(re.findall(r"[^\W_]+", w.lower()))

    def inside(words: list[str]) -> Column:
        tests = [F.contains(title, F.lit(w)) | F.contains(compact, F.lit(w.replace(" ", ""))) for w in dict.fromkeys(map(bare, words)) if w]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    count = lambda tests: reduce(lambda a, b: a + b, (x.cast("int") for x in tests), F.lit(0))
    original = [inside([t.original]) for t in terms]
    rows = catalog.withColumns({"matched": count([o | inside(list(t.names)) for o, t in zip(original, terms, strict=True)]), "own": count(original)}).where(F.col("matched") >= need)
    phrase = bare(" ".join(t.original for t in terms))
    part, whole = F.contains(title, F.lit(phrase)) & F.lit(bool(phrase)), (title == phrase) & F.lit(bool(phrase))
    bonus = P.lookup(F.col("source"), fixed.SOURCE_BONUS, F.lit(fixed.OTHER_SOURCE_BONUS)) if "source" in catalog.columns else F.lit(fixed.OTHER_SOURCE_BONUS)
    score = 780 + 85 * F.col("matched") + 55 * F.col("own") + F.when(part, 110).otherwise(0) + F.when(whole, 80).otherwise(0) + bonus
    rows = rows.withColumns({"score": score.cast("double"), "percent": F.when(whole, 100.0).when(part, 98.0).otherwise(92.0), "exact": whole})
    return rows.orderBy(F.desc("score"), F.lower("name"), "app_id").limit(k)


#: Scores that applications reach in a list of results: a file whose name has the word is never displaced.
MOST_APPLICATION_SCORE = 820.0


def application_rows(found: DataFrame) -> DataFrame:
    """Applications as result rows."""
    return found.select("app_id", "name", F.least(F.col("score"), F.lit(MOST_APPLICATION_SCORE)).alias("score"), "percent", F.lit("Application").alias("kind"))


def title_rows(found: DataFrame) -> DataFrame:
    """Title hits as result rows."""
    return found.select("file_id", "score", "percent", F.when(F.col("exact"), "ExactName").otherwise("NameCandidate").alias("kind"))


def quick_rows(candidates: DataFrame, total_terms: int) -> DataFrame:
    """Rows of the metadata lane as results that are shown before the other lanes have ended: kind and percent."""
    c, n = F.col, float(max(total_terms, 1))
    share = lambda x: S.clamp(c(x) / n) if total_terms > 0 else F.lit(0.5)
    kind = evidence_of(total_terms)
    percent = F.when(c("kind") == "ExactName", 99.0).when(c("kind") == "NameCandidate", F.round(62.0 + 24.0 * share("name_matches"))).when(c("kind") == "Metadata", F.round(58.0 + 26.0 * share("matched"))).otherwise(45.0)
    return candidates.withColumn("kind", kind).withColumn("percent", percent)


def evidence_of(total_terms: int) -> Column:
    """The kind of a metadata row: all terms in the name, some, in the type's meaning, or in the path."""
    c = F.col
    return F.when(c("name_matches") >= max(1, total_terms), "ExactName").when(c("name_matches") > 0, "NameCandidate").when(c("type_matches") > 0, "Metadata").otherwise("Path")


def application_catalogue(sources: list[DataFrame]) -> DataFrame:
    """Applications of several lists (desktop, start menu, registry: name, full_path, source, is_directory, modified) as one: of
    rows with one path the first list's, with an id."""
    rows = first_by_key(sources, "full_path").drop("lane")
    return rows.withColumn("app_id", F.xxhash64(F.lower("full_path")))


# ---- folders and roots ----
def child_folders(files: DataFrame, folder: str) -> DataFrame:
    """A folder's own folders, by name."""
    return files.where((F.col("directory_path") == folder) & F.col("is_directory")).orderBy(F.lower("name"), "full_path")


def parents(files: DataFrame) -> DataFrame:
    """Each folder that holds something, and the folder it is in."""
    return files.select("directory_path", P.directory(F.col("directory_path")).alias("parent")).distinct()


def folder_sizes(files: DataFrame) -> DataFrame:
    """Bytes, entries and folders of each folder, and (null) of all."""
    return files.rollup("directory_path").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("n"), F.sum(F.col("is_directory").cast("long")).alias("folders"))


def with_total(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """The rows that are shown, and how many there are in all."""
    return shown.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def scope_roots(scope: str, current: str | None, drives: list[str], network: list[str], favourites: list[str]) -> list[str]:
    """The roots of a search. scope: Folder, Drive, FolderAndNetwork or Everywhere; none without a current folder, but for the last."""
    if scope == "Everywhere":
        found = [*drives, *network, *favourites]
    elif not current:
        found = []
    elif scope == "Drive":
        found = [next((d for d in drives if current.lower().startswith(d.lower())), current)]
    else:
        found = [current, *(network if scope == "FolderAndNetwork" else [])]
    return once(r for r in found if r.strip())


def title_root_order(roots: list[str], current: str | None) -> list[str]:
    """The current folder, then network shares, then others."""
    return sorted(once(r for r in roots if r.strip()), key=lambda r: 0 if current and r.lower() == current.lower() else 1 if r.startswith((r"\\\\", "//")) else 2)


# ---- work that waits ----
def pending_order(waiting: DataFrame, k: int, home: str | None = None, query_priority: Column | None = None) -> DataFrame:
    """Documents that a pass embeds: wanted by the query, in the user's folders, with text, newest."""
    first = [] if query_priority is None else [query_priority.desc()]
    return waiting.orderBy(*first, P.path_priority(F.col("directory_path"), home).desc(), F.col("has_text").desc(), F.desc("modified"), "path_key").limit(k)


def preferred_sheets(files: DataFrame, k: int, scores: DataFrame | None = None, home: str | None = None) -> DataFrame:
    """Spreadsheets that are read first: those that the query scores (file_id, score), in the user's folders, newest."""
    rows = files.where(~F.col("is_directory") & F.col("extension").isin(*fixed.SHEETS))
    rows = rows.withColumn("score", F.lit(None).cast("double")) if scores is None else rows.join(scores.select("file_id", "score"), "file_id", "left")
    return rows.orderBy(F.col("score").isNotNull().desc(), F.coalesce("score", F.lit(0.0)).desc(), P.path_priority(F.col("directory_path"), home).desc(), F.desc("modified"), "file_id").limit(k)


def semantic_documents(files: DataFrame, documents: DataFrame, root: str, most: int, scores: DataFrame | None = None, home: str | None = None) -> DataFrame:
    """path_key, text, described: a document's own text, or the descriptor of a file that has none, for the best of such files.

    documents: path_key, text, the first of a path in the order of text counts. scores: file_id, matched, score of what a query wants.
    """
    read = documents.where(F.trim("text") != "").where(P.in_root(F.col("path_key"), root)).groupBy("path_key").agg(F.min("text").alias("text"))
    own = files.withColumn("path_key", F.lower("full_path")).where(~F.col("is_directory") & P.in_root(F.col("path_key"), root)).join(read.select("path_key"), "path_key", "left_anti")
    own = own.withColumns({"matched": F.lit(None).cast("int"), "score": F.lit(None).cast("double")}) if scores is None else own.join(scores.select("file_id", F.col("matched").cast("int").alias("matched"), "score"), "file_id", "left")
    by = [F.col("score").isNotNull().desc(), F.coalesce("matched", F.lit(0)).desc(), F.coalesce("score", F.lit(0.0)).desc(), P.path_priority(F.col("directory_path"), home).desc(), F.desc("modified"), F.col("path_key")]
    place = F.row_number().over(Window.orderBy(*by))
    cut = own.orderBy(*by).limit(most).withColumn("place", place)  # most rows
    room = read.agg(F.greatest(F.lit(0), F.lit(most) - F.count("*")).alias("room"))
    text = P.descriptor(F.col("name"), F.col("directory_path"), F.col("extension"), root)
    made = cut.crossJoin(F.broadcast(room)).where(F.col("place") <= F.col("room")).select("path_key", text.alias("text"), F.lit(True).alias("described"))
    return read.select("path_key", "text", F.lit(False).alias("described")).unionByName(made)


def embedding_passage(documents: DataFrame, root: str) -> DataFrame:
    """documents: path_key, name, directory_path, extension, text. path_key, passage: what a text model is given."""
    c = F.col
    lines = F.concat_ws("\n", F.concat(F.lit("파일명: "), c("name")), F.concat(F.lit("폴더: "), P.relative(c("directory_path"), root)), F.concat(F.lit("형식: "), P.format_description(c("extension"))), F.concat(F.lit("내용: "), T.sample_parts(F.coalesce("text", F.lit("")), 420)))
    return documents.select("path_key", lines.alias("passage"))


def rerank_passage(found: DataFrame) -> DataFrame:
    """found: path_key, name, directory_path, extension, is_directory, reason, text. path_key, passage: what a result is judged by."""
    c = F.col
    lines = F.concat_ws("\n", F.concat(F.lit("파일명: "), c("name")), F.concat(F.lit("경로: "), c("directory_path")), F.concat(F.lit("파일 형식: "), P.type_display(c("extension"), c("is_directory"))), F.concat(F.lit("기존 검색 근거: "), c("reason")), F.concat(F.lit("본문: "), T.sample_ends(F.coalesce("text", F.lit("")), 1800)))
    return found.select("path_key", lines.alias("passage"))


def result_text_facts(candidates: DataFrame, documents: DataFrame, extract: DataFrame | None = None, most: int = 0) -> DataFrame:
    """path_key, known, profile of each candidate: from the indexed texts, or from at most so many texts made on demand.

    extract: path_key and text of files that can be read now; a null text stays unknown.
    """
    wanted = candidates.select("path_key").distinct()
    have = documents.groupBy("path_key").agg(F.min("text").alias("text"))
    facts = wanted.join(have, "path_key")
    if extract is not None and most > 0:
        made = extract.select("path_key", "text").join(wanted, "path_key", "left_semi").join(have.select("path_key"), "path_key", "left_anti")
        facts = facts.unionByName(made.orderBy("path_key").limit(most))
    profile = T.script_profile(F.col("text"))
    return wanted.join(facts.select("path_key", profile.alias("profile")), "path_key", "left").select("path_key", F.col("profile").isNotNull().alias("known"), "profile")


# ---- tags of images ----
def tag_labels(spark: SparkSession, path: str) -> DataFrame:
    """place, name, category of a tagger's quoted CSV (tag_id, name, category, count); rows without a number for a category are left out."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', schema="tag_id string, name string, category string, count string")
    number = F.expr("try_cast(category AS int)")
    kind = reduce(lambda c, kv: c.when(number == kv[0], F.lit(kv[1])), fixed.TAG_CATEGORIES.items(), F).otherwise("General")
    return rows.where(number.isNotNull() & F.col("count").isNotNull()).select("tag_id", F.trim("name").alias("name"), kind.alias("category"))


def matching_tag(tags: DataFrame, aliases: list[str], key: str, character: bool = True) -> DataFrame:
    """tags: key, name, category, confidence. Of each key, the surest tag (of a character, or of another kind) that is one of the aliases."""
    wanted = sorted({t for a in aliases for t in visual.tag_terms(a) if len(t) >= 3})
    if not wanted:
        return tags.limit(0).select(key, "name", "confidence")
    kind = F.col("category") == "Character"
    hit = F.arrays_overlap(T.tag_terms(F.col("name")), F.array(*map(F.lit, wanted)))
    best = tags.where((kind if character else ~kind) & hit).groupBy(key).agg(F.max(F.struct("confidence", "name")).alias("b"))
    return best.select(key, F.col("b.name").alias("name"), F.col("b.confidence").alias("confidence"))


def tagger_gate(anime: Column, office: Column) -> Column:
    """Whether an image is worth the tagger: drawn rather than of an office. Similarities of its best region."""
    return (anime >= 0.06) & (anime - office >= 0.015)


def diagnostics(found: DataFrame) -> DataFrame:
    """One row: how many results there are of each evidence."""
    has = lambda k: F.count_if(F.array_contains("evidence", k))
    return found.agg(F.count("*").alias("results"), *(has(k).alias(a) for k, a in (("ExactName", "exact_names"), ("Content", "contents"), ("Combined", "combined"), ("SemanticCandidate", "semantic"), ("VisualCandidate", "visual"))))
