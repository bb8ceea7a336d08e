"""One search over an index: the sentence, the lanes it needs, their merging, and what is shown."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import scores as S
from .functions import text as T
from .operators import content, fusion, metadata, results, titles
from .operators import vectors as VO
from .plans import fixed, visual
from .plans.intent import Intent, classify, compile_intent, is_exact_lookup, lanes, needs_targeted_scan, once, references_previous, sort_mode, wants_applications
from .sources.content_index import ContentIndex
from .sources.shared import cut
from .sources.title_index import TitleIndex

#: Rows that the content, vector and title lanes pass on, distinct words of a query that a text model is given.
CONTENT_MOST, VECTOR_MOST, TITLE_MOST, QUERY_TERMS = 2000, 240, 3000, 12
#: Roots that are tested one by one; more are joined.
FEW_ROOTS = 16


def micros(moment: datetime) -> int:
    """A local moment (without a zone: UTC) as microseconds since 1970 UTC."""
    return int(moment.replace(tzinfo=moment.tzinfo or UTC).timestamp() * 1_000_000)


def quoted(words: dict[str, Column]) -> Column:
    """Of the words whose test holds: ‘a’, ‘b’."""
    return F.array_join(F.filter(F.array(*(F.when(test, F.lit(f"‘{w}’")) for w, test in words.items())), lambda x: x.isNotNull()), ", ") if words else F.lit("")


def embedding_query(intent: Intent) -> str:
    """What a text model is given for a query."""
    words = once(t.original for t in intent.terms if t.original.strip())[:QUERY_TERMS]
    return f"{intent.query}\n핵심 검색 의도: {', '.join(words)}" if words else intent.query


@dataclass
class Engine:
    """files: schema.FILE_RECORD. documents: path_key, text (source, was_truncated, analyzed_pages). vectors: path_key, modified,
    quantized. images: path_key, modified, regions, and tags (name, category, confidence). extract: path_key, text of files that
    can be read on demand. home: the user's own folder. Files that several roots hold count once.
    title_index, content_index: indexes of the files and of the documents (doc_key: path_key). With the first, files is None and
    the index's live rows are the files; with the second, documents is None and no text is read but of candidates.

    embed and embed_prompt give a query's vectors; without them the vector lanes are left out. All tables are DataFrames and a
    search is lazy. Lanes are cut to their bounds (5,000 rows at most) and persisted: they are read more than once while merging,
    and the merging is planned without their long expressions.
    """

    files: DataFrame | None
    documents: DataFrame | None = None
    vectors: DataFrame | None = None
    images: DataFrame | None = None
    applications: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    embed_prompt: Callable[[str], list[list[float]]] | None = None
    least_similarity: float = VO.LEAST
    _kept: list[DataFrame] = field(default_factory=list, repr=False)

    extract: DataFrame | None = None
    home: str | None = None
    title_index: TitleIndex | None = None
    content_index: ContentIndex | None = None

    def keyed(self) -> DataFrame:
        """The files, each path once whatever its case: of several rows the newest. An index holds each path once."""
        if self.files is None and self.title_index is not None:
            return self.title_index.rows()
        own = self.files.withColumn("path_key", F.lower("full_path"))
        rest = F.struct("modified", *(c for c in own.columns if c not in ("path_key", "modified")))
        return own.groupBy("path_key").agg(F.max(rest).alias("_r")).select("path_key", "_r.*")

    def search(self, query: str, now: datetime, k: int = 500, roots: list[str] | None = None) -> DataFrame:
        """name, full_path, kind, percent, badge, reason, display_score, modified, best first. An empty wish gives no rows."""
        return self.run(compile_intent(query, now), now, k, roots)

    def run(self, intent: Intent, now: datetime, k: int = 500, roots: list[str] | None = None) -> DataFrame:
        files = self.keyed()
        if not intent.has_criteria:
            files = files.where(F.lit(False))
        if roots and len(roots) > FEW_ROOTS:
            files = results.in_any_root(files, files.sparkSession.createDataFrame([(r,) for r in roots], "root string"))
        elif roots:
            files = files.where(_in_roots(roots))
        plan, parts = lanes(intent, self.embed is not None or self.embed_prompt is not None), []
        parts.append(self._metadata(intent, files, now, k))
        if plan.content and self._indexed(intent, len(roots or ()) <= FEW_ROOTS):
            parts.append(self._content_by_index(intent, files, now, k, _in_roots(roots, "doc_key")))
        elif plan.content and (docs := self._documents()) is not None:
            parts.append(self._content(intent, docs, files, now, k))
        if plan.semantic and self.vectors is not None and self.embed is not None:
            near = self._semantic(intent, files, now, k, plan.precision_first)
            lexical = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            strong = (F.col("evidence") == "ExactName") | ((F.col("lane") == 1) & (F.col("coverage") >= 0.99))
            parts.append(fusion.without_unsupported(near, lexical, strong) if plan.precision_first else near)
        if plan.visual and self.images is not None and self.embed_prompt is not None:
            parts.append(self._visual(intent, files, now, k))
        # rows of files that are gone drop out before the cut
        own = files.select("path_key", "name", "full_path", "is_directory", "extension")
        merged = fusion.merge(parts).join(own, "path_key")
        ordered = fusion.order(merged, k, intent.directives, micros(now), visual_query=plan.visual and classify(intent) == "Visual")
        label = S.badge(F.col("kind"), F.col("percent"), F.lit(False))
        return ordered.select("path_key", "name", "full_path", "is_directory", "kind", "percent", label.alias("badge"), S.display_reason(F.col("reasons")).alias("reason"), "display_score", "created", "modified", "size_bytes")

    def _lane(self, rows: DataFrame, number: int, most: int, evidence: Column, keep: Column | None = None, by: tuple[str, ...] = ("score", "modified"), **columns: Column) -> DataFrame:
        """A lane's rows in its own order: by, largest first, then name. keep: a later filter, after which the places aren't
        counted anew."""
        best = fusion.ranked(rows, [*(F.desc_nulls_last(c) for c in by), F.lower("name"), F.col("path_key")], most)
        best = best if keep is None else best.where(keep)
        out = fusion.lane(best.select(*best.columns, F.lit(number).alias("lane"), evidence.alias("evidence"), *(v.alias(n) for n, v in columns.items())))
        self._kept.append(out.persist())
        return out

    def _range(self, intent: Intent) -> tuple[int | None, int | None]:
        """Days are the user's: a zone of now, if it has one, is that of the range."""
        return tuple(None if d is None else micros(d) for d in (intent.modified_from, intent.modified_to))

    def _placed(self, intent: Intent) -> Column | None:
        """What the content and vector lanes ask of a file beside their own search: its floor."""
        return T.has_all_floors(F.concat_ws(" ", "name", "directory_path"), intent.floors) if intent.floors else None

    def _metadata(self, intent: Intent, files: DataFrame, now: datetime, k: int) -> DataFrame:
        own = files.withColumn("file_id", F.col("path_key"))
        found = metadata.search(own, intent, max(k, 12 * k), micros(now), *self._range(intent)).withColumnRenamed("file_id", "path_key")
        place = F.row_number().over(fusion.by_place([F.desc("ranking_score"), F.col("path_key")])) - 1  # metadata.MOST rows at most
        found = found.withColumn("lane_rank", place).join(files.select("path_key", "name", "directory_path", "extension", "is_directory", "created", "modified", "size_bytes"), "path_key")
        n = len(intent.all_terms)
        words = {t.original: T.has_word(T.normalized(F.col("name")), t.original) | F.contains(F.lower("name"), F.lit(t.original)) for t in intent.all_terms}
        placed = {t.original: F.contains(F.lower("directory_path"), F.lit(t.original)) for t in intent.all_terms}
        shown = [F.when(~F.col("is_directory"), F.concat(F.upper("extension") if intent.extensions else P.category_label(P.category(F.col("extension"))), F.lit(" 형식"))) if intent.extensions or intent.categories else F.lit(None)]
        shown += [F.when(reason != "", F.concat(F.lit(f"{label}: "), reason)) for label, reason in (("파일명", quoted(words)), ("경로", quoted(placed)))]
        shown += [F.lit(text) for text, test in (("요청한 수정 시기", intent.modified_from or intent.modified_to), ("폴더", intent.folders_only)) if test]
        joined = F.concat_ws(" · ", *shown)
        reason = F.when(joined == "", "검색 조건과 일치합니다.").otherwise(F.concat(joined, F.lit("과 일치합니다.")))
        out = fusion.lane(found.select("path_key", "lane_rank", "score", "name_matches", "path_matches", "type_matches", "created", "modified", "size_bytes", F.lit(0).alias("lane"), results.evidence_of(n).alias("evidence"), F.lit(n).alias("total_terms"), reason.alias("reason")))
        self._kept.append(out.persist())
        return out

    def _documents(self) -> DataFrame | None:
        """The texts, where no index can answer: path_key, text."""
        if self.documents is None and self.content_index is not None:
            return self.content_index.documents().select(F.col("doc_key").alias("path_key"), "text")
        return self.documents

    def _indexed(self, intent: Intent, few: bool) -> bool:
        """Whether the index of texts answers: it knows words, not scripts, and tests few roots."""
        return self.content_index is not None and bool(intent.terms) and not intent.predicates and few

    def _content_by_index(self, intent: Intent, files: DataFrame, now: datetime, k: int, within: Column | None) -> DataFrame:
        """The content lane through the index of texts: its statistics are those of all its documents."""
        where = metadata.hard_filters(intent, F.col("modified"), *self._range(intent))
        found = cut(self.content_index.search(intent.terms, min(CONTENT_MOST, 6 * k), where if within is None else where & within, addresses=True))  # CONTENT_MOST rows at most
        found = found.withColumnRenamed("doc_key", "path_key").join(self.content_index.texts_at(found), ["chunk", "place"])
        own = files.select("path_key", "name", "directory_path", "extension", "is_directory", "created", "modified", "size_bytes")
        return self._by_text(intent, found.join(own, "path_key"), F.lit("PlainText"))

    def _content(self, intent: Intent, given: DataFrame, files: DataFrame, now: datetime, k: int) -> DataFrame:
        own = files.select("path_key", "name", "directory_path", "extension", "is_directory", "created", "modified", "size_bytes")
        extra = [c for c in ("source", "was_truncated", "analyzed_pages") if c in given.columns]
        first = given.groupBy("path_key").agg(F.min(F.struct("text", *extra)).alias("_d")).select("path_key", "_d.*")
        docs = first.join(own, "path_key")
        where = metadata.hard_filters(intent, F.col("modified"), *self._range(intent))
        scripts = metadata.script_tests(intent.predicates, F.col("name"), F.col("directory_path"), F.col("is_directory"), T.script_profile(F.col("text")))
        for test in scripts:
            where = where & F.coalesce(test, F.lit(False))
        kind = F.col("source") if "source" in extra else F.lit("PlainText")
        if intent.terms:
            found = content.search(docs, intent.terms, min(CONTENT_MOST, 6 * k), "path_key", "text", F.col("name"), F.col("directory_path"), where, F.col("modified"))
            return self._by_text(intent, found.join(docs, "path_key"), kind)
        # script predicates alone
        found = docs.where(where).withColumns({"score": F.lit(380.0 + 80.0 * len(scripts)), "coverage": F.lit(1.0)})
        found = found.orderBy("path_key").limit(min(CONTENT_MOST, 6 * k)).withColumn("score", F.col("score") + 340.0)
        reason = F.concat(F.when(kind == "Spreadsheet", "엑셀 시트·셀").otherwise("파일 본문"), F.lit("에서 조건을 확인했습니다."))
        return self._lane(found.withColumn("reason", reason), 1, CONTENT_MOST, F.lit("Content"), self._placed(intent), total_terms=F.lit(1))

    def _by_text(self, intent: Intent, found: DataFrame, kind: Column) -> DataFrame:
        """The lane of rows that the content search has found, with their texts and their files' columns."""
        words = {t.original: content.contains_any(F.lower("text"), t.texts) for t in intent.terms}
        near = F.when(F.col("coherence") >= 0.75, " 같은 문맥에서 함께 나타납니다.").otherwise(" 관련 단서를 확인했습니다.")
        both = F.when(F.col("matched") > F.col("in_text"), " 파일명·폴더 단서와 함께 일치합니다.").otherwise("")
        reason = F.when(kind == "Spreadsheet", F.concat(F.lit("엑셀 시트·셀에서 "), quoted(words), F.lit(" 내용을 확인했습니다."), both)).otherwise(F.concat(F.lit("파일 본문에서 "), quoted(words), F.lit("가"), near, both))
        found = found.withColumn("score", F.col("score") + 340.0).withColumn("reason", reason)
        evidence = F.when(F.col("matched") > F.col("in_text"), "Combined").otherwise("Content")
        return self._lane(found, 1, CONTENT_MOST, evidence, self._placed(intent), total_terms=F.lit(len(intent.terms)))

    def _semantic(self, intent: Intent, files: DataFrame, now: datetime, k: int, precise: bool) -> DataFrame:
        own = files.where(metadata.hard_filters(intent, F.col("modified"), *self._range(intent)))
        current = self.vectors.join(own.select("path_key", "modified"), ["path_key", "modified"], "left_semi")
        found = VO.semantic_search(current, self.embed(embedding_query(intent)), min(k, VECTOR_MOST), self.least_similarity, key="path_key")
        above = F.greatest(F.lit(0.0), F.col("similarity") - self.least_similarity)
        found = found.withColumn("score", 18.0 + 80.0 * above if precise else 90.0 + 260.0 * above).join(files, "path_key")
        found = found.withColumn("reason", F.lit("Multilingual E5가 의미가 가까운 것으로 판단했습니다."))
        return self._lane(found, 2, VECTOR_MOST, F.lit("SemanticCandidate"), self._placed(intent), ("similarity", "modified"), semantic=F.col("similarity"), total_terms=F.lit(len(intent.terms)))

    def _visual(self, intent: Intent, files: DataFrame, now: datetime, k: int) -> DataFrame:
        own = files.where(metadata.hard_filters(intent, F.col("modified"), *self._range(intent)))
        current = self.images.join(own.select("path_key", "modified", "name", "directory_path"), ["path_key", "modified"])
        wanted, names = visual.profile(intent), visual.identity_aliases(intent)
        by = lambda c: content.contains_any(F.lower(c), tuple(names)) if names else F.lit(False)
        sure = tag = F.lit(0.0)
        if "tags" in current.columns:
            tags = current.select("path_key", F.explode("tags").alias("t")).select("path_key", "t.*")
            for character, words, column in ((True, names, "_character"), (False, visual.tag_aliases(intent), "_general")):
                best = results.matching_tag(tags, words, "path_key", character).select("path_key", F.col("confidence").alias(column))
                current = current.join(best, "path_key", "left")
            sure, tag = F.coalesce("_character", F.lit(0.0)), F.coalesce("_general", F.lit(0.0))
        corroboration = F.when(by("name"), 240.0).when(sure > 0, 220.0 + 120.0 * sure).when(by("directory_path"), 110.0).otherwise(0.0)
        vectors = [v for text in visual.prompts(intent.query, wanted) for v in self.embed_prompt(text)]
        one = lambda text: next(iter(self.embed_prompt(text)), None)
        interface = one(fixed.INTERFACE_PROMPT) if wanted.suppresses_interfaces else None
        character = one(fixed.CHARACTER_PROMPT) if wanted.named else None
        found = VO.visual_search(current, vectors, min(k, 500), wanted.least, wanted.distance, wanted.named, corroboration, tag, "path_key", wanted, interface, character)
        found = found.join(files, "path_key").withColumn("reason", F.lit("SigLIP 2 시각 AI가 이미지와 검색 문장의 의미가 관련된 것으로 판단했습니다."))
        return self._lane(found, 3, 500, F.lit("VisualCandidate"), self._placed(intent), ("score", "similarity", "modified"), visual=F.col("similarity"), total_terms=F.lit(len(intent.terms)))

    def release(self) -> None:
        """Let go of the lanes of earlier searches."""
        while self._kept:
            self._kept.pop().unpersist()

    def titles(self, query: str, k: int = 750, sort: str = "name", descending: bool = False, **options) -> DataFrame:
        """Matches while one types; options as in titles.matcher. An index of the titles tells which files to read."""
        if self.title_index is not None:
            return self.title_index.search(query, k, sort, descending, **options)
        return titles.search(self.keyed(), titles.matcher(query, **options), k, sort, descending)

    def title_hits(self, intent: Intent, now: datetime, k: int = TITLE_MOST, live: DataFrame | None = None) -> DataFrame:
        """path_key, score, percent of the title ladder. live: the current folder's own records, which count for more."""
        bounds = (k, micros(now), *self._range(intent))
        found = titles.ladder(self.keyed().withColumn("file_id", F.col("path_key")), intent, *bounds).withColumnRenamed("file_id", "path_key")
        if live is None:
            return found
        seen = titles.ladder(live.withColumn("file_id", F.lower("full_path")), intent, *bounds).withColumnRenamed("file_id", "path_key")
        return titles.live_hits(found, seen).orderBy(F.desc("score"), F.desc("percent"), "path_key").limit(k)

    def stages(self, query: str, now: datetime, k: int = 500) -> Iterator[tuple[str, DataFrame]]:
        """A search in steps, each a lazy table: titles and applications at once, then words, then vectors."""
        intent = compile_intent(query, now)
        if intent.has_criteria:
            yield "titles", self.title_hits(intent, now, k)
            if self.applications is not None and intent.all_terms and wants_applications(intent):
                yield "applications", results.application_rows(results.search_applications(self.applications, intent.all_terms, 120))
        if is_exact_lookup(intent):
            return
        yield "words", Engine(self.files, self.documents, title_index=self.title_index, content_index=self.content_index).run(intent, now, k)
        if self.vectors is not None or self.images is not None:
            yield "vectors", self.run(intent, now, k)

    def targeted(self, intent: Intent, scanned: DataFrame, now: datetime, k: int = 500) -> DataFrame | None:
        """The best of a fresh scan, where the index's candidates aren't enough; None where they are. The metadata score, the
        bound of rows kept, and for types alone no order but a limit."""
        found = metadata.search(self.keyed().withColumn("file_id", F.col("path_key")), intent, k, micros(now), *self._range(intent))
        n = len(intent.all_terms)
        counts = found.agg(F.count("*").alias("found"), F.count_if(F.col("matched") == n).alias("complete")).first()
        if not needs_targeted_scan(intent, counts["found"], counts["complete"], k):
            return None
        rows = scanned.withColumn("file_id", F.lower("full_path"))
        if not intent.terms and not intent.directives and not intent.literal_terms:  # a type: the first k that fit end the scan
            return rows.where(metadata.hard_filters(intent, F.col("modified"), *self._range(intent))).limit(k)
        return metadata.search(rows, intent, min(metadata.MOST, max(k, 12 * k)), micros(now), *self._range(intent))

    def facts(self, found: DataFrame, most: int = 0) -> DataFrame:
        """path_key, known, profile of the rows of a result."""
        docs = self._documents()
        if docs is None:
            none = found.select("path_key").withColumn("text", F.lit(None).cast("string"))
            return results.result_text_facts(found, none.limit(0), self.extract, most)
        return results.result_text_facts(found, docs, self.extract, most)

    def refine(self, found: DataFrame, query: str, now: datetime, most: int = 0) -> DataFrame:
        """A later sentence within a result, in the result's order among equals. The first result isn't changed, and a sentence
        without any condition gives it back. most: texts that are made on demand where a predicate is on texts."""
        intent = compile_intent(query, now)
        if not intent.has_criteria:
            return found
        place = F.row_number().over(fusion.by_place([F.desc("display_score"), F.col("path_key")]))  # one result's rows
        rows = found.withColumns({"orig_idx": place, "extension": F.when(F.col("is_directory"), "").otherwise(P.extension(F.col("name"))), "directory_path": P.directory(F.col("full_path"))})
        profile = None
        if intent.reads_content:
            rows = rows.join(self.facts(found, most).select("path_key", "profile"), "path_key", "left")
            profile = F.col("profile")
        out = results.refine(rows, intent, micros(now), *self._range(intent), profile)
        newest = {"ModifiedNewest": F.desc("modified"), "ModifiedOldest": F.asc("modified"), "CreatedNewest": F.desc("created"), "CreatedOldest": F.asc("created"), "LargeFirst": F.desc("size_bytes"), "SmallFirst": F.asc("size_bytes")}
        by = newest.get(sort_mode(intent)) if not intent.all_terms else None
        return out if by is None else out.orderBy(by, "orig_idx")

    def ask(self, query: str, now: datetime, previous: DataFrame | None = None, k: int = 500) -> DataFrame:
        """A search, or a refinement where the sentence speaks of the last result."""
        return self.refine(previous, query, now) if previous is not None and references_previous(query) else self.search(query, now, k)


def _in_roots(roots: list[str] | None, key: str = "path_key") -> Column | None:
    """A prefix test of the stored key for each root; they are FEW_ROOTS at most."""
    if not roots:
        return None
    test = F.lit(False)
    for r in roots:
        test = test | P.in_root(F.col(key), r)
    return test
