"""An index of texts by trigrams: which documents may hold a query's words, and how good they can be at best.

Terms match anywhere inside a text, also inside its words, so the index is one of trigrams of lower-case characters. Documents
lie in chunks; of each trigram and chunk it keeps the documents' places and a block maximum (the most occurrences of the
trigram in one of them). Of a part (a batch of documents) it keeps the number and total length of its documents, and, once
some query has needed it, how many of its documents hold a term: such counts are added up, and made anew only for parts
whose documents have changed since.
A search has three steps. Trigrams tell the candidates and, with the block maxima and what is known of a document without
its text (length, name, folder), a bound of its score. The texts of the most promising candidates are read and scored; the k-th
score is a floor. Of the rest only those whose bound reaches the floor are read. Rows are those of a scan of all texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import content
from ..plans.intent import Term
from .chunks import CHUNK, DEAD, alive, bitmaps, bucket_of, has_bit, in_groups, next_chunk, number_of, numbered, read_parts
from .log import Log, live
from .shared import cut

#: Documents of a chunk, chunks of a folder of texts, buckets of trigrams, bytes of a group of rows that is read as one.
DOCS, CHUNKS_EACH, BUCKETS, ROW_GROUP = 1024, 64, 256, 4 << 20
#: Folders that are named one by one when texts are read. Candidates whose texts are read first, for each one wanted.
MOST_NAMED, AHEAD = 10_000, 4
#: A document's own columns, all but its text.
OWN = "doc_key string, name string, directory_path string, modified long"
TEXTS = f"{OWN}, text string, length long, chunk long, place int, grp long"
GRAMS = "gram string, chunk long, n long, places binary, most int, bucket int"
STATS, DF = "n_docs long, total long", "part string, version long, term string, df long"


def grams_of(word: str) -> list[str]:
    """The distinct trigrams of a word of three characters or more."""
    return sorted({word[i : i + 3] for i in range(len(word) - 2)})


def term_key(words: tuple[str, ...]) -> str:
    return hashlib.sha256("\0".join(sorted({w.lower() for w in words})).encode()).hexdigest()[:32]


def trigrams(rows: DataFrame) -> DataFrame:
    """chunk, place, lower (text) to gram, chunk, n, places (16-bit, in order), most: rows of a chunk may give several rows."""
    names = ["gram", "chunk", "n", "places", "most"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            for start, end in _runs(chunks):
                yield from of_chunk(int(chunks[start]), batch.column("place").to_pylist()[start:end], batch.column("lower").slice(start, end - start))

    def of_chunk(chunk: int, places: list[int], texts: pa.Array) -> Iterator[pa.RecordBatch]:
        keys, where, many, held = [], [], [], 0
        for place, text in zip(places, texts, strict=True):
            c = np.frombuffer(((text.as_py() or "") + "\0\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            key, n = np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)
            keys.append(key)
            where.append(np.full(len(key), place, np.uint16))
            many.append(n)
            held += len(key)
            if held > 1 << 21:
                yield rows_of(chunk, keys, where, many)
                keys, where, many, held = [], [], [], 0
        if held:
            yield rows_of(chunk, keys, where, many)

    def rows_of(chunk: int, keys: list, where: list, many: list) -> pa.RecordBatch:
        key, place, n = map(np.concatenate, (keys, where, many))
        order = np.argsort(key, kind="stable")
        key, place, n = key[order], place[order], n[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        edges = np.append(starts, len(key))
        distinct = key[starts]
        text = np.stack([distinct >> 42, (distinct >> 21) & 0x1FFFFF, distinct & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        packed = place.astype("<u2").tobytes()
        lists = [packed[2 * a : 2 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        most = np.minimum(np.maximum.reduceat(n, starts), T.MOST_OCCURRENCES).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string()), pa.array(np.full(len(starts), chunk)), pa.array(np.diff(edges)), pa.array(lists, pa.binary()), pa.array(most)], names)

    return rows.mapInArrow(read, "gram string, chunk long, n long, places binary, most int")


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
    yield from (pair for pair in zip(edges[:-1], edges[1:], strict=True) if pair[0] < pair[1])


def may_hold(postings: DataFrame, terms: list[list[str]]) -> DataFrame:
    """gram, chunk, places, most of the terms' trigrams to chunk, place, caps: of each document that may hold a term, the most
    occurrences of each term (0: none). terms: the words of each, small letters."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a chunk come together."""
        now, have = None, {}
        for batch in batches:
            for gram, chunk, raw, most in zip(*(batch.column(c).to_pylist() for c in ("gram", "chunk", "places", "most")), strict=True):
                if chunk != now and have:
                    yield out(now, have)
                    have = {}
                now = chunk
                places = np.frombuffer(raw, "<u2")
                if gram in have:
                    have[gram] = (np.union1d(have[gram][0], places), max(have[gram][1], most))
                else:
                    have[gram] = (places, most)
        if have:
            yield out(now, have)

    def out(chunk: int, have: dict[str, tuple[np.ndarray, int]]) -> pa.RecordBatch:
        caps = np.zeros((CHUNK, len(terms)), np.int32)
        for i, words in enumerate(terms):
            for w in words:
                if len(w) < 3:
                    for gram, (places, _) in have.items():
                        if gram.startswith(w):
                            caps[places, i] = T.MOST_OCCURRENCES
                    continue
                grams = grams_of(w)
                if all(g in have for g in grams):  # from the rarest on
                    found = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted((have[g][0] for g in grams), key=len))
                    caps[found, i] = np.maximum(caps[found, i], min(have[g][1] for g in grams))
        places = np.flatnonzero(caps.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(places), chunk)), pa.array(places.astype(np.int32)), pa.array(list(caps[places]), pa.list_(pa.int32()))], ["chunk", "place", "caps"])

    return postings.select("gram", "chunk", "places", "most").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(meet, "chunk long, place int, caps array<int>")


class ContentIndex:
    """folder: where the parts are. docs (of a chunk), chunks_each, buckets: set when the index is made."""

    def __init__(self, spark: SparkSession, folder: str, docs: int = DOCS, chunks_each: int = CHUNKS_EACH, buckets: int = BUCKETS):
        self.spark, self.log, self.docs, self.chunks_each, self.buckets = spark, Log(spark, folder), docs, chunks_each, buckets
        if not 0 < docs <= CHUNK:
            raise ValueError(f"a chunk has at most {CHUNK} documents")

    # growth

    def add(self, documents: DataFrame, batch: str, gone: DataFrame | None = None) -> None:
        """documents: doc_key, text, and name, directory_path, modified where there are. A key that comes again replaces the older
        document; of several with one key the newest counts (then the one whose text comes last). gone: doc_key of documents
        that aren't there any more. batch names this piece of work: it isn't added twice. A null text is empty; rows
        without a key are left out; other columns are ignored."""
        seen = self.log.entries()
        if any(e["batch"] == batch for e in seen):
            return
        kinds = {"name": "string", "directory_path": "string", "modified": "long"}
        own = [(F.col(c) if c in documents.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
        rows = documents.select(F.col("doc_key").cast("string").alias("doc_key"), *own, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_key IS NOT NULL")
        newest = rows.groupBy("doc_key").agg(F.max(F.struct("modified", F.xxhash64("text").alias("h"), F.xxhash64("name", "directory_path").alias("p"))).alias("_m"), F.count("*").alias("_n"))
        same = (F.xxhash64("text") == F.col("_m.h")) & (F.xxhash64("name", "directory_path") == F.col("_m.p")) & F.col("modified").eqNullSafe(F.col("_m.modified"))
        one = rows.join(newest, "doc_key").where(same | (F.col("_n") == 1)).dropDuplicates(["doc_key"]).drop("_m", "_n")
        one = one.withColumn("length", F.greatest(F.length(F.lower("text")), F.lit(1)).cast("long"))
        first = next_chunk([p for e in seen for p in e["added"]])
        part, grams, stats, dead = (self.log.new_part(k) for k in ("texts", "grams", "stats", "dead"))
        numbered(one, [F.col("doc_key")], first, self.docs, self.chunks_each).write.option("parquet.block.size", ROW_GROUP).partitionBy("grp").parquet(self.log.path(part))
        mine = read_parts(self.log, [part], TEXTS)
        last = mine.agg(F.max("chunk")).first()[0]
        made = trigrams(mine.select("chunk", "place", F.lower("text").alias("lower"))).withColumn("bucket", bucket_of("gram", self.buckets))
        made.repartition("bucket").sortWithinPartitions("bucket", "gram", "chunk").write.partitionBy("bucket").parquet(self.log.path(grams))
        mine.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).write.parquet(self.log.path(stats))
        before, hit = live(seen), []
        if before:
            ended = mine.select("doc_key") if gone is None else mine.select("doc_key").union(gone.select(F.col("doc_key").cast("string")))
            old = read_parts(self.log, [p["part"] for p in before], TEXTS).select("doc_key", "chunk", "place").join(ended.distinct(), "doc_key", "left_semi")
            bitmaps(old).write.parquet(self.log.path(dead))
            tasks = {r["t"] for r in read_parts(self.log, [dead], DEAD).select(F.shiftright("chunk", 20).alias("t")).distinct().collect()}  # one for each task that wrote a part
            hit = [p["part"] for p in before if any(p["first"] <= t <= p["last"] for t in tasks)]
        entry = {"batch": batch, "hit": hit, "added": [{"part": part, "grams": grams, "stats": stats, "dead": dead if before else None, "first": first >> 20, "last": (last if last is not None else first) >> 20}]}

        def change(now: list[dict]) -> dict | None:
            if any(e["batch"] == batch for e in now):
                return None
            if len(now) != len(seen):
                raise RuntimeError("another batch was added meanwhile: add this one again")
            return entry

        self.log.commit(change)

    # what is there

    def _state(self) -> tuple[list[dict], dict[str, int]]:
        """The live parts, and of each the number of the last commit that changed which of its documents live."""
        entries = self.log.entries()
        parts = live(entries)
        return parts, {p["part"]: max([p["number"], *(e["number"] for e in entries if p["part"] in e.get("hit", []))]) for p in parts}

    def _dead(self, parts: list[dict]) -> DataFrame | None:
        ended = [p["dead"] for p in parts if p["dead"]]
        return read_parts(self.log, ended, DEAD) if ended else None

    def _rows(self, parts: list[dict]) -> DataFrame:
        return read_parts(self.log, [p["part"] for p in parts], TEXTS)

    def documents(self) -> DataFrame:
        """All live documents."""
        parts, _ = self._state()
        return alive(self._rows(parts), self._dead(parts)).drop("chunk", "place", "grp")

    def _postings(self, parts: list[dict], words: list[str]) -> DataFrame:
        """The trigrams of words; all buckets are looked at only for words of one or two characters."""
        posts = read_parts(self.log, [p["grams"] for p in parts], GRAMS)
        grams = sorted({g for w in words for g in grams_of(w)})
        short = reduce(lambda a, b: a | b, (F.startswith("gram", F.lit(w)) for w in words if len(w) < 3), F.lit(False))
        if any(len(w) < 3 for w in words):
            return posts.where((F.col("gram").isin(*grams) | short) if grams else short)
        return posts.where(F.col("bucket").isin(*{number_of(g, self.buckets) for g in grams}) & F.col("gram").isin(*grams)) if grams else posts.where(F.lit(False))

    def candidates(self, terms: tuple[Term, ...], parts: list[dict] | None = None) -> DataFrame:
        """chunk, place, caps of the live documents that may hold a term."""
        parts = self._state()[0] if parts is None else parts
        words = [sorted({w.lower() for w in t.texts if w}) for t in terms]
        return alive(may_hold(self._postings(parts, [w for ws in words for w in ws]), words), self._dead(parts))

    def statistics(self, terms: tuple[Term, ...]) -> DataFrame:
        """content.statistics of the live documents: what parts already know of a term isn't counted again."""
        parts, versions = self._state()
        df = self._frequencies(parts, versions, terms)
        rows = read_parts(self.log, [p["stats"] for p in parts], STATS).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("t")).first()
        lost, less = 0, 0
        if (dead := self._dead(parts)) is not None:
            near = in_groups(self._rows(parts).select("chunk", "place", "grp", "length"), dead, self.chunks_each, MOST_NAMED)
            away = near.join(dead.groupBy("chunk").agg(F.bitmap_or_agg("bits").alias("bits")), "chunk").where(has_bit(F.col("bits"), F.col("place")))
            lost, less = away.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        n, total = rows["n"] - lost, rows["t"] - less
        mean = float(total) / n if n else 1.0
        return self.spark.createDataFrame([(n, mean, *(df[term_key(t.texts)] for t in terms))], ", ".join(["n_docs long, avg_length double", *(f"df_{i} long" for i in range(len(terms)))]))

    def _frequencies(self, parts: list[dict], versions: dict[str, int], terms: tuple[Term, ...]) -> dict[str, int]:
        """How many live documents hold each term. Counts are kept by part, its version and the term."""
        keys = {term_key(t.texts): t for t in terms}
        known = {}
        if self.log.children("df"):
            current = self.spark.createDataFrame(list(versions.items()) or [("", 0)], "part string, version long")  # a row a part
            rows = self.spark.read.schema(DF).parquet(self.log.path("df")).where(F.col("term").isin(*keys)).join(F.broadcast(current), ["part", "version"])
            known = {(r["part"], r["term"]): r["df"] for r in rows.distinct().collect()}
        new = {key: [p for p in parts if (p["part"], key) not in known] for key in keys}
        if asked := {key: keys[key] for key, ps in new.items() if ps}:
            these = [p for p in parts if any(p in new[key] for key in asked)]
            made = [(part, versions[part], key, n) for (part, key), n in self._count(these, parts, asked).items() if (part, key) not in known]
            self.spark.createDataFrame(made, DF).coalesce(1).write.mode("append").parquet(self.log.path("df"))
            known |= {(part, key): n for part, _, key, n in made}
        return {key: sum(known[(p["part"], key)] for p in parts) for key in keys}

    def _count(self, new: list[dict], parts: list[dict], terms: dict[str, Term]) -> dict[tuple[str, str], int]:
        """Documents of the new parts that hold each term, by part and term. Three characters are a trigram: where all words have so
        many, no text is read."""
        words = [sorted({w.lower() for w in t.texts if w}) for t in terms.values()]
        found = alive(may_hold(self._postings(new, [w for ws in words for w in ws]), words), self._dead(parts))
        holds = [F.col("caps")[i] > 0 for i in range(len(words))]
        if any(len(w) != 3 for ws in words for w in ws):
            found = cut(found)
            found = self._texts(new, found, "text").join(found, ["chunk", "place"])
            holds = [content.contains_any(F.lower("text"), t.texts) for t in terms.values()]
        owner = reduce(lambda w, p: w.when(F.shiftright("chunk", 20).between(p["first"], p["last"]), F.lit(p["part"])), new, F)
        rows = {r["part"]: r for r in found.groupBy(owner.alias("part")).agg(*(F.count_if(h).alias(f"n_{i}") for i, h in enumerate(holds))).collect()}  # a row a part
        return {(p["part"], key): rows[p["part"]][f"n_{i}"] if p["part"] in rows else 0 for p in new for i, key in enumerate(terms)}

    def _texts(self, parts: list[dict], wanted: DataFrame, *columns: str) -> DataFrame:
        """The documents (or some columns) at wanted (chunk, place), from the folders that hold one."""
        rows = in_groups(self._rows(parts), wanted, self.chunks_each, MOST_NAMED)
        rows = rows.select("chunk", "place", *columns) if columns else rows
        return rows.join(wanted.select("chunk", "place"), ["chunk", "place"], "left_semi")

    # search

    def texts_at(self, addresses: DataFrame) -> DataFrame:
        """chunk, place, text of documents that a search found."""
        return self._texts(self._state()[0], addresses, "text")

    def search(self, terms: tuple[Term, ...], k: int, where: Column | None = None, ahead: int = AHEAD, addresses: bool = False) -> DataFrame:
        """What content.search gives over documents(), with doc_key as the key: doc_key, lexical, coverage, coherence, in_text,
        matched, score (addresses: chunk and place too). where: hard filters on doc_key, name, directory_path, modified, length,
        is_directory (never) and extension."""
        parts, _ = self._state()
        stats = self.statistics(terms)
        fixed = stats.first()
        words = [sorted({w.lower() for w in t.texts if w}) for t in terms]
        postings = self._postings(parts, [w for ws in words for w in ws])
        rows = self._rows(parts).select("chunk", "place", "grp", "doc_key", "name", "directory_path", "modified", "length")
        near = in_groups(rows, postings, self.chunks_each, MOST_NAMED).join(self.candidates(terms, parts), ["chunk", "place"])
        near = near if where is None else near.withColumns({"is_directory": F.lit(False), "extension": P.extension(F.col("name"))}).where(where)
        bounded = cut(near.select("chunk", "place", self._bound(terms, fixed).alias("bound")).where("bound IS NOT NULL"))

        def exact(wanted: DataFrame) -> DataFrame:
            texts = self._texts(parts, wanted).withColumn("_at", F.struct("doc_key", "chunk", "place"))
            return content.search(texts, terms, k, "_at", "text", F.col("name"), F.col("directory_path"), None, F.col("modified"), stats)

        best = F.broadcast(bounded.orderBy(F.desc("bound"), "chunk", "place").limit(ahead * k).select("chunk", "place"))
        scores = exact(best).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        floor = scores["least"] if scores["n"] == k else None
        found = exact(bounded if floor is None else bounded.where(F.col("bound") >= floor - 1e-9 * (1 + abs(floor))))
        own = [c for c in found.columns if c != "_at"]
        return found.select("_at.*", *own) if addresses else found.select("_at.doc_key", *own)

    def _bound(self, terms: tuple[Term, ...], stats) -> Column:
        """The most that a document's score can be, of what is known without its text; null if it can't be a match."""
        n = len(terms)
        lexical, matched, in_text = F.lit(0.0), F.lit(0), F.lit(0)
        name, path = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("directory_path", F.lit("")))
        for i, t in enumerate(terms):
            df, tf = stats[f"df_{i}"], F.col("caps")[i]
            idf = float(np.log(1.0 + (stats["n_docs"] - df + 0.5) / (df + 0.5)))
            by_text = idf * tf * 2.2 / (tf + 1.2 * (0.28 + 0.72 * F.col("length") / stats["avg_length"]))
            elsewhere = F.when(content.contains_any(name, t.names), 1.4).when(content.contains_any(path, t.names), 0.65).otherwise(0.0) if t.names else F.lit(0.0)
            lexical = lexical + F.greatest(F.when(tf > 0, by_text).otherwise(0.0), elsewhere)
            in_text = in_text + (tf > 0).cast("int")
            matched = matched + ((tf > 0) | (elsewhere > 0)).cast("int")
        score = 120.0 + 22.0 * lexical + 100.0 * matched / n + 85.0 + 32.0 * in_text + F.when(matched == n, 45.0).otherwise(0.0)
        return F.when((in_text >= 1) & (matched >= content.required(n)), score)

