"""Queries on texts: the content lane and the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import content
from ..plans.intent import Term
from .registry import CONTENTS_SQL, contents, query, table

WANTED = (Term("license", ("license", "licensed"), ("license", "licensed")), Term("token", ("token",), ("token",)), Term("the", ("the",), ("the",)))
_OCC = "least(8, (length(t) - length(replace(t, '{w}', ''))) // {n})"


def _occ(word: str) -> str:
    return _OCC.format(w=word, n=len(word))


@query(
    """WITH d AS (SELECT lower(coalesce(text, '')) AS t FROM documents)
SELECT count(*) AS n_docs, round(avg(greatest(length(t), 1)), 6) AS avg_length, sum((contains(t, 'license') OR contains(t, 'licensed'))::INT)::BIGINT AS df_0,
       sum(contains(t, 'token')::INT)::BIGINT AS df_1, sum(contains(t, 'the')::INT)::BIGINT AS df_2 FROM d"""
)
def content_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.statistics(table(spark, sf_dir, "documents"), WANTED).withColumn("avg_length", F.round("avg_length", 6))


_BM25 = (
    """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
s AS (SELECT count(*) AS n, avg(greatest(length(t), 1)) AS a, sum((contains(t, 'license'))::INT) AS d0, sum(contains(t, 'token')::INT) AS d1, sum(contains(t, 'the')::INT) AS d2 FROM d),
f AS (SELECT doc_id, greatest(length(t), 1) AS len, """
    + f"{_occ('license')} AS f0a, {_occ('licensed')} AS f0b, {_occ('token')} AS f1, {_occ('the')} AS f2, "
    + """instr(t, 'license') - 1 AS p0a, instr(t, 'licensed') - 1 AS p0b, instr(t, 'token') - 1 AS p1, instr(t, 'the') - 1 AS p2 FROM d),
g AS (SELECT *, greatest(f0a, f0b) AS f0, CASE WHEN f0a > f0b THEN p0a WHEN f0b > f0a THEN p0b ELSE least(p0a, p0b) END AS p0 FROM f),
h AS (SELECT doc_id, (f0 > 0)::INT + (f1 > 0)::INT + (f2 > 0)::INT AS m,
  CASE WHEN f0 > 0 THEN ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.28 + 0.72 * len / a)) ELSE 0 END
  + CASE WHEN f1 > 0 THEN ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.28 + 0.72 * len / a)) ELSE 0 END
  + CASE WHEN f2 > 0 THEN ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.28 + 0.72 * len / a)) ELSE 0 END AS lexical,
  greatest(CASE WHEN f0 > 0 THEN p0 ELSE -1 END, CASE WHEN f1 > 0 THEN p1 ELSE -1 END, CASE WHEN f2 > 0 THEN p2 ELSE -1 END)
  - least(CASE WHEN f0 > 0 THEN p0 ELSE 1000000000 END, CASE WHEN f1 > 0 THEN p1 ELSE 1000000000 END, CASE WHEN f2 > 0 THEN p2 ELSE 1000000000 END) AS span FROM g, s),
i AS (SELECT *, CASE WHEN m <= 1 OR span <= 160 THEN 1.0 WHEN span <= 500 THEN 0.78 WHEN span <= 1500 THEN 0.48 WHEN span <= 4000 THEN 0.28 ELSE 0.12 END::DOUBLE AS coh FROM h WHERE m >= 2)
SELECT doc_id, round(lexical, 6) AS lexical, m::BIGINT AS matched, round(coh, 6) AS coherence,
       round(120 + 22 * lexical + 100 * (m / 3.0) + 85 * coh + 32 * m + CASE WHEN m = 3 THEN 45 ELSE 0 END, 6) AS score
FROM i WHERE m = 3 OR coh >= 0.35 ORDER BY score DESC, doc_id LIMIT 50"""
)


@query(_BM25)
def content_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content.search(table(spark, sf_dir, "documents"), WANTED, 50)
    return rows.select("doc_id", F.round("lexical", 6).alias("lexical"), F.col("matched").cast("long").alias("matched"), F.round("coherence", 6).alias("coherence"), F.round("score", 6).alias("score"))


@query("""SELECT doc_id, length(regexp_replace(text, '[^가-힣ᄀ-ᇿ㄰-㆏]', '', 'g')) AS hangul, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin,
       length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) AS digits, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters FROM documents""")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.script_profile(F.col("text")).alias("p")).select("doc_id", "p.*")


@query("""WITH p AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) AS digits, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters FROM documents)
SELECT doc_id, 540.0::DOUBLE AS score FROM p WHERE latin >= 5 AND latin / greatest(1, letters + digits) >= 0.6 AND digits > 0 ORDER BY doc_id LIMIT 200""")
def content_by_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.by_attributes(table(spark, sf_dir, "documents"), (("Latin", "Content", "Predominantly"), ("Digit", "Content", "Contains")), 200)


@query("""WITH p AS (SELECT d.doc_id, length(regexp_replace(d.name, '[^\\p{Nd}]', '', 'g')) AS nd, CASE WHEN l.doc_id IS NOT NULL THEN length(regexp_replace(d.text, '[^\\p{Nd}]', '', 'g')) END AS cd
  FROM (SELECT doc_id, text, 'doc_' || doc_id AS name FROM documents) d LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS total, sum(CASE WHEN nd = 0 AND cd = 0 THEN 1 ELSE 0 END)::BIGINT AS excluded_holds, sum(CASE WHEN NOT (nd = 0) THEN 0 WHEN cd IS NULL THEN 1 ELSE 0 END)::BIGINT AS excluded_unknown,
       sum(CASE WHEN cd IS NULL THEN 1 ELSE 0 END)::BIGINT AS content_unknown, sum(CASE WHEN cd > 0 THEN 1 ELSE 0 END)::BIGINT AS content_holds FROM p""")
def three_valued_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text is known only where a label is: the left join that gives facts, or none."""
    docs = contents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    profile = F.when(F.col("known"), T.script_profile(F.col("text")))
    name = P.stem(F.col("name"))
    both = T.attribute(("Digit", "NameOrContent", "Excludes"), name, F.col("directory_path"), profile)
    text = T.attribute(("Digit", "Content", "Contains"), name, F.col("directory_path"), profile)
    return docs.agg(F.count("*").alias("total"), F.count_if(both).alias("excluded_holds"), F.count_if(both.isNull()).alias("excluded_unknown"), F.count_if(text.isNull()).alias("content_unknown"), F.count_if(text).alias("content_holds"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct, sha256(coalesce(array_to_string(list_sort(list_distinct(w)), ' '), '')) AS digest FROM t""")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.sha2(F.array_join(F.array_sort(F.array_distinct("w")), " "), 256).alias("digest"))


@query("""SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g'))) AS spaced, sha256(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', '', 'g')) AS compact FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalized(F.col("text")), 256).alias("spaced"), F.sha2(T.compact(F.col("text")), 256).alias("compact"))


@query(f"""SELECT doc_id, ({_occ('the')})::BIGINT AS uses, (instr(t, 'token') - 1)::BIGINT AS place, contains(' ' || w || ' ', ' license ') AS has_word FROM
(SELECT doc_id, lower(text) AS t, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')) AS w FROM documents)""")
def occurrences_and_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.occurrences(t, "the").alias("uses"), T.first_place(t, "token").alias("place"), T.has_word(T.normalized(F.col("text")), "license").alias("has_word"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM documents)
SELECT doc_id, length(substr(t, 1, 12000)) AS cleaned, length(t) > 12000 AS was_truncated,
  CASE WHEN length(t) <= 240 THEN t ELSE substr(t, 1, 165) || ' … ' || right(t, 72) END AS segment,
  CASE WHEN length(t) <= 420 THEN t ELSE substr(t, 1, 210) || chr(10) || '…' || chr(10) || substr(t, greatest(210, length(t) // 2 - 52) + 1, 105) || chr(10) || '…' || chr(10) || right(t, 105) END AS sampled FROM c""")
def extraction_and_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space, truncation at 12000 characters, the compact segment and the three-part sample of 420."""
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.clean(F.col("text"), 12_000)).cast("long").alias("cleaned"), (F.length(t) > 12_000).alias("was_truncated"), T.compact_segment(t).alias("segment"), T.sample_parts(t, 420).alias("sampled"))


@query("""WITH s AS (SELECT doc_id, list_transform(range(0, 5), lambda i: substr(text, round_even(greatest(length(text) - 240, 0) * i / 4.0, 0)::INT + 1, 240)) AS w FROM documents)
SELECT doc_id, len(list_distinct(w))::BIGINT AS n, sha256(array_to_string(list_sort(list_distinct(w)), '|')) AS digest FROM s""")
def representative_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.segments(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.sha2(F.array_join(F.array_sort("w"), "|"), 256).alias("digest"))


@query("""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
e AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'), ' ') AS t FROM c)
SELECT page_id, length(t) AS n_chars, sha256(t) AS digest FROM e""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.trim(F.regexp_replace(T.strip_markup(F.col("html")), r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.sha2(t, 256).alias("digest"))


@query("""SELECT doc_id, upper(sha256(text)) AS text_hash, length(text) AS text_length, upper(substr(sha256(upper(source)), 1, 24)) AS root_key FROM documents""")
def version_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash and length that mark a text's version, and its root's index key."""
    return table(spark, sf_dir, "documents").select("doc_id", F.upper(F.sha2("text", 256)).alias("text_hash"), F.length("text").cast("long").alias("text_length"), P.root_key(F.col("source")).alias("root_key"))


@query("""SELECT conv_id, count(*) AS turns, max(length(text)) AS longest, sum(contains(lower(text), 'the')::INT)::BIGINT AS with_the FROM conversations GROUP BY conv_id""")
def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(F.length("text")).cast("long").alias("longest"), F.sum(F.contains(F.lower("text"), F.lit("the")).cast("int")).alias("with_the"))


@query("""WITH q AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents),
x AS (SELECT DISTINCT item_id, unnest(w) AS t FROM q), y AS (SELECT doc_id, unnest(w) AS t FROM d), r AS (SELECT t FROM x GROUP BY t HAVING count(*) = 1)
SELECT item_id, count(DISTINCT doc_id) AS docs FROM x JOIN r USING (t) JOIN y USING (t) GROUP BY item_id""")
def benchmark_word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a word with a benchmark item which only that item has."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t"))
    only = items.groupBy("t").agg(F.count("*").alias("n"), F.min("item_id").alias("item_id")).where("n = 1").drop("n")
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t"))
    return only.join(words, "t").groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"))
