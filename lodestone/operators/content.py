"""The content lane: words inside document texts, scored over the whole corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.intent import Term


def contains_any(lower: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(lower, F.lit(w.lower())) for w in words))


def statistics(docs: DataFrame, terms: tuple[Term, ...], text: str = "text") -> DataFrame:
    """One row: documents, mean length (each 1 at least), and how many documents hold each term. One pass for all terms."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = [F.coalesce(F.sum(contains_any(lower, t.texts).cast("long")), F.lit(0)).alias(f"df_{i}") for i, t in enumerate(terms)]
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.greatest(F.length(lower), F.lit(1)).cast("double")), F.lit(1.0)).alias("avg_length"), *found)


def coherence(span: Column, terms: Column) -> Column:
    """How near the terms' first places are: 1 for one term."""
    steps = F.when(span <= 160, 1.0).when(span <= 500, 0.78).when(span <= 1500, 0.48).when(span <= 4000, 0.28).otherwise(0.12)
    return F.when(terms <= 1, F.lit(1.0)).otherwise(steps)


def required(terms: int) -> int:
    """Terms that must match: 1 of 1, else two and half of them."""
    return 1 if terms <= 1 else max(2, -(-terms // 2))


def search(docs: DataFrame, terms: tuple[Term, ...], k: int, key: str = "doc_id", text: str = "text", name: Column | None = None, path: Column | None = None, where: Column | None = None, modified: Column | None = None, known: DataFrame | None = None) -> DataFrame:
    """key, lexical, coverage, coherence, in_text, matched, score of the best documents. where: hard filters.

    Statistics are over all documents (known: one row of them, if they are already). A term may match in the text, or else (by its wider words) in the name or path. The
    one-row statistics are joined to each document; words are literals, so no term is exploded to rows.
    """
    if not terms:
        raise ValueError("no terms")
    n = len(terms)
    base = docs if where is None else docs.where(where)
    name = F.lit("") if name is None else F.lower(name)
    path = F.lit("") if path is None else F.lower(path)
    keep = [F.col(key), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"), name.alias("_name"), path.alias("_path"), (F.lit(0) if modified is None else modified).alias("_modified")]
    rows = base.select(*keep).crossJoin(F.broadcast(statistics(docs, terms, text) if known is None else known))
    lower, length = F.col("_text"), F.greatest(F.length("_text"), F.lit(1))
    best = []
    for i, t in enumerate(terms):
        options = [F.struct(T.occurrences(lower, w.lower()).alias("tf"), (-T.first_place(lower, w.lower())).alias("place")) for w in t.texts]
        best.append(F.array_max(F.array(*options)).alias(f"_t{i}"))
    # as rows of one: conditions on a plain column would be turned into conditions on the text, which count anew for each use, and
    # go below the joins that chose the documents
    rows = rows.select("*", F.explode(F.array(F.struct(*best))).alias("_t")).select("*", "_t.*")
    lexical, in_text, matched, places = F.lit(0.0), F.lit(0), F.lit(0), []
    for i, t in enumerate(terms):
        tf = F.col(f"_t{i}.tf")
        idf = F.log(1.0 + (F.col("n_docs") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5))
        by_text = idf * tf * 2.2 / (tf + 1.2 * (0.28 + 0.72 * length / F.col("avg_length")))
        by_name, by_path = (contains_any(F.col(c), t.names) for c in ("_name", "_path"))
        elsewhere = F.when(by_name, 1.4).when(by_path, 0.65).otherwise(0.0)
        lexical = lexical + F.when(tf > 0, by_text).otherwise(elsewhere)
        in_text = in_text + (tf > 0).cast("int")
        matched = matched + ((tf > 0) | (elsewhere > 0)).cast("int")
        places.append(F.when(tf > 0, -F.col(f"_t{i}.place")))
    found = F.filter(F.array(*places), lambda x: x.isNotNull())
    rows = rows.select(key, "_modified", lexical.alias("lexical"), in_text.alias("in_text"), matched.alias("matched"), (F.array_max(found) - F.array_min(found)).alias("_span"))
    rows = rows.where((F.col("in_text") >= 1) & (F.col("matched") >= required(n)))
    rows = rows.withColumns({"coverage": F.col("matched") / F.lit(float(n)), "coherence": coherence(F.col("_span"), F.col("in_text"))})
    rows = rows.where((F.col("matched") == n) | (F.col("coherence") >= 0.35))
    score = 120.0 + 22.0 * F.col("lexical") + 100.0 * F.col("coverage") + 85.0 * F.col("coherence") + 32.0 * F.col("in_text") + F.when(F.col("matched") == n, 45.0).otherwise(0.0)
    return rows.withColumn("score", score).orderBy(F.desc("score"), F.desc("_modified"), key).limit(k).drop("_modified", "_span")


def by_attributes(docs: DataFrame, predicates: tuple[tuple[str, str, str], ...], k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A search with script predicates on the content only: every one must surely hold."""
    holds = reduce(lambda a, b: a & b, (T.script_matches(T.script_profile(F.col(text)), s, m) for s, _, m in predicates))
    score = F.lit(380.0 + 80.0 * len(predicates))
    return docs.where(F.coalesce(holds, F.lit(False))).select(key, score.alias("score")).orderBy(key).limit(k)
