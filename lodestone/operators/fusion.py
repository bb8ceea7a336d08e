"""Merging the lanes: one row a path, reciprocal ranks, evidence and order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..plans.intent import Directive

COLUMNS = ("path_key", "lane", "lane_rank", "score", "evidence", "coverage", "total_terms", "name_matches", "path_matches", "type_matches", "semantic", "visual", "created", "modified", "size_bytes", "reason")
#: Types of the columns that a lane may leave out (null).
OPTIONAL = {"coverage": "double", "total_terms": "int", "name_matches": "int", "path_matches": "int", "type_matches": "int", "semantic": "double", "visual": "double", "created": "long", "modified": "long", "size_bytes": "long", "reason": "string"}


def by_place(order: list[Column]) -> Window:
    """A window over all rows; for tables that have been cut to a bound."""
    return Window.orderBy(*order)


def ranked(lane: DataFrame, order: list[Column], most: int) -> DataFrame:
    """With lane_rank from 0. The lane is cut to its bound first, so the window's one partition is bounded."""
    return lane.orderBy(*order).limit(most).withColumn("lane_rank", F.row_number().over(Window.orderBy(*order)) - 1)


def lane(rows: DataFrame) -> DataFrame:
    """The COLUMNS of a lane; what it hasn't is null."""
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(OPTIONAL[c]).alias(c) for c in COLUMNS))


def merge(lanes: list[DataFrame]) -> DataFrame:
    """lanes: COLUMNS each (see lane), lane a number in the order of merging. A path's score is its first lane's and 0.55 of all
    later ones'; counts, coverage and similarities are the largest, the number of terms the first lane's, created the earliest,
    size the first lane's that knows it; reasons come in the order of lanes."""
    rows = reduce(DataFrame.unionByName, (lane(x) for x in lanes))
    place = F.struct("lane", "lane_rank")
    first = F.min_by("score", place)
    reasons = F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("lane", "lane_rank", "reason")))), lambda x: x["reason"])
    count = lambda c: F.coalesce(F.max(c), F.lit(0)).alias(c)
    return rows.groupBy("path_key").agg(
        (first + 0.55 * (F.sum("score") - first)).alias("score"),
        F.sum(1.0 / (F.col("lane_rank") + 61)).alias("rrf"),
        F.max("coverage").alias("coverage"),
        F.coalesce(F.min_by("total_terms", place), F.lit(0)).alias("total_terms"),
        count("name_matches"),
        count("path_matches"),
        count("type_matches"),
        F.max("semantic").alias("semantic"),
        F.max("visual").alias("visual"),
        F.min("created").alias("created"),
        F.max("modified").alias("modified"),
        F.min_by("size_bytes", F.when(F.col("size_bytes").isNotNull(), place)).alias("size_bytes"),
        F.array_sort(F.collect_set("evidence")).alias("evidence"),
        reasons.alias("reasons"),
    )


def signals(rows: DataFrame) -> dict[str, Column]:
    """What ranking wishes look at, of merged rows."""
    share = lambda c: S.clamp(F.col(c) / F.greatest(F.lit(1), F.col("total_terms")).cast("double"))
    return {"NameMatch": share("name_matches"), "PathMatch": share("path_matches"), "TypeMatch": share("type_matches"), "ContentMatch": S.clamp(F.coalesce("coverage", F.lit(0.0))), "SemanticMatch": S.semantic_signal(F.col("semantic")), "created": F.col("created"), "modified": F.col("modified"), "size": F.col("size_bytes")}


def order(merged: DataFrame, k: int, directives: tuple[Directive, ...] = (), now_micros: int = 0, visual_query: bool = False, primary: Column | None = None, ties: tuple[str, ...] | None = None) -> DataFrame:
    """The k best: guardrail, primary wish, hybrid score. Adds kind, guardrail, hybrid, display score and percent.

    primary: a wish of the caller's own in place of the primary directives, which end at 1 (all moments to come are as good as now).
    ties: the columns that decide after the wish, before the path; by default hybrid and score, the newer, the name.
    """
    looks = signals(merged)
    wish = S.adjustment(directives, looks, now_micros) if directives else F.lit(0.0)
    first = primary if primary is not None else S.preference(directives, looks, now_micros, primary_only=True) if any(d.primary for d in directives) else F.lit(0.0)
    best = merged.agg(F.coalesce(F.max("semantic"), F.lit(0.0)).alias("_bs"), F.coalesce(F.max("visual"), F.lit(0.0)).alias("_bv"))
    rows = merged.crossJoin(F.broadcast(best)).withColumn("kind", S.primary_evidence(F.col("evidence"), F.col("coverage"), visual_query))
    rows = rows.withColumns({"guardrail": S.guardrail(F.col("kind"), visual_query), "_primary": first, "hybrid": S.priority(F.col("kind"), F.size("evidence"), visual_query) + 30_000.0 * F.col("rrf") + wish})
    percent = S.match_percent(F.col("kind"), F.col("evidence"), F.col("coverage"), F.col("name_matches"), F.col("total_terms"), F.col("semantic"), F.col("_bs"), F.col("visual"), F.col("_bv"))
    rows = rows.withColumns({"display_score": F.col("guardrail") * 1e6 + F.col("_primary") * 1e5 + F.col("hybrid"), "percent": percent})
    name = F.lower("name") if "name" in merged.columns else F.lit("")
    then = [F.desc("hybrid"), F.desc("score"), F.desc("modified"), name] if ties is None else [F.desc(c) for c in ties]
    return rows.drop("_bs", "_bv").orderBy(F.desc("guardrail"), F.desc("_primary"), *then, "path_key").limit(k).drop("_primary")


def without_unsupported(semantic: DataFrame, lexical: DataFrame, strong: Column) -> DataFrame:
    """Precision first: where some lexical row is strong, semantic rows stay only if their path is a lexical one's too."""
    flag = lexical.agg(F.coalesce(F.max(strong), F.lit(False)).alias("_strong"))
    known = lexical.select("path_key").distinct().withColumn("_known", F.lit(True))
    return semantic.crossJoin(F.broadcast(flag)).join(known, "path_key", "left").where(~F.col("_strong") | F.col("_known")).drop("_strong", "_known")


#: How a result was analysed, from the most to the least: what decides between rows of one priority.
FLAGS = ("was_advanced", "was_visual", "was_ai")


def flagged(rows: DataFrame) -> DataFrame:
    """rows with all FLAGS; those that aren't there are false."""
    return rows.withColumns({f: F.coalesce(F.col(f), F.lit(False)) if f in rows.columns else F.lit(False) for f in FLAGS})


def upsert(previous: DataFrame, incoming: DataFrame, k: int, custom_ranking: bool = False) -> DataFrame:
    """path_key, priority, score, percent, name, rank (the place in its list), FLAGS: the better row of each path, best first.

    The incoming row replaces one of lower priority; of equal priority, one that wasn't analysed as far (the first flag in
    which they differ tells); where these are equal too, one whose score or percentage isn't higher. Rows come by
    priority and score; by score and priority where the query has ranking wishes; then percentage, place in the incoming list,
    place in the previous one, and name. rank becomes the place in the result.
    """
    c = F.col
    both = flagged(previous).withColumn("_new", F.lit(0)).unionByName(flagged(incoming).withColumn("_new", F.lit(1)))
    one = F.struct("priority", *FLAGS, "score", "percent", "name")
    of = lambda new: F.max(F.when(c("_new") == new, one))
    rows = both.groupBy("path_key").agg(of(0).alias("_p"), of(1).alias("_i"), F.min(F.when(c("_new") == 1, c("rank"))).alias("_in"), F.min(F.when(c("_new") == 0, c("rank"))).alias("_was"))
    better = F.when(c("_i.priority") != c("_p.priority"), c("_i.priority") > c("_p.priority"))
    for f in FLAGS:
        better = better.when(c(f"_i.{f}") != c(f"_p.{f}"), c(f"_i.{f}"))
    better = better.otherwise((c("_i.score") >= c("_p.score")) | (c("_i.percent") >= c("_p.percent")))
    rows = rows.withColumn("_b", F.when(c("_p").isNull() | (c("_i").isNotNull() & better), c("_i")).otherwise(c("_p"))).select("path_key", "_b.*", "_in", "_was")
    keys = ["score", "priority"] if custom_ranking else ["priority", "score"]
    by = [*(F.desc(x) for x in keys), F.desc("percent"), F.asc_nulls_last("_in"), F.asc_nulls_last("_was"), F.lower("name"), c("path_key")]
    return ranked(rows, by, k).withColumnRenamed("lane_rank", "rank").drop("_in", "_was")
