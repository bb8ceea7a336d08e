"""The vector lanes: quantized index rows, relative cuts, prompt blends, re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import vectors as V
from ..plans.visual import Profile

LEAST, BELOW_BEST, EXPANDED, MOST = 0.76, 0.05, 120, 240
#: Packed vectors that are multiplied at once.
AT_ONCE = 4096


def index_rows(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """With a quantized copy of the vector."""
    return vectors.withColumn("quantized", V.quantize(F.col(vector)))


def pack(index: DataFrame, quantized: str = "quantized") -> DataFrame:
    """With packed in place of the quantized vector: its bytes, one for each dimension."""
    byte = lambda x: F.lpad(F.hex(x.cast("int").bitwiseAND(F.lit(255))), 2, "0")
    return index.withColumn("packed", F.unhex(F.array_join(F.transform(quantized, byte), ""))).drop(quantized)


def nearest_packed(index: DataFrame, query: list[float], least: float, most: int, key: str) -> DataFrame:
    """key, similarity of each task's best rows (most at most) over least: a matrix product for AT_ONCE vectors, and a bounded list
    of the best. Vectors of another length than the query's, and missing ones, take no part."""
    unit, names = np.array(V.unit(query), np.float64), ["key", "similarity"]

    def best(found: list[pa.Table]) -> list[pa.Table]:
        rows = pa.concat_tables(found)
        return [rows.sort_by([("similarity", "descending"), ("key", "ascending")]).slice(0, most)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                raw = part.column(1).to_pylist()
                whole = [i for i, x in enumerate(raw) if x is not None and len(x) == len(unit)]
                if not whole:
                    continue
                x = np.frombuffer(b"".join([raw[i] for i in whole]), np.int8).reshape(len(whole), -1).astype(np.float64)
                size = np.sqrt((x * x).sum(axis=1))
                similarity = np.divide(x @ unit, size, out=np.zeros(len(x)), where=size > 0)
                over = np.flatnonzero(similarity >= least)
                if len(over):
                    held.append(pa.table([part.column(0).take(pa.array(np.array(whole)[over])), pa.array(similarity[over])], names=names))
                    if sum(map(len, held)) > 8 * most:
                        held = best(held)
        if held:
            yield from best(held)[0].combine_chunks().to_batches()

    kind = index.schema[key].dataType.simpleString()
    return index.select(F.col(key).alias("key"), "packed").mapInArrow(search, f"key {kind}, similarity double").withColumnRenamed("key", key)


def semantic_search(index: DataFrame, query: list[float], k: int, least: float = LEAST, below_best: float = BELOW_BEST, expanded: int = EXPANDED, key: str = "vec_id") -> DataFrame:
    """key, similarity, rank of the rows over the cut.

    Strong rows are within below_best of the best. m = min(k, MOST, max(expanded, strong rows)); the m best strong rows, or the
    m best of all if the strong ones are fewer. Only MOST rows reach the window. index: quantized, an array, or packed.
    """
    most = min(max(1, k), MOST)
    if "packed" in index.columns:
        near = nearest_packed(index, query, least, MOST, key)
    else:
        near = index.select(key, V.cosine_bytes(V.unit(query), F.col("quantized")).alias("similarity")).where(F.col("similarity") >= least)
    # one pass: the best MOST + expanded rows tell how many are strong, as far as that matters
    top = near.orderBy(F.desc("similarity"), key).limit(MOST)
    every = Window.partitionBy()  # MOST rows at most
    ranked = top.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("similarity"), key)), "_best": F.max("similarity").over(every)})
    ranked = ranked.withColumn("_strong", F.count_if(F.col("similarity") >= F.greatest(F.lit(least), F.col("_best") - below_best)).over(every))
    return ranked.where(F.col("rank") <= F.least(F.lit(most), F.greatest(F.lit(expanded), F.col("_strong")))).drop("_best", "_strong")


def visual_similarity(regions: Column, prompts: list[list[float]], named: bool) -> Column:
    """Each prompt's best region, then the best prompts blended. regions: an array of quantized vectors."""

    def best(prompt: list[float]) -> Column:
        return F.array_max(F.transform(regions, lambda r: V.cosine_bytes(V.unit(prompt), r)))

    return V.blend(F.array(*map(best, prompts)), named)


def visual_search(index: DataFrame, prompts: list[list[float]], k: int, least: float, below_best: float, named: bool = False, corroboration: Column | None = None, tag: Column | None = None, key: str = "vec_id", wanted: Profile | None = None, interface: list[float] | None = None, character: list[float] | None = None) -> DataFrame:
    """key, similarity, score. corroboration (0 or 110 to 340: a name, path or character tag) and tag (confidence from 0.5 on) let
    a row pass whatever its similarity.

    wanted: the query's profile. Where it suppresses interfaces, a row must be more like the prompts than like the interface
    prompt by its margin, and a named subject must be corroborated; what lifts it over any character counts for its score.
    """
    extra = F.lit(0.0) if corroboration is None else F.coalesce(corroboration, F.lit(0.0))
    confidence = F.lit(0.0) if tag is None else F.coalesce(tag, F.lit(0.0))
    against = lambda prompt: visual_similarity(F.col("regions"), [prompt], False) if prompt is not None else F.lit(0.0)
    rows = index.select(key, visual_similarity(F.col("regions"), prompts, named).alias("similarity"), extra.alias("_extra"), confidence.alias("_tag"), against(interface).alias("_ui"), against(character).alias("_any"))
    rows = rows.where((F.col("similarity") >= least) | (F.col("_extra") >= 220) | (F.col("_tag") >= 0.5) | (F.lit(wanted is None) & (F.col("_extra") > 0)))
    lift = F.lit(0.0)
    if wanted is not None and wanted.suppresses_interfaces and interface is not None and wanted.margin is not None:
        rows = rows.where((F.col("similarity") - F.col("_ui") >= wanted.margin) | ((F.col("_extra") >= 220) & (F.col("_extra") != 240)))
    if wanted is not None and wanted.named:
        rows = rows.where(F.col("_extra") > 0)
        lift = F.lit(0.0) if character is None else 160.0 * F.greatest(F.lit(0.0), F.col("similarity") - F.col("_any"))
    best = rows.agg(F.max("similarity").alias("_best"))
    rows = rows.crossJoin(F.broadcast(best)).where((F.col("similarity") >= F.greatest(F.lit(least), F.col("_best") - below_best)) | (F.col("_extra") > 0))
    score = 175.0 + 420.0 * F.col("similarity") + F.col("_extra") + lift + 90.0 * F.col("_tag")
    return rows.select(key, "similarity", score.alias("score")).orderBy(F.desc("score"), F.desc("similarity"), key).limit(min(k, 500))


def centroids(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """The mean vector of each group, of length 1. Partial sums by place: no group meets in one row before it is summed."""
    places = vectors.select(group, F.posexplode(vector).alias("place", "value")).groupBy(group, "place").agg(F.avg(F.col("value").cast("double")).alias("value"))
    whole = places.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("mean"))
    return whole.select(group, V.normalize(F.col("mean")).alias("centroid"))


def rerank(results: DataFrame, similarity: Column, depth: int = 50) -> DataFrame:
    """results: rank (from 1), score. The first depth rows by 0.76 similarity + 0.24 root of the relative score; the rest follow."""
    head = results.where(F.col("rank") <= depth)
    top = head.agg(F.max("score").alias("_top"))
    mixed = head.withColumn("similarity", similarity).crossJoin(F.broadcast(top)).withColumn("mixed", 0.76 * F.col("similarity") + 0.24 * F.sqrt(F.when(F.col("_top") > 0, F.greatest(F.lit(0.0), F.col("score") / F.col("_top"))).otherwise(F.lit(0.0)))).drop("_top")
    first = mixed.withColumn("new_rank", F.row_number().over(Window.orderBy(F.desc("mixed"), "rank")))  # depth rows
    rest = results.where(F.col("rank") > depth).withColumns({"similarity": F.lit(None).cast("double"), "mixed": F.lit(None).cast("double"), "new_rank": F.col("rank")})
    return first.unionByName(rest)


def relative(similarity: Column, best: Column) -> Column:
    return S.relative_confidence(similarity, best)
