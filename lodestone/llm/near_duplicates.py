"""Near-duplicates by MinHash bands and odd sketches, confirmed on full shingle sets.

1. One pass over the text: each document's set size, two hashes of its word sequence, its band keys and its odd sketch. The
   sketch flips, for each MinHash sample, the bit that the sample hashes to: the population count of two sketches' XOR tells
   how many samples differ, most exactly when few do.
2. Documents with equal word sequences are one class; its smallest id stands for it from here on.
3. Every member of a band's bucket is compared with the bucket's smallest id (a star, not all pairs).
4. In buckets that are still of several components, those outside the largest one are compared with all others, in blocks of
   bounded size; a pair is taken up in the first bucket that it shares, and only if its sketches say it may be similar enough.
Pairs whose sketches estimate a similarity Z standard errors below the threshold are dropped (Z = None: none are); all others
are confirmed on the full sets. BANDS bands of ROWS samples find a pair at the threshold but for about 3 in 10 million.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix, most_frequent, slices, table
from .components import components
from .shingles import minhash, shingle_sets

#: Similar enough: NEED * union <= 100 * intersection.
NEED = 75
BANDS, ROWS = 40, 4
SAMPLES, BITS, Z = 1024, 4096, 5.0
#: Members of a block in step 4, and of a leader's chunk when pairs are compared.
BLOCK, CHUNK = 512, 1024
#: Leaders whose numbers of chunks are broadcast: any other has a 4096th of all pairs at most, in one chunk.
HOT = 4096


def most_differing(similarity: float, z: float | None = Z) -> int:
    """The largest population count of an XOR at which a pair may have the similarity, up to z standard errors (None: any)."""
    if z is None:
        return BITS
    flips = 2 * SAMPLES * (1 - similarity)
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** flips)
    slope = (1 - 2 / BITS) ** flips
    spread = BITS / 4 * (1 - (1 - 4 / BITS) ** flips) + BITS * (BITS - 1) / 4 * ((1 - 4 / BITS) ** flips - (1 - 2 / BITS) ** (2 * flips))
    samples = 4 * SAMPLES * similarity * (1 - similarity) * slope**2
    return math.ceil(mean + z * math.sqrt(max(spread, 0) + BITS / 4 * (1 - slope) * slope + samples))


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """rows x BITS / 8 bytes from SAMPLES x rows minima."""
    count, rows = samples.shape
    bits, row = np.zeros((rows, BITS), np.uint8), np.arange(rows)
    for i in range(count):
        bits[row, (mix(samples[i].astype(np.uint64) + np.uint64(i << 32)) % np.uint64(BITS)).astype(np.int64)] ^= 1
    return np.packbits(bits, axis=1)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, h1, h2, bands, sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sets, edges, h1, h2 = shingle_sets(batch.column("text"))
            samples = minhash(sets, edges, SAMPLES)
            bands = np.stack([mix(sum((mix(samples[b * ROWS + r].astype(np.uint64) + np.uint64(r << 40)) * np.uint64(2 * r + 1) for r in range(ROWS)), np.zeros(batch.num_rows, np.uint64)) + np.uint64(b << 50)) for b in range(BANDS)], axis=1)
            sketches = [x.tobytes() for x in odd_sketches(samples)]
            arrays = [batch.column("doc_id"), pa.array(np.diff(edges)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([x.tobytes() for x in bands], pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, h1 long, h2 long, bands binary, sketch binary")


def buckets_of(signed: DataFrame) -> DataFrame:
    """(rep, bands) to key, rep, leader (the bucket's smallest rep) of all buckets with several members. One shuffle, read as a stream."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))], ["key", "rep"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and rep. The last row of a batch waits for the next: it may be alone."""
        key, rep, leader, company = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)

        def out(keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, rep, leader)], ["key", "rep", "leader"])

        for batch in batches:
            if not batch.num_rows:
                continue
            had, was, accompanied = len(key), leader[-1:], company[-1:]
            key, rep = (np.append(x[-1:], batch.column(c).to_numpy()) for x, c in ((key, "key"), (rep, "rep")))
            same = np.append(False, key[1:] == key[:-1])
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
            leader = rep.copy()
            leader[: len(was)] = was
            leader = leader[first]
            company = same.copy()
            company[:-1] |= same[1:]
            company[: len(accompanied)] |= accompanied
            yield out(np.flatnonzero(company[:-1] if had or len(key) else company))
        if len(key) and company[-1]:
            yield out(np.array([len(key) - 1]))

    keys = signed.select("rep", "bands").mapInArrow(spread, "key long, rep long")
    return keys.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(group, "key long, rep long, leader long")


def in_chunks(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) and a chunk of about CHUNK partners for each, so that a leader with many is dealt out."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    hot = most_frequent(sizes, "n", HOT).select("a", F.ceil(F.col("n") / CHUNK).alias("chunks"))  # HOT rows at most
    return pairs.join(F.broadcast(hot), "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("chunks", F.lit(1))).alias("chunk"), "b")


def may_be_similar(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, chunk, b) whose sketches don't rule them out."""
    most = most_differing(NEED / 100)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sketch", "other"))
            keep = pa.array(np.flatnonzero(np.bitwise_count(x ^ y).sum(axis=1) <= most))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "chunk", "b")], ["a", "chunk", "b"])

    asked = in_chunks(pairs)
    leaders = asked.select("a", "chunk").distinct().join(signed.select(F.col("rep").alias("a"), F.col("sketch").alias("other")), "a")
    partners = asked.join(signed.select(F.col("rep").alias("b"), "sketch"), "b")
    return partners.join(leaders, ["a", "chunk"]).select("a", "chunk", "b", "sketch", "other").mapInArrow(compare, "a long, chunk long, b long")


def confirm(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of asked (a, chunk, b) that are similar enough by their full sets.

    A leader a is sent with each chunk of its partners, so a text travels once for each chunk it is in. Of several texts with
    one id, each is compared.
    """
    wanted = asked.select("a", "chunk", F.col("b").alias("doc_id"), F.lit(1).alias("partner")).union(asked.select("a", "chunk", F.col("a").alias("doc_id"), F.lit(0).alias("partner")).distinct())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders, whose = [], None
        for batch in slices(batches, "text", 1 << 20):
            sets, edges, _, _ = shingle_sets(batch.column("text"))
            out = []
            for i, (a, chunk, doc, partner) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "doc_id", "partner")), strict=True)):
                mine = sets[edges[i] : edges[i + 1]]
                if not partner:
                    if whose != (a, chunk):
                        leaders, whose = [], (a, chunk)
                    leaders.append(mine.copy())
                elif whose == (a, chunk) and any(similar(x, mine) for x in leaders):
                    out.append((a, doc))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    sent = wanted.join(texts, "doc_id").select("a", "chunk", "doc_id", "partner", "text")
    return sent.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "partner", "doc_id").mapInArrow(check, "a long, b long").distinct()


def unconnected_pairs(members: DataFrame, signed: DataFrame) -> DataFrame:
    """members: key, rep, component, odd (outside the bucket's largest component), blocks, odd_blocks (how many of each the
    bucket has). Pairs of different components in a bucket that may be similar: a row for each document of two blocks
    (key, i, j), with the documents it is to be compared with.

    A bucket's members fall into blocks of about BLOCK, and its odd ones into others; every odd block meets every block.
    """
    most = most_differing(NEED / 100)
    short = signed.select("rep", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("bands", i * 8 + 1, 4)).alias("parts"), "sketch").select("rep", F.array_join(F.transform("parts", F.hex), "").alias("parts"), "sketch")
    short = short.withColumn("parts", F.unhex("parts"))  # 32 bits of each band's key
    placed = members.join(short, "rep").withColumns({"block": F.pmod(F.xxhash64("rep"), "blocks").cast("int"), "odd_block": F.pmod(F.xxhash64("rep"), "odd_blocks").cast("int")})
    count = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["rep", "component", "odd", "parts", "sketch"]
    every = placed.withColumn("i", count("odd_blocks")).select("key", "i", F.col("block").alias("j"), F.lit(False).alias("asks"), *columns)
    asking = placed.where("odd").withColumn("j", count("blocks")).select("key", F.col("odd_block").alias("i"), "j", F.lit(True).alias("asks"), *columns)
    paired = asking.union(every)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            key, i, j = held[0][:3]
            asks, rep, component, odd = (np.array([x[k] for x in held], t) for k, t in ((3, bool), (4, np.int64), (5, np.int64), (6, bool)))
            parts = np.frombuffer(b"".join(x[7] for x in held), np.int32).reshape(len(held), BANDS)
            sketch = np.frombuffer(b"".join(x[8] for x in held), np.uint64).reshape(len(held), -1)
            own = np.array([key], np.int64).view(np.int32)[0]
            held.clear()
            partners, involved = [b""] * len(rep), np.zeros(len(rep), bool)
            for x in np.flatnonzero(asks):
                ys = np.flatnonzero(~asks & (component != component[x]) & (~odd | (rep > rep[x])))
                ys = ys[np.bitwise_count(sketch[ys] ^ sketch[x]).sum(axis=1) <= most]
                if len(ys):
                    ys = ys[parts[x][(parts[ys] == parts[x]).argmax(axis=1)] == own]
                    partners[x] = rep[ys].tobytes()
                    involved[ys] = True
                    involved[x] |= len(ys) > 0
            who = np.flatnonzero(involved)
            return pa.RecordBatch.from_arrays([pa.array([key] * len(who), pa.int64()), pa.array([i] * len(who), pa.int32()), pa.array([j] * len(who), pa.int32()), pa.array(rep[who]), pa.array([partners[x] for x in who], pa.binary())], ["key", "i", "j", "doc_id", "partners"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield out()
                held.append(row)
        if held:
            yield out()

    return paired.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "key long, i int, j int, doc_id long, partners binary")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if not len(x) or not len(y):
        return False
    same = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * same >= NEED * (len(x) + len(y) - same)


def confirm_blocks(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b) among what unconnected_pairs has found; a group holds the sets of two blocks at most."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        wanted: list[tuple[int, bytes]] = []
        now = None

        def out() -> pa.RecordBatch:
            links = [(a, b) for a, raw in wanted for b in np.frombuffer(raw, np.int64).tolist() if any(similar(x, y) for x in held[a] for y in held[b])]
            held.clear()
            wanted.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in slices(batches, "text", 1 << 20):
            sets, edges, _, _ = shingle_sets(batch.column("text"))
            for n, (*group, doc, partners) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "doc_id", "partners")), strict=True)):
                if group != now and held:
                    yield out()
                now = group
                held.setdefault(doc, []).append(sets[edges[n] : edges[n + 1]].copy())
                if partners:
                    wanted.append((doc, partners))
        if held:
            yield out()

    sent = rows.join(texts, "doc_id").select("key", "i", "j", "doc_id", "partners", "text")
    return sent.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Null texts and texts without words have no shingles and link with nothing. Rows with one doc_id are one document with
    several texts. A null doc_id takes no part: its component_id is null, and it isn't kept. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signs = materialize(digest(docs), "signs")
    classes = signs.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    signed = materialize(signs.select("doc_id", "h1", "h2", "bands", "sketch").join(classes.withColumn("doc_id", F.col("rep")), ["doc_id", "h1", "h2"]).select("rep", "bands", "sketch").dropDuplicates(["rep", "bands"]), "signed")
    buckets = materialize(buckets_of(signed), "buckets")
    texts = materialize(docs.join(buckets.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id"), "texts")
    stars = may_be_similar(buckets.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), signed)
    links = materialize(confirm(materialize(stars, "stars"), texts), "star-links")
    first = components(links)
    labelled = buckets.select("key", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = materialize(parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1 AND n > 2"), "mixed")
    blocks = {"blocks": F.ceil(F.col("n") / BLOCK).cast("int"), "odd_blocks": F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int"), "main": F.col("main.component")}
    # a large bucket's rows are dealt out by key and salt, for the bucket's rows on the other side are few
    salted = mixed.withColumns(blocks).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("n", "parts")
    salts = mixed.where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("salts"))
    hot = most_frequent(salts, "salts", HOT)
    dealt = labelled.join(F.broadcast(hot), "key", "left").withColumn("salt", F.pmod(F.xxhash64("rep"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    target = salted.join(F.broadcast(hot), "key", "left").where("salt < coalesce(salts, 1)").drop("salts")
    members = dealt.join(target, ["key", "salt"]).withColumn("odd", F.col("component") != F.col("main")).drop("salt", "main")
    rest = materialize(unconnected_pairs(members, signed), "rest")
    ends = components(links.union(confirm_blocks(rest, texts)))
    out = signs.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left").withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")))
    out = out.join(ends.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
