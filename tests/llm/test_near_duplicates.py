import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import near_duplicates as nd
from lodestone.llm.components import components
from lodestone.llm.shingles import minhash, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_force(docs):
    """Of (doc_id, text): doc_id, set size, smallest id reachable."""
    sets = [(i, shingles(t)) for i, t in docs]
    holders = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(n)
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, s) in enumerate(sets):
        if i is None:
            continue
        for m, same in Counter(m for x in s for m in holders[x] if m < n).items():
            j, other = sets[m]
            if j is not None and 100 * same >= 75 * (len(s) + len(other) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str)


def test_odd_documents(odd_docs, no_docs):
    assert got(nd.near_duplicates(odd_docs)) == brute_force([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert nd.near_duplicates(no_docs).count() == 0


def test_op2(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(nd.op2_minhash_near_dedup(spark, sf_dir)) == brute_force(docs)


@pytest.mark.parametrize("block", [4, 512])
def test_a_large_family_of_edited_copies(spark, monkeypatch, block):
    """Copies of one text with several edits each: many pairs lie on either side of the threshold. The text itself comes last."""
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(90):
        words = list(base)
        for p in rng.choice(150, rng.integers(1, 9), replace=False):
            words[p] = f"x{rng.integers(1e6)}"
        docs.append((i, " ".join(words)))
    docs += [(200 + i, " ".join(f"{c}{i}" for c in range(40))) for i in range(20)] + [(500, " ".join(base)), (501, " ".join(base).upper())]
    assert got(nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute_force(docs)


def test_threshold_is_inclusive(spark):
    a = [f"a{i}" for i in range(11)]  # 7 shingles
    docs = [(1, " ".join(a)), (2, " ".join(a[:-1])), (3, " ".join(a[:-2])), (4, "one two three"), (5, "ONE two\tthree"), (6, "one two")]
    assert got(nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute_force(docs)


def test_sketches_estimate_what_sets_share():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    most = nd.most_differing(0.75)
    for share, keep in ((1.0, True), (0.9, True), (0.8, True), (0.75, True), (0.5, False), (0.1, False)):
        n = round(2 * 1000 * share / (1 + share))
        y = np.sort(np.append(x[rng.permutation(1000)[:n]], rng.integers(0, 2**63, 1000 - n, dtype=np.uint64)))
        samples = minhash(np.append(x, y), np.array([0, 1000, 2000]), nd.SAMPLES)
        a, b = nd.odd_sketches(samples).view(np.uint64)
        assert (np.bitwise_count(a ^ b).sum() <= most) == keep


def test_sets_are_those_of_the_words():
    texts = ["a b c d e f", "A  b\tc\nd e F", "a b", "", None, "x y z w v x y z w v x y z w v"]
    sets, edges, _, _ = shingle_sets(pa.array(texts))
    assert [int(n) for n in np.diff(edges)] == [len(shingles(t)) for t in texts]
    assert list(sets[edges[0] : edges[1]]) == list(sets[edges[1] : edges[2]])


def test_components_of_a_long_path(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 10 + n)] + [(3, 2), (2, 3), (5, 5)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {i: 10 for i in range(10, 11 + n)} | {2: 2, 3: 2}
    assert components(links.where("a < 0")).count() == 0


def test_no_cross_join_in_the_plan(spark, sf_dir):
    plan = nd.op2_minhash_near_dedup(spark, sf_dir).select(F.count("*"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
