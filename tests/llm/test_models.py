"""Language, quality and language model: brute force, accuracy, and odd input."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language, language_model, quality
from lodestone.llm.language import bind, identify, trigrams
from lodestone.llm.quality import kth_largest, resample, sample_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_trigrams_are_those_of_each_text():
    texts = ["ab c", "", "12", "x", "a  b!", "É x", "Ünï"]
    text, gram, count, letters, n = trigrams(texts)
    for i, t in enumerate(texts):
        s = re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in f" {t} "))
        want = Counter(s[j : j + 3] for j in range(len(s) - 2)) if s.strip() else Counter()
        assert {"".join(chr(c) if c else " " for c in letters[g]): k for a, g, k in zip(text, gram, count) if a == i} == want
        assert n[i] == sum(c.isalpha() for c in t)


def test_bound_vectors_are_nearly_orthogonal_and_ordered():
    v = bind(np.array([[97, 98, 99], [99, 98, 97], [97, 98, 100]]), 4096, 7).astype(float)
    assert set(np.unique(v)) == {-1.0, 1.0} and np.abs(np.corrcoef(v) - np.eye(3)).max() < 0.08


def test_languages(spark, sf_dir):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = language.op3_language_id(spark, sf_dir).collect()
    assert len(rows) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {*docs.values(), "und"} for r in rows)


def test_languages_by_brute_force(spark):
    """Bundles, prototypes, cosines and scores, letter by letter."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("The dog!", "en"), ("le chat est là", "fr"), ("der Hund", "de"), ("a dog sat", None), ("chat", None), ("42", None), (None, "fr"), ("", "de")])]
    train = F.col("lang").isNotNull()
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2), train=train).collect()
    vector = {}

    def letter(c):
        if c not in vector:
            vector[c] = language.letter_vectors(np.array([ord(c) if c != " " else 0]), language.DIMENSIONS, language.SEED)[0].astype(int)
        return vector[c]

    def bundle(text):
        s = re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in f" {text or ''} "))
        out = np.zeros(language.DIMENSIONS, int)
        for j in range(len(s) - 2 if s.strip() else 0):
            out += np.roll(letter(s[j]), 2) * np.roll(letter(s[j + 1]), 1) * letter(s[j + 2])
        return out

    prototypes = {}
    for _, t, lang in rows:
        if lang is not None:
            prototypes[lang] = prototypes.get(lang, 0) + bundle(t)
    for r in got:
        b = bundle(r["text"])
        if not b.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        cosine = {n: float(b @ p / np.linalg.norm(b) / np.linalg.norm(p)) for n, p in prototypes.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(min(1, max(0, cosine[best])), abs=1e-6)


def test_language_of_odd_documents(odd_docs, no_docs):
    rows = identify(odd_docs).collect()
    assert len(rows) == odd_docs.count() and set(rows[0].asDict()) == {*odd_docs.columns, "lang_pred"}
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_prediction_does_not_read_the_label(odd_docs):
    train = F.col("doc_id") < 10
    a = identify(odd_docs, train=train)
    b = identify(odd_docs.withColumn("lang", F.when(train, F.col("lang"))), train=train)
    pick = lambda d: sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in d.collect())
    assert pick(a) == pick(b)


def test_quality(spark, sf_dir):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = quality.op5_quality_resampling(spark, sf_dir).collect()
    good = [r["selected"] for r in rows if labels.get(r["doc_id"]) == (1, 0)]
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and sum(good) >= 0.99 * len(good)
    assert not all(r["selected"] for r in rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = sample_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["selected"]}


def test_weights_by_brute_force():
    texts = ["abcdabcd", "abcdx", "zzzzz", "ab", None]
    row, bucket, n = quality.grams(pa.array(texts))
    for i, t in enumerate(texts):
        want = Counter((t or "")[j : j + 4] for j in range(len(t or "") - 3))
        assert sorted(n[row == i]) == sorted(want.values())
    counts = np.zeros((2, quality.BUCKETS), np.int64)
    np.add.at(counts[1], bucket, n)
    good = np.array([True, False, False, False, False])
    np.add.at(counts[0], bucket[good[row]], n[good[row]])
    weight, total = quality.log_weights(pa.array(texts), good, counts)
    assert list(total) == [5, 2, 2, 0, 0] and weight[3] == weight[4] == 0
    share, by = 5 / (9 - 2), {b: counts[:, b] for b in bucket[row == 1]}
    want = sum(math.log((c[0] + 5) / ((c[1] - 1) * share + 5)) for c in by.values())
    assert math.isclose(weight[1], want)


def test_quality_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (9, 0, 0), (None, 1, 0), (100, None, None)], "doc_id long, quality int, toxic int")
    assert resample(odd_docs, labels).count() == odd_docs.count() and resample(no_docs, labels).count() == 0
    assert all(r["selected"] for r in resample(odd_docs, labels.where("quality = 7")).collect())
    assert sample_rows(odd_docs, labels).columns == odd_docs.columns
    for k in (0, 3):
        rows = resample(odd_docs, labels, k=k).collect()
        keys = sorted((r["sample_key"] for r in rows), reverse=True)
        assert {r["sample_key"] for r in rows if r["selected"]} == set(keys[:k])


def test_kth_largest(spark):
    values = [-(2**63), -5, -5, 0, 3, 3, 3, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, len(values) + 1):
        assert kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, "v", 100) is None


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def check_lm(rows, docs):
    """docs: (doc_id, text). Exact columns by brute force."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens(t))
    key = lambda x: (str(x[0]), *x[1:])
    want = sorted(((i, held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), total, round(base(t), 6)) for i, t in docs), key=key)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=key) == want
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)


@pytest.mark.parametrize("part", [20_000, 1_000_000])
def test_op7(spark, sf_dir, monkeypatch, part):
    monkeypatch.setattr(language_model, "PART", part)
    rows = language_model.op7_pitman_yor_lm(spark, sf_dir).collect()
    check_lm(rows, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])
    held = [r for r in rows if r["held_out"]]
    perplexity = lambda c: 10 ** (-sum(r[c] for r in held) / sum(r["n_tokens"] for r in held))
    assert perplexity("score") < 0.6 * perplexity("base_score")


def test_lm_of_odd_documents(odd_docs, no_docs):
    docs = odd_docs.collect()
    check_lm(language_model.score_documents(odd_docs).collect(), [(r["doc_id"], r["text"]) for r in docs])
    assert language_model.score_documents(no_docs).count() == 0
    untrained = language_model.score_documents(odd_docs, train=F.lit(False)).collect()
    assert len(untrained) == len(docs) and all(r["train_tokens"] == r["n_known"] == 0 for r in untrained)


def make_part(near, far, word, count):
    """A part of triples that are given by numbers."""
    names = [np.asarray(x, np.uint64) + np.uint64(1) for x in (near, far, word)]
    order = np.lexsort((names[2], language_model.mix(names[0] + names[1] * language_model._FAR), names[0]))  # as a part orders them
    n, f, w = (x[order] for x in names)
    own = language_model.runs(n)
    block = [n[own], np.diff(np.append(own, len(n))), f - np.uint64(1), w - np.uint64(1), np.asarray(count)[order], np.ones(len(n), np.int64), np.zeros(len(n), np.int64), np.arange(1, 200, dtype=np.uint64)]
    return language_model.Part([(0, language_model.pack(block))], np.zeros(0, np.uint64)), order


def make_model(part, total):
    model = language_model.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), total, len(part.words), 1)
    model.discounts = (0.5, 0.6, 0.7)
    return model


def settle(model, part, rounds=15):
    """How many tables the root has, as the passes over a corpus learn it."""
    zero, random = np.zeros(len(part.words)), np.random.Generator(np.random.PCG64(2))
    for i in range(rounds):
        tables = []
        for _, _, _, own, _ in model.seat(part, i, 20, zero, zero):
            tables.append(language_model.draw_tables(own, np.full(len(own), (1 + model.discounts[0] * model.tables) / (model.distinct + 1)), model.discounts[0], random).sum())
        model.tables = float(np.mean(tables))


def test_probabilities_of_a_context_add_up_to_one():
    """Over all words and one unknown word, for restaurants with and without customers."""
    rng = np.random.default_rng(0)
    every = [(n, f, w) for n in range(3) for f in range(3) for w in range(30)]
    count = [int(rng.integers(1, 5)) if n < 2 and f < 2 and rng.random() < 0.3 else 0 for n, f, _ in every]
    part, _ = make_part(*zip(*every, strict=True), count)
    model = make_model(part, sum(count))
    settle(model, part)
    *_, (_, _, _, own, probability) = model.seat(part, 1, 1, np.zeros(30), np.zeros(30))
    sums = np.bincount(part.pair, probability)
    assert np.all(np.abs(sums - 1) < 0.1) and len(sums) == 9


class Restaurants:
    """Customer by customer: the yardstick of a part's seating. Tables are lists of sizes by restaurant and dish."""

    def __init__(self, discounts, words, rng):
        self.d, self.words, self.rng, self.tables = discounts, words, rng, [{}, {}, {}]

    def key(self, level, near, far):
        return (() if level == 0 else (near,) if level == 1 else (near, far))

    def chance(self, level, near, far, w):
        if level < 0:
            return 1 / (self.words + 1)
        dishes = self.tables[level].get(self.key(level, near, far), {})
        c, t = sum(map(sum, dishes.values())), sum(map(len, dishes.values()))
        mine = dishes.get(w, [])
        return (sum(mine) - self.d[level] * len(mine) + (1 + self.d[level] * t) * self.chance(level - 1, near, far, w)) / (1 + c)

    def add(self, level, near, far, w):
        dishes = self.tables[level].setdefault(self.key(level, near, far), {})
        mine = dishes.setdefault(w, [])
        weights = [x - self.d[level] for x in mine] + [(1 + self.d[level] * sum(map(len, dishes.values()))) * self.chance(level - 1, near, far, w)]
        i = int(np.searchsorted(np.cumsum(weights), self.rng.random() * sum(weights)))
        if i < len(mine):
            mine[i] += 1
        else:
            mine.append(1)
            if level:
                self.add(level - 1, near, far, w)

    def remove(self, level, near, far, w):
        mine = self.tables[level][self.key(level, near, far)][w]
        i = int(np.searchsorted(np.cumsum(mine), self.rng.random() * sum(mine), side="right"))
        mine[i] -= 1
        if not mine[i]:
            del mine[i]
            if level:
                self.remove(level - 1, near, far, w)


def test_a_part_is_seated_as_customer_by_customer():
    """Numbers of tables of every level, and probabilities, against a sampler of single customers."""
    rng = np.random.default_rng(3)
    tokens_ = [(int(n), int(f), int(w)) for n, f, w in zip(rng.integers(0, 4, 500), rng.integers(0, 3, 500), rng.zipf(1.6, 500) % 12)]
    seen = Counter(tokens_)
    part, order = make_part(*zip(*seen, strict=True), list(seen.values()))
    model = make_model(part, 500)
    settle(model, part)
    mine, probability, zero = [], [], np.zeros(len(part.words))
    for i, (t3, _, t2, _, p) in enumerate(model.seat(part, 5, 400, zero, zero)):
        if i >= 50:
            mine.append((t3.sum(), t2.sum()))
            probability.append(p)
    whole = Restaurants(model.discounts, len(part.words), rng)
    theirs, want = [], []
    for t in tokens_:
        whole.add(2, *t)
    for sweep in range(120):
        for t in tokens_:
            whole.remove(2, *t)
            whole.add(2, *t)
        if sweep >= 20:
            theirs.append([sum(len(x) for r in whole.tables[k].values() for x in r.values()) for k in (2, 1, 0)])
            want.append([whole.chance(2, *t) for t in seen])
    a, b = np.append(np.mean(mine, axis=0), model.tables), np.mean(theirs, axis=0)
    assert np.all(np.abs(a / b - 1) < (0.06, 0.1, 0.15)), (a, b)  # draws of dishes together are near, not equal, to those of single customers
    got, expected = np.log10(np.mean(probability, axis=0)), np.log10(np.mean(want, axis=0))
    by_triple = dict(zip(seen, expected, strict=True))
    in_order = [list(seen)[i] for i in order]
    off = got - [by_triple[t] for t in in_order]
    assert np.mean(np.abs(off)) < 0.02 and abs(np.mean(off)) < 0.005


def test_seating_keeps_its_customers():
    rng = np.random.Generator(np.random.PCG64(3))
    customers = np.array([0, 1, 2, 5, 1000, 3])
    opens = np.array([0.1, 0.1, 5.0, 0.5, 20.0, 1e-9])
    seats = language_model.Seating(customers, opens, 0.5, 200, rng)
    for _ in range(200):
        seats.step(opens)
        sums = np.add.reduceat(seats.sizes, seats.start[:-1])
        tables = np.add.reduceat((seats.sizes > 0).astype(int), seats.start[:-1])
        assert list(sums) == [2, 5, 1000, 3] and list(tables) == list(seats.t) and seats.sizes.min() >= 0
    assert list(seats.tables[:2]) == [0, 1] and seats.tables[5] == 1 and seats.tables[4] > 5


def test_two_customers_share_a_table_as_often_as_they_should():
    rng = np.random.Generator(np.random.PCG64(8))
    n, a, d = 20_000, 0.8, 0.3
    seats = language_model.Seating(np.full(n, 2), np.full(n, a), d, 30, rng)
    for _ in range(30):
        seats.step(np.full(n, a))
    assert abs((seats.tables == 2).mean() - a / (a + 1 - d)) < 0.02


@pytest.mark.parametrize("part", [3_000, 1_000_000])
def test_rare_words_score_as_known_ones(spark, monkeypatch, part):
    """Words whose customers are shuffled score as they do when all are broadcast: each of 600 contexts has its own next word."""
    monkeypatch.setattr(language_model, "PART", part)
    docs = spark.createDataFrame([(i, " ".join(f"{j}xx {j}yy" for j in range(i % 7, 600, 7))) for i in range(140)], "doc_id long, text string").repartition(3)
    near, far = ({r["doc_id"]: r["score"] / r["n_tokens"] for r in language_model.score_documents(docs, words_kept=k).collect()} for k in (language_model.KNOWN, 0))
    assert max(abs(near[i] - far[i]) for i in near) < 0.02


def test_rooms_change_little(spark, monkeypatch, sf_dir):
    """Near words dealt out into rooms of 300 tokens, against one room each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = lambda: (lambda rows: sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows))([r for r in language_model.score_documents(docs).collect() if r["held_out"]])
    one = held()
    monkeypatch.setattr(language_model, "ROOM", 300)
    assert abs(held() - one) < 0.05


def test_a_text_that_was_seen_twice_scores_higher(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(8)
    words = [f"q{i}" for i in range(400)]
    own = [(10**6 + i, " ".join(rng.choice(words, 60))) for i in range(40)]
    own = [x for x in own if zlib.crc32(str(x[0]).encode()) % 7 != 2]
    twice = [(2 * 10**6 + i, t) for i, t in own[: len(own) // 2] if zlib.crc32(str(2 * 10**6 + i).encode()) % 7 != 2]
    copied = {i - 2 * 10**6 for i, _ in twice}
    rows = {r["doc_id"]: r["score"] / r["n_tokens"] for r in language_model.score_documents(docs.union(spark.createDataFrame(own + twice, docs.schema))).collect()}
    assert min(rows[i] for i, _ in own if i in copied) > max(rows[i] for i, _ in own if i not in copied)


def test_no_two_contexts_share_a_restaurant():
    word = np.arange(1, 20_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    model = language_model.Model(word[:0], np.zeros(0, np.int64), np.sort(word[:5]), np.full(5, 3, np.uint64), 1, 1, 1)
    far = np.roll(word, 7)
    assert len(np.unique(model.restaurant(word, far))) == len(word)
    assert len(np.unique(model.restaurant(np.repeat(np.sort(word[:5]), 1000), np.tile(far[:1000], 5)))) == 15
    near, before = language_model.before(np.array([5, 6, language_model.END, 7, language_model.END, language_model.END], np.uint64))
    end = language_model.END
    assert list(near) == [end, 5, 6, end, 7, end] and list(before) == [end, end, 5, end, end, end]


def test_a_part_travels_whole():
    rng = np.random.default_rng(4)
    triple = {(int(a), int(b), int(c)) for a, b, c in rng.integers(0, 9, (300, 3))}
    part, _ = make_part(*zip(*triple, strict=True), rng.integers(0, 4, len(triple)))
    part.held = [(7, rng.permutation(len(part.count))[:50], np.full(50, 2, np.uint8), np.arange(100, dtype=np.uint8))]
    other = language_model.Part.unpacked(part.pack())
    for name in ("words", "near", "pair", "word", "count", "own", "dish", "dish_near", "dish_word"):
        assert np.array_equal(getattr(part, name), getattr(other, name)), name
    pairs = lambda p: {(int(n), int(d)) for _, number, occurs, doc in p.held for n, d in zip(np.repeat(number, occurs), doc, strict=True)}
    assert pairs(part) == pairs(other)


@pytest.mark.parametrize("opens", [1.0, 20.0])
def test_tables_of_frequent_pairs_are_those_of_full_sweeps(opens):
    """300 customers a pair, against sweeps of every customer from the start formula."""
    rng = np.random.Generator(np.random.PCG64(5))
    n, c, d = 60, 300, 0.75
    drawn = language_model.draw_tables(np.full(20_000, c), np.full(20_000, opens), d, rng)
    seats = language_model.Seating(np.full(n, c), np.full(n, opens), d, c, rng)
    means = []
    for step in range(60 * c):
        seats.step(np.full(n, opens))
        if step >= 30 * c and step % c == 0:
            means.append(seats.tables.mean())
    assert abs(drawn.mean() - np.mean(means)) < 0.06 * drawn.mean() + 0.1


def test_the_law_of_many_customers_goes_on_from_the_table():
    rng = np.random.Generator(np.random.PCG64(6))
    for d in (0.5, 0.75, 0.9):
        for opens in (0.01, 1.0, 20.0, 1000.0):
            a, b = (language_model.draw_tables(np.full(20_000, language_model.EXACT + i), np.full(20_000, opens), d, rng) for i in (0, 1))
            assert abs(a.mean() - b.mean()) < 0.02 * a.mean() + 0.05 and abs(a.std() - b.std()) < 0.05 * a.std() + 0.05


def test_groups_of_parts_hold_what_single_parts_hold(spark, sf_dir, monkeypatch):
    """Parts are the same whether their blocks came alone or with others."""
    docs = language_model.table(spark, sf_dir, "documents")
    monkeypatch.setattr(language_model, "PART", 10_000)
    made = []
    for split in (10**9, 1):
        monkeypatch.setattr(language_model, "SPLIT", split)
        made.append({r["doc_id"]: r for r in language_model.score_documents(docs).collect()})
    alone, together = made
    assert len(alone) == docs.select("doc_id").distinct().count() and alone.keys() == together.keys()
    for k, r in alone.items():
        assert r["n_known"] == together[k]["n_known"] and abs(r["base_score"] - together[k]["base_score"]) < 1e-6 and abs(r["score"] - together[k]["score"]) < 1e-6 * r["n_tokens"]


def test_names_are_packed_by_their_steps():
    names = np.sort(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)) * np.uint64(2)
    odd = np.array([5, 2**64 - 1, 0, 7], np.uint64)
    assert [x.tolist() for x in language_model.unpack(language_model.pack([names, odd, np.arange(3)]))] == [names.tolist(), odd.tolist(), [0, 1, 2]]
    near = np.cumsum(np.full(5000, 2**50, np.uint64) + names % np.uint64(2**32 + 1))
    plain = [near.view(np.int64)]
    assert len(language_model.pack([near])) < 0.8 * len(language_model.pack(plain))


def test_shuffle_files_go_with_their_job(spark):
    from lodestone.llm import common

    files = lambda: spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(",").count("shuffle_")
    before = files()
    kept = common.materialize(spark.range(1000).repartition(3, "id"), "kept", once=True)
    assert files() <= before
    assert kept.count() == 1000 and spark.conf.get(common.CLEANUP, "false") != "true"


def test_tables_are_drawn_from_a_bounded_number_of_weights(monkeypatch):
    """Weights that are left out are too small to tell, and the draws don't depend on how many are taken at once."""
    law = language_model.seatings(0.6)
    c = np.arange(2, language_model.EXACT + 1)
    for log_opens in (-9.0, 0.0, 9.0):
        low, high = language_model.likely(law, c, np.full(len(c), log_opens))
        for i in range(0, len(c), 37):
            w = law[c[i], 1 : c[i] + 1] + np.arange(1, c[i] + 1) * log_opens
            likely = np.flatnonzero(w >= w.max() - language_model.FAINT) + 1
            assert (low[i], high[i]) == (likely[0], likely[-1])
    drawn = [language_model.draw_tables(c, np.full(len(c), 3.0), 0.6, np.random.default_rng(1))]
    monkeypatch.setattr(language_model, "WEIGHTS", 100)
    drawn.append(language_model.draw_tables(c, np.full(len(c), 3.0), 0.6, np.random.default_rng(1)))
    assert (drawn[0] == drawn[1]).all()


def test_tables_of_few_customers_follow_their_law():
    rng = np.random.Generator(np.random.PCG64(8))
    law, n = language_model.seatings(0.7), 40_000
    for c in (2, 3, language_model.FEW, language_model.FEW + 1):
        for opens in (1e-6, 0.4, 3.0, 1e6):
            w = law[c, 1 : c + 1] + np.arange(1, c + 1) * np.log(opens)
            want = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
            got = np.bincount(language_model.draw_tables(np.full(n, c), np.full(n, opens), 0.7, rng), minlength=c + 1)[1:] / n
            assert len(got) == c and np.abs(got - want).max() < 0.012


def test_parts_are_in_a_column_of_their_own(spark, sf_dir, monkeypatch):
    """Who reads the documents' rows doesn't read the parts, which are larger by far."""
    made, materialize = {}, language_model.materialize

    def kept(df, name, **options):
        made[name] = materialize(df, name, **options)
        return made[name]

    monkeypatch.setattr(language_model, "materialize", kept)
    language_model.op7_pitman_yor_lm(spark, sf_dir)
    rows = made["parts"].selectExpr("part < 0 AS docs", "payload IS NOT NULL AS payload", "whole IS NOT NULL AS whole").distinct().collect()
    assert {tuple(r) for r in rows} == {(True, True, False), (False, False, True)}
