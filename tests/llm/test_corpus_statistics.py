"""Tokeniser fertility, collocations and ranked search against brute force."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import collocations, fertility, lexical_search
from lodestone.llm.tokens import byte_bpe

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


@pytest.mark.parametrize("at_once", [16, 1 << 20])
def test_base_counts(odd_docs, no_docs, monkeypatch, at_once):
    monkeypatch.setattr(fertility, "AT_ONCE", at_once)
    rows = fertility.judge(odd_docs).collect()
    got = sorted((str(r["doc_id"]), *(r[c] for c in fertility.BASE)) for r in rows)
    assert got == sorted((str(r["doc_id"]), *base(r["text"])) for r in odd_docs.collect())
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
        assert r["base_failed"] or r["kept"]  # too few texts for bands
    assert fertility.judge(no_docs).count() == 0


def test_repeated_words():
    rng = random.Random(5)
    for _ in range(100):
        docs = [[rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 50))] for _ in range(4)]
        index = defaultdict(itertools.count().__next__)
        ids = [fertility.word_ids(" ".join(d).encode(), index, 9) for d in docs]
        assert fertility.repeated_words(ids).tolist() == [base(" ".join(d))[4] for d in docs]


def test_measures():
    text = "ordinary words follow each other here, ünd 텍 too. " * 6
    counts, ids, words = fertility.base_counts([text, "x" * 9000])
    found = fertility.measures_of([text, "x" * 9000], counts, ids, words, np.array([True, True]), *PATHS)
    tokens = byte_bpe(PATHS[0]).ids(text)
    assert math.isclose(found[0][0], len(text) / len(tokens))
    entropies = []
    for i in range(0, len(tokens) - 63, 64):
        n = np.array(list(Counter(tokens[i : i + 64].tolist()).values())) / 64
        entropies.append(-(n * np.log2(n)).sum() / 6)
    assert math.isclose(found[0][3], np.mean(entropies))
    model, is_byte = fertility._pieces(PATHS[1])
    pieces = [p for w in text.split() for p in model.encode(w)]
    assert math.isclose(found[0][1], len(text.replace(" ", "")) / len(pieces)) and math.isclose(found[0][2], sum(is_byte[p] for p in pieces) / len(pieces))
    assert found[1][1] > 1 and "".join(fertility.cut(text, 10)) == text


def test_bands_by_brute_force_and_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    rows = fertility.op11_tokeniser_fertility(spark, sf_dir).collect()
    groups = defaultdict(set)
    for r in rows:
        if r["entropy"] is not None:
            groups[r["grp"]].add((r["n_words"], *(r[m] for m in fertility.WIDTHS)))
    bands = {g: {m: np.percentile([round(x[i + 1], 3) for x in v], [25, 75]) for i, m in enumerate(fertility.WIDTHS)} for g, v in groups.items()}
    for r in rows:
        out = set()
        for m, (width, least) in fertility.WIDTHS.items():
            if r["entropy"] is not None:
                q1, q3 = bands[r["grp"]][m]
                reach = width * max(q3 - q1, least)
                out |= {m} if (r[m] < q1 - reach and fertility.ONE_SIDED.get(m) != "high") or (r[m] > q3 + reach and fertility.ONE_SIDED.get(m) != "low") else set()
        assert set(filter(None, r["rejected_by"].split(","))) == out and r["kept"] == (not r["base_failed"] and not out)
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = defaultdict(list)
    for r in rows:
        if r["doc_id"] in good:
            kept[good[r["doc_id"]]].append(r["kept"])
    assert np.mean(kept[1]) > 0.97 and np.mean(kept[0]) < 0.15


def phrases(rows, least=30, most=2000):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = lang if lang is not None else "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in count.items():
        frequent = {p: n for p, n in c.items() if n >= least}
        around = Counter()
        for p, n in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], n)
        found = []
        for p, a in frequent.items():
            if len(p) >= 2 and 100 * around[p] < 80 * a:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def made_up(seed, n=400):
    rng = random.Random(seed)
    words = ["New", "york", "city", "a", "b", "über", "İx", "a b", "x\x1cy", "ß", "c\x85"]
    sign = [" ", "  ", "\t", " \t", ", ", ". ", "\n", "\r\n", "; ", "\x0b", "!?", " "]
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(words[: rng.randint(2, 11)]) + rng.choice(sign[: rng.randint(2, 12)]) for _ in range(rng.randint(0, 40)))) for _ in range(n)] + [("en", None), ("fr", ""), (None, "new york city " * 500), ("en", " ,. ")]


@pytest.mark.parametrize(("seed", "least", "most"), [(1, 30, 2000), (2, 5, 15)])
def test_collocations(spark, seed, least, most):
    rows = made_up(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, f int").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=least, most=most).collect())
    assert got == phrases(rows, least, most) and len(got) > 10


def test_collocations_of_odd_texts(odd_docs, no_docs):
    got = sorted(tuple(r) for r in collocations.collocations(odd_docs, least=2).collect())
    assert got == phrases([(r["lang"], r["text"]) for r in odd_docs.collect()], 2)
    assert collocations.collocations(no_docs).count() == 0


def test_large_counts_stay_exact(spark):
    big = 3_000_000_000_000_007
    counts = spark.createDataFrame([("en", "a", 4 * big), ("en", "b", 5 * big + 1)], "lang string, phrase string, f long")
    (r,) = collocations.part_counts(spark.createDataFrame([("en", "a b", 3 * big)], "lang string, phrase string, f long"), counts).collect()
    assert (r["l"], r["r"], r["score"]) == (4 * big, 5 * big + 1, 2_000_000 * 3 * big // (9 * big + 1))


def test_marks_have_no_false_negatives(spark):
    rng = random.Random(7)
    pieces = [" ".join(rng.choice(["a", "bb", "ü"]) for _ in range(3)) for _ in range(30)]
    marks = collocations.bit_map(spark.createDataFrame([("en", p) for p in pieces], "lang string, phrase string"), 3)
    import pyarrow as pa

    _, _, _, _, hashes = collocations.grams(pa.array(["en"] * len(pieces)), pa.array(pieces), 3, None)
    assert len(hashes) == 30 and collocations.marked(marks, hashes).all()
    _, _, _, _, others = collocations.grams(pa.array(["de"] * len(pieces)), pa.array(pieces), 3, None)
    assert not collocations.marked(marks, others).any()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(docs, items, k=50):
    docs = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n, length = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in docs:
            m = 100 - 50 + (50 * c.total() * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "query_bytes", "at_once", "block"), [(50, 16 << 20, 1 << 21, 8192), (3, 100, 5, 2)])
def test_ranked_search(spark, odd_docs, no_docs, monkeypatch, k, query_bytes, at_once, block):
    monkeypatch.setattr(lexical_search, "AT_ONCE", at_once)
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "PIECE", 1 << 10)
    items = [(1, "hello World hello"), (2, None), (3, ""), (4, "ünïcödé x word the_fox"), (5, "nothing-of-this 5678"), (7, "a b c again dog")]
    queries = spark.createDataFrame([(*r, 1) for r in items], "query_id long, text string, q int")
    got = sorted(tuple(r) for r in lexical_search.rank_documents(odd_docs, queries, k, query_bytes).collect())
    assert got == ranking([(r["doc_id"], r["text"]) for r in odd_docs.collect()], items, k)
    assert lexical_search.rank_documents(no_docs, queries, k, query_bytes).count() == 0
    assert lexical_search.rank_documents(odd_docs, queries.limit(0)).count() == 0


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000, dtype=np.uint64) >> np.uint64(8) << np.uint64(8)
    assert (lexical_search.radix_argsort(keys) == np.argsort(keys, kind="stable")).all()
    got, sums = lexical_search.accumulate(keys % np.uint64(97), np.arange(5000))
    assert sums.tolist() == [np.arange(5000)[keys % np.uint64(97) == x].sum() for x in got]


@pytest.mark.parametrize(("query", "sql"), [(collocations.op12_phrase_collocations, collocations.OP12_SQL), (lexical_search.op13_lexical_search, lexical_search.OP13_SQL)])
def test_against_sql(spark, sf_dir, query, sql):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    df = query(spark, sf_dir)
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(found.fetchall())
