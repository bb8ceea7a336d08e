"""Counts, packing and piece encoding against the libraries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from lodestone.llm import packing, piece_bpe, token_counts
from lodestone.llm.packing import best_fit, pack_documents
from lodestone.llm.piece_bpe import PieceBPE, encode_documents
from lodestone.llm.token_counts import count_tokens
from lodestone.llm.tokens import COMMON, byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_common_characters_split_as_the_library_does():
    bpe = byte_bpe(PATH)
    for low, high in COMMON:
        for c in map(chr, range(low, high + 1)):
            s = f"a{c}1 {c}{c} x{c}!  {c}"
            assert bpe._plain(s) == [s[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(s)]
            assert list(bpe.ids(s)) == ids(s)


@pytest.mark.parametrize("frequent", [0, 5, 100_000])
def test_counts(odd_docs, no_docs, frequent):
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(ids(r["text"]))) for r in odd_docs.collect()), key=str)
    got = count_tokens(odd_docs, frequent=frequent).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert count_tokens(no_docs).count() == 0


def test_op4(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = token_counts.op4_token_counts(spark, sf_dir).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in got} == {(i, len(ids(t))) for i, t in docs.items()} and len(got) == len(docs)


def check_packing(rows, docs, capacity):
    """rows hold every document whole, in sequences without gaps or overlaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = defaultdict(list)
    for i, t in docs:
        copies[i].append(t)
    for i, texts in copies.items():
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        want = []
        for t in texts:
            whole = np.array([*ids(t), 0], dtype="<u4")
            first = (len(whole) - 1) % capacity + 1
            cuts = [0, *range(first, len(whole) + 1, capacity)]
            want += [(n, a, b - a, zlib.crc32(whole[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == sorted(want)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(odd_docs, no_docs, capacity):
    rows = pack_documents(odd_docs, capacity=capacity).collect()
    used = check_packing(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()], capacity)
    assert used <= -(-sum(r["length"] for r in rows) // capacity) * 1.25 + 1
    assert pack_documents(no_docs).count() == 0


def test_packing_with_ids(odd_docs):
    for r in pack_documents(odd_docs, with_ids=True).collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]


def test_op1_is_near_the_least(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = packing.op1_best_fit_packing(spark, sf_dir).collect()
    assert check_packing(rows, docs, 2048) <= -(-sum(r["length"] for r in rows) // 2048) + 1


@pytest.mark.parametrize("criterion", ["norm", "dot"])
@pytest.mark.parametrize(("capacity", "documents", "cost"), [(100, None, None), (100, 3, None), (100, None, 3000), (64, 2, 1500)])
def test_every_constraint_holds(criterion, capacity, documents, cost):
    rng = np.random.default_rng(4)
    most = int(min(capacity, (cost or capacity**2) ** 0.5))
    histogram = {int(n): int(c) for n, c in zip(*np.unique(rng.integers(1, most + 1, 3000), return_counts=True))}
    plan = best_fit(histogram, capacity, documents, cost, criterion=criterion)
    length = np.concatenate([np.full(c, n) for n, c in histogram.items()])
    sequence, offset = plan.place(length, np.concatenate([np.arange(c) for c in histogram.values()]))
    held = defaultdict(list)
    for s, o, n in zip(sequence, offset, length):
        held[s].append((o, n))
    assert len(held) == plan.sequences
    for x in held.values():
        x.sort()
        assert [o for o, _ in x] == list(np.cumsum([0, *(n for _, n in x)])[:-1])
        assert sum(n for _, n in x) <= capacity and len(x) <= (documents or capacity) and sum(n * n for _, n in x) <= (cost or capacity**2)


def test_best_fit_refuses():
    for bad in ({101: 1}, {0: 2}):
        with pytest.raises(ValueError):
            best_fit(bad, 100)
    assert best_fit({}, 10).sequences == 0


def test_piece_encoding(odd_docs, no_docs):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encode_documents(odd_docs).collect()}
    want = set()
    for r in odd_docs.collect():
        x = PIECES.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.add((r["doc_id"], len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(PIECES.decode(x).encode()).hexdigest()))
    assert got == want and encode_documents(no_docs).count() == 0


def test_agendas_agree():
    bpe = PieceBPE(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    for n in range(1, 40):
        s = "".join(rng.choice(list("theandiг é.\n"), n))
        assert bpe._short(s) == bpe._long(s)


def test_segments_together_are_encoded_as_alone():
    bpe = PieceBPE(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    segments = ["".join(rng.choice(list("theandiг é.\n\0🙂텍\uffff"), n)) for n in [*range(1, 60)] * 4]
    together = bpe.agendas(segments)
    assert [list(np.frombuffer(x, "<u4")) for x in together] == [bpe.agenda(x) for x in segments]


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 5)
    bpe = PieceBPE(public_tokenizers.path("piece_bpe_32k.model"))
    for texts in (["a b c d", "c d e f g h"], ["a  b", "\0abc \0", "", "x " * 50 + "y" * 60]):
        assert bpe.encode_all(texts) == [np.array(PIECES.encode(x, add_bos=True, add_eos=True), "<u4").tobytes() for x in texts]


def test_op8(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = piece_bpe.op8_piece_encoding(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        x = PIECES.encode(docs[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(PIECES.decode(x).encode()).hexdigest())
