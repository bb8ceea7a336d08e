"""Encoding and decoding with merge-type (BPE) SentencePiece vocabularies.

A text is normalised and split before each run of word marks; no piece of the vocabulary crosses such a place (checked when
the model is loaded; otherwise a text is one segment). A segment's characters are merged by an agenda of adjacent symbol
pairs, best score first, leftmost among equals: a heap for a long segment; short ones that are new in a batch have a row each
in a matrix, and every row takes its best pair at the same time. What no piece covers falls back to bytes. Segments are
remembered in a bounded table a worker. Each Arrow batch is checked against the sentencepiece library.
Inside this module a word mark is a space, so that Latin text stays one byte a character.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

MARK = "▁"
#: Segments that a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 1_000_000, 48
#: Characters of a segment whose agenda is searched as a list; the cost of a pair that is no piece, and its rank.
SHORT, NEVER, LAST = 24, float("inf"), np.iinfo(np.int32).max
#: Above any symbol: pieces, and characters after them. Lengths up to which new segments share a matrix.
SPACE = 1 << 31
WIDTHS = (6, 8, 10, 12, 16, 24, LONGEST)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        if (kind := tag & 7) == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + size]
            at += size


class PieceBPE:
    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, tuple[float, int]] = {}
        self.bytes, self.unused, self.defined = [0] * 256, set(), []
        norm: dict[int, int | bytes] = {}
        number = 0
        for field, value in fields(self.library.serialized_model_proto()):
            if field == 1:
                x = dict(fields(value))
                piece, kind = x[1].decode(), x.get(3, NORMAL)
                if kind == BYTE:
                    self.bytes[int(piece[3:5], 16)] = number
                elif kind in (NORMAL, USER_DEFINED, UNUSED):
                    piece = piece.replace(MARK, " ")
                    self.ids[piece] = (struct.unpack("<f", x.get(2, b"\0" * 4))[0], number)
                    if kind == UNUSED:
                        self.unused.add(piece)
                    elif kind == USER_DEFINED:
                        self.defined.append(piece)
                number += 1
            elif field == 3:
                norm = dict(fields(value))
        if self.unused or self.defined:
            raise ValueError("vocabularies with unused or user-defined pieces aren't supported")
        self.plain = not norm.get(2) and norm.get(4, 1) == 0 and norm.get(5, 1) == 1 and norm.get(3, 1) == 1
        self.crosses = any(" " in p.lstrip(" ") for p in self.ids)
        self.segments = re.compile(".+" if self.crosses else " +[^ ]*|[^ ]+", re.S)
        self.cost = {p: -score for p, (score, _) in self.ids.items()}.get
        self.seen: dict[str, bytes] = {}
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self._pairs()

    def _pairs(self) -> None:
        """Every pair of pieces that makes a piece: its key (sorted), rank by score and what it makes, as arrays."""
        self.symbols = self.library.vocab_size()
        rank = {score: i for i, score in enumerate(sorted({x for x, _ in self.ids.values()}, reverse=True))}
        rows = []
        for piece, (score, number) in self.ids.items():
            for cut in range(1, len(piece)):
                if (a := self.ids.get(piece[:cut])) and (b := self.ids.get(piece[cut:])):
                    rows.append((a[1] * SPACE + b[1], rank[score], number))
        rows.sort()
        self.pair, self.rank, self.makes = (np.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (np.int64, np.int32, np.int32), strict=True))
        self.letter = np.full(0x110000, -1, np.int32)  # of each character, its piece
        for piece, (_, number) in self.ids.items():
            if len(piece) == 1:
                self.letter[ord(piece)] = number

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (LAST: none) and piece of each pair."""
        if not len(self.pair):
            return np.full(left.shape, LAST, np.int32), np.zeros(left.shape, np.int32)
        key = left * SPACE + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], LAST), self.makes[at]

    def agendas(self, segments: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each segment."""
        out = np.full(len(segments), b"", object)
        every, length = np.array(segments, object), np.fromiter(map(len, segments), np.int64, len(segments))
        kind = np.searchsorted(WIDTHS, length)
        for k in np.unique(kind):
            group = np.flatnonzero(kind == k)
            if k < len(WIDTHS):
                self._matrix("".join([x.ljust(WIDTHS[k], "\0") for x in every[group]]), WIDTHS[k], length[group], group, out)
            else:
                for i in group:
                    ids = self.agenda(segments[i])
                    out[i] = struct.pack(f"<{len(ids)}I", *ids)
        return out.tolist()

    def _matrix(self, text: str, width: int, length: np.ndarray, who: np.ndarray, out: np.ndarray) -> None:
        """A row of symbols a segment. Each step merges the best pair of every row, and rows without one leave.
        A character that is no piece is a symbol beyond the pieces, and ends as its bytes."""
        point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width).astype(np.int64)
        symbol = self.letter[point].astype(np.int64)
        symbol[symbol < 0] = self.symbols + point[symbol < 0]
        symbol[np.arange(width) >= length[:, None]] = self.symbols
        rank, makes = self._look(symbol[:, :-1], symbol[:, 1:])
        while len(who):
            width = symbol.shape[1]
            best = rank.argmin(axis=1) if width > 1 else np.zeros(len(who), np.int64)
            done = rank[np.arange(len(who)), best] == LAST if width > 1 else np.ones(len(who), bool)
            if done.any():
                ends = np.flatnonzero(done)
                made, size = symbol[ends], length[ends]
                whole = made.astype("<u4").tobytes()
                out[who[ends]] = [whole[n : n + 4 * k] for n, k in zip(range(0, 4 * width * len(ends), 4 * width), size.tolist(), strict=True)]
                for i in np.flatnonzero(((made >= self.symbols) & (np.arange(width) < size[:, None])).any(axis=1)):
                    ids = [y for x in made[i, : size[i]].tolist() for y in ([x] if x < self.symbols else [self.bytes[b] for b in chr(x - self.symbols).encode()])]
                    out[who[ends[i]]] = struct.pack(f"<{len(ids)}I", *ids)
                rest = ~done
                who, symbol, length, rank, makes, best = (x[rest] for x in (who, symbol, length, rank, makes, best))
                if not len(who):
                    break
            rows = np.arange(len(who))
            made = makes[rows, best]
            source = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
            symbol = np.take_along_axis(symbol, source, axis=1)
            symbol[rows, best] = made
            source = source[:, : width - 2]
            rank, makes = np.take_along_axis(rank, source, axis=1), np.take_along_axis(makes, source, axis=1)
            length = length - 1
            if width > 2:
                for at in (best - 1, best):  # the pairs left and right of what was made
                    there = np.flatnonzero((at >= 0) & (at < width - 2))
                    rank[there, at[there]], makes[there, at[there]] = self._look(symbol[there, at[there]], symbol[there, at[there] + 1])

    def normalize(self, text: str) -> str:
        """One mark before the text; other rules are the library's."""
        if not text:
            return ""
        return (" " + text if self.plain else self.library.normalize(text)).replace(MARK, " ")

    def agenda(self, segment: str) -> list[int]:
        """Merge the best adjacent pair until none is a piece. A short segment's agenda is a list, a longer one's a heap."""
        if len(segment) <= SHORT:
            return self._numbers(self._short(segment))
        return self._numbers(self._long(segment))

    def _short(self, segment: str) -> list[str]:
        cost = self.cost
        parts = list(segment)
        costs = [cost(segment[i : i + 2], NEVER) for i in range(len(segment) - 1)]
        while costs and (least := min(costs)) != NEVER:
            i = costs.index(least)
            piece = parts[i] + parts[i + 1]
            parts[i : i + 2] = (piece,)
            del costs[i]
            if i < len(costs):
                costs[i] = cost(piece + parts[i + 1], NEVER)
            if i:
                costs[i - 1] = cost(parts[i - 1] + piece, NEVER)
        return parts

    def _numbers(self, parts: list[str]) -> list[int]:
        out, ids = [], self.ids
        for x in parts:
            if found := ids.get(x):
                out.append(found[1])
            else:
                out += [self.bytes[b] for b in x.encode()]
        return out

    def _long(self, segment: str) -> list[str]:
        ids, n = self.ids, len(segment)
        symbol, before, after = list(segment), list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        heap = []
        for i in range(n - 1):
            if found := ids.get(segment[i : i + 2]):
                heap.append((-found[0], i, i + 1, segment[i : i + 2]))
        heapq.heapify(heap)
        while heap:
            _, left, right, piece = heapq.heappop(heap)
            if not symbol[left] or not symbol[right] or after[left] != right or len(symbol[left]) + len(symbol[right]) != len(piece):
                continue  # one of them has been merged since
            symbol[left], symbol[right] = piece, ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
                if found := ids.get(new := piece + symbol[after[left]]):
                    heapq.heappush(heap, (-found[0], left, after[left], new))
            if before[left] >= 0 and (found := ids.get(new := symbol[before[left]] + piece)):
                heapq.heappush(heap, (-found[0], before[left], left, new))
        out, i = [], 0
        while i >= 0:
            out.append(symbol[i])
            i = after[i]
        return out

    def keys(self, text: str) -> list[str]:
        """A normalised text's segments: words without their mark, others after a space."""
        if text[:1] == " " and "  " not in text and not self.crosses and text[-1] != " ":
            return text[1:].split(" ")
        word = lambda s: len(s) > 1 and s[0] == " " != s[1]
        return [s[1:] if word(s) and not self.crosses else " " + s for s in self.segments.findall(text)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit, with begin and end."""
        keys = [self.keys(self.normalize(x)) for x in texts]
        new = set().union(*keys)
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
        new = list(new.difference(self.seen))
        self.seen.update(zip(new, self.agendas([x[1:] if x[0] == " " else " " + x for x in new]), strict=True))
        begin, end, ids = struct.pack("<I", self.begin), struct.pack("<I", self.end), self.seen.__getitem__
        out = [b"".join([begin, *map(ids, x), end]) for x in keys]
        for x in new:
            if len(x) > LONGEST:
                del self.seen[x]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@functools.lru_cache(maxsize=2)
def piece_bpe(path: str) -> PieceBPE:
    """One instance a worker."""
    return PieceBPE(path)


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, check: bool = True, with_ids: bool = False) -> DataFrame:
    """Per row of docs: key, n_tokens, ids_sha256, decoded_sha256 (with_ids: and ids, decoded).

    A null text counts as empty: begin and end ids alone. check: compare every text's ids with the library's and fail on
    a difference. Repeated rows, null keys and other columns change nothing; an empty table gives no rows.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(path)
        for batch in slices(batches, "text", 4 << 20):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            raw = bpe.encode_all(texts)
            if check:
                for i, (own, x) in enumerate(zip(raw, texts, strict=True)):
                    if bpe.library.encode(x, add_bos=True, add_eos=True, return_type="numpy").astype("<u4", copy=False).tobytes() != own:
                        raise ValueError(f"ids differ from the library's for {key} {batch.column(0)[i]}")
            ids = [np.frombuffer(x, "<i4") for x in raw]
            decoded = [bpe.library.decode(x) for x in ids]
            arrays = [batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(encode, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
