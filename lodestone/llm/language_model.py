"""A hierarchical Pitman-Yor language model of words, trained and applied over the whole corpus.

A token's context is the two words before it (the begin of a text counts as END). The restaurant of two words seats a customer for
each training token after them; its tables are customers of the restaurant of the nearer word, whose tables are customers of
one root, whose base is uniform over the known words and one unknown. A near word of more than ROOM tokens has several rooms,
dealt out by the word before it: each is a restaurant of its own.
Everything that a restaurant of one or two words needs is in one part: (near word, far word, word) triples are dealt by the near
word and room. Of the root a part needs its words' customers: those of the KNOWN most frequent words are broadcast; those of all
others are summed in shards by word, and each part gets back the ones it asked for.
The passes: (1) count words; (2) send each chunk's triples to groups of parts, packed, each triple once a chunk with the documents it
occurs in; (3) in each part add the triples up and seat their customers by Gibbs; (4) sum the words' customers and send them to
the parts; (5) seat again and average the predictive probabilities of several samples; (6) add up each document's terms.
Seating is sampled for all dishes of a part at once, level by level: of a dish's tables only their number matters, which is
drawn from its law given the weight of a new table, while other parts' customers of the root stay as they were known before.
"""

from __future__ import annotations

import copy
import functools
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix, most_frequent, release, slices, table, trim, utf8, word_hashes

#: Words whose customers of the root are broadcast; parts whose questions about the others one shard answers, about.
KNOWN, ASKERS = 65_536, 16
#: Tokens of a part, about, and of a room; text bytes of a chunk; bits of a document's place in its chunk (slices() has 4096 rows at most).
PART, ROOM, CHUNK, PLACE = 500_000, 250_000, 4 << 20, 12
#: Parts whose triples of a chunk are packed as one: one for each SPLIT parts there are, at most. More parts, longer blocks, so that
#: blocks don't become many and short as the corpus grows.
SPLIT, MOST_GROUPED = 64, 12
#: Documents' terms that a task holds, and chunks whose terms it adds up at once.
TERMS, CHUNKS_AT_ONCE = 1_500_000, 32
#: Draws of all levels before the first sample, between samples, and samples averaged. Strength of all restaurants.
BURN, BETWEEN, SAMPLES, STRENGTH = 3, 1, 4, 1.0
#: Draws of the root's tables until their number has settled.
ROOT_DRAWS = 12
#: Customers of a dish up to which the law of its tables is tabulated; beyond, it is a binomial of nearly the same mean and variance.
EXACT = 1000
#: Customers of a dish up to which all numbers of tables are weighed, without a search for the likely ones. Text bytes that are hashed at once.
FEW, HASHED = 8, 1 << 18
#: Weights of numbers of tables that are drawn from at once; below which part of the largest (its -log) they are left out: all left out together are below a double's last bit.
WEIGHTS, FAINT = 100_000, 44.0
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x5851F42D4C957F2D)
#: Rows of totals that aren't of words: the root's customers, tables of its rare words; triples, dishes of one word and rare words with one customer and with two.
CUSTOMERS, TABLES, ONE_3, TWO_3, ONE_2, TWO_2, ONE_1, TWO_1 = range(-8, 0)
_FAR, _WORD, _ROOM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts: token hashes (END after each), and the row of each."""
    data, offsets = utf8(texts)
    words, first = word_hashes(data, offsets, HASHED)
    rows = len(offsets) - 1
    out = np.full(len(words) + rows, END)
    out[np.arange(len(words)) + np.repeat(np.arange(rows), np.diff(first))] = words
    return out, np.repeat(np.arange(rows), np.diff(first) + 1)


def before(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, and the one before that. A text begins after ENDs."""
    near = np.append(END, token)[: len(token)]
    return near, np.where(near == END, END, np.append([END, END], token)[: len(token)])


def places(word: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Each word's place in a sorted array, or -1."""
    if not len(of):
        return np.full(len(word), -1)
    i = np.minimum(np.searchsorted(of, word), len(of) - 1)
    return np.where(of[i] == word, i, -1)


def triples(near: np.ndarray, far: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit name of each triple."""
    return mix(near + far * _FAR + word * _WORD)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays with their types and lengths, compressed: of each array all first bytes, then all second ones, and so on; of 64-bit
    names, which come in order, what each is above the one before."""
    head = struct.pack("<H", len(arrays)) + b"".join(struct.pack("<3sQ", a.dtype.str[:3].encode(), len(a)) for a in arrays)
    arrays = [np.diff(a, prepend=a.dtype.type(0)) if a.dtype == np.uint64 else a for a in arrays]
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    (n,), at, out = struct.unpack_from("<H", raw), 2 + 11 * struct.unpack_from("<H", raw)[0], []
    for i in range(n):
        kind, size = struct.unpack_from("<3sQ", raw, 2 + 11 * i)
        kind = np.dtype(kind.decode())
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, size).T).reshape(-1).view(kind) if kind.itemsize > 1 else planes.view(kind))
        if kind == np.uint64:
            out[-1] = np.cumsum(out[-1], dtype=np.uint64)
        at += size * kind.itemsize
    return out


def small(x: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


@functools.lru_cache(4)
def seatings(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers: the weight of all ways to seat n customers (first index) at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(EXACT + 1)
    with np.errstate(divide="ignore"):
        for n in range(1, EXACT):
            out[n + 1, 1 : n + 2] = np.logaddexp(np.log(np.maximum(n - discount * t[1 : n + 2], 0)) + out[n, 1 : n + 2], out[n, : n + 1])
    return out


def moments(customers: np.ndarray, opens: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearly the mean and variance of the number of tables of many customers, by the saddle point x of its generating function."""
    low, high = np.full(len(customers), -700.0), np.zeros(len(customers))
    for _ in range(60):  # log(1 - x) where opens * x * (1 - x) ** (discount - 1) is customers
        y = (low + high) / 2
        over = np.log(opens) + np.log(-np.expm1(y)) + (discount - 1) * y > np.log(customers)
        low, high = np.where(over, y, low), np.where(over, high, y)
    x = -np.expm1(y)
    mean = opens / discount * -np.expm1(discount * y)
    return mean + np.minimum(1, x * (1 - discount) / (2 * (1 - discount * x) ** 2)), mean - customers * np.exp(y) / (1 - discount * x)


def likely(law: np.ndarray, customers: np.ndarray, log_opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From and to which number of tables a weight is at least exp(-FAINT) of the largest: weights rise to it, then fall."""
    flat, row = law.ravel(), customers * law.shape[1]
    weight = lambda t: flat[row + t] + t * log_opens

    def first(holds, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least t from low to high that holds; high, if none below it does."""
        low, high = low.copy(), high.copy()
        for _ in range(int(np.max(high - low, initial=0)).bit_length()):
            t = (low + high) // 2
            yes = holds(t)
            low, high = np.where(yes | (low == high), low, t + 1), np.where(yes, t, high)
        return high

    one = np.ones_like(customers)
    best = first(lambda t: weight(np.minimum(t + 1, customers)) <= weight(t), one, customers)
    least = weight(best) - FAINT
    return first(lambda t: weight(t) >= least, one, best), np.maximum(best, first(lambda t: (t > customers) | (weight(np.minimum(t, customers)) < least), best, customers + 1) - 1)


def draw_tables(customers: np.ndarray, opens: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Numbers of tables of many (restaurant, word) pairs: t with weight opens ** t times that of all seatings at t tables."""
    tables = (customers > 0).astype(np.int64)  # one customer has one table
    some = np.flatnonzero((customers > 1) & (customers <= EXACT))
    if len(some):
        law, c = seatings(discount), customers[some]
        for n in range(2, FEW + 1):
            if len(these := some[c == n]):
                share = np.cumsum(np.exp(law[n, 1 : n + 1])[:, None] * opens[these] ** np.arange(n)[:, None], axis=0)
                tables[these] = 1 + (share[:-1] <= random.random(len(these)) * share[-1]).sum(axis=0)
        some = some[c > FEW]
    if len(some):
        c, log_opens = customers[some], np.log(opens[some])
        low, high = likely(law, c, log_opens)
        wide = high - low + 1
        ends = np.cumsum(wide)
        a = 0
        while a < len(some):  # a bounded number of weights at once
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - wide[a] + WEIGHTS, side="right")))
            w = wide[a:b]
            start = np.cumsum(w) - w
            t = np.arange(w.sum()) - np.repeat(start - low[a:b], w)
            weight = law.ravel()[np.repeat(c[a:b] * law.shape[1], w) + t] + t * np.repeat(log_opens[a:b], w)
            total = np.cumsum(np.exp(weight - np.repeat(np.maximum.reduceat(weight, start), w)))
            below = np.append(0.0, total)[start]
            at = np.searchsorted(total, below + random.random(b - a) * (total[start + w - 1] - below), side="right")
            tables[some[a:b]] = np.clip(at - start + low[a:b], low[a:b], high[a:b])
            a = b
    if len(many := np.flatnonzero(customers > EXACT)):
        c = customers[many]
        mean, variance = moments(c, opens[many], discount)
        mean = np.clip(mean - 1, 1e-9, c - 1)
        p = np.clip(1 - variance / mean, 1e-6, 1)
        tables[many] = np.minimum(c, 1 + random.binomial(np.ceil(mean / p).astype(np.int64), np.minimum(1, mean / np.ceil(mean / p))))
    return tables


class Seating:
    """The tables of many (restaurant, word) pairs, customer by customer: the yardstick of draw_tables. opens: the weight of a new table for each pair."""

    def __init__(self, customers: np.ndarray, opens: np.ndarray, discount: float, steps: int, random: np.random.Generator):
        self.tables = (customers > 0).astype(np.int64)
        self.active = np.flatnonzero(customers > 1)  # one customer has one table
        c, a = customers[self.active], opens[self.active]
        self.c, self.discount, self.random = c, discount, random
        first = np.clip(np.rint(1 + a * np.log((a + c) / (a + 1))), 1, c).astype(np.int64)
        self.start = np.append(0, np.cumsum(np.minimum(c, first + steps)))
        self.sizes = np.zeros(self.start[-1], np.int64)
        within = np.arange(len(self.sizes)) - np.repeat(self.start[:-1], np.diff(self.start))
        self.sizes[within < np.repeat(first, np.diff(self.start))] = 1
        self.sizes[self.start[:-1]] = c - first + 1
        self.t = first
        self.tables[self.active] = self.t

    def step(self, opens: np.ndarray) -> None:
        """Take a random customer of every pair from its table and seat it anew."""
        if not len(self.active):
            return
        n, a = len(self.active), opens[self.active]
        total = np.cumsum(self.sizes)
        base = total[self.start[:-1]] - self.sizes[self.start[:-1]]
        at = np.searchsorted(total, base + (self.random.random(n) * self.c).astype(np.int64), side="right")
        self.sizes[at] -= 1
        gone = self.sizes[at] == 0
        self.t -= gone
        new = self.random.random(n) * (a + self.c - 1 - self.discount * self.t) < a
        new |= self.t == 0
        free = np.where(gone, at, -1)  # the place just left is free, else the first empty one
        empty = self.sizes == 0
        if (need := np.flatnonzero(new & ~gone)).size:
            places = np.flatnonzero(empty)
            i = np.searchsorted(places, self.start[:-1][need])
            found = places[np.minimum(i, len(places) - 1)] if len(places) else np.full(len(need), -1)
            fits = (i < len(places)) & (found < self.start[1:][need])
            free[need[fits]] = found[fits]
        new &= free >= 0
        weight = np.cumsum(np.where(empty, 0.0, self.sizes - self.discount))
        low = weight[self.start[:-1]] - np.where(empty[self.start[:-1]], 0.0, self.sizes[self.start[:-1]] - self.discount)
        high = weight[self.start[1:] - 1]
        join = np.minimum(np.searchsorted(weight, low + self.random.random(n) * (high - low), side="right"), self.start[1:] - 1)
        join = np.where(empty[join], at, join)  # rounding at a run's end
        stays = ~new & (self.sizes[join] == 0)
        self.t += new | stays
        self.sizes[np.where(new, free, join)] += 1
        self.tables[self.active] = self.t


class Group:
    """The chunks' packed blocks of some parts that lie side by side. borders: where its parts begin, but the first."""

    def __init__(self, blocks: list[tuple[int, bytes]], known: np.ndarray, borders: np.ndarray):
        self.known, raw = known, [unpack(x) for _, x in blocks]
        self.chunks = np.array([chunk for chunk, _ in blocks], np.int64)
        blocks.clear()
        self.rare = np.concatenate([x[7] for x in raw])
        self.rare_from = np.cumsum([0, *(len(x[7]) for x in raw[:-1])])
        self.columns, self.cuts = [], []
        for x in raw:
            at = np.concatenate([[0], np.searchsorted(x[0], borders), [len(x[0])]])
            entries = np.append(0, np.cumsum(x[1], dtype=np.int64))[at]
            self.columns.append(x[:7])
            self.cuts.append((at, entries, np.append(0, np.cumsum(x[5], dtype=np.int64))[entries]))

    def columns_of(self, i: int) -> tuple[np.ndarray, ...] | None:
        """What the group's i-th part is made of, if it has triples."""
        own = [[x[slice(c[k][i], c[k][i + 1])] for x, k in zip(columns, (0, 0, 1, 1, 1, 1, 2), strict=True)] for columns, c in zip(self.columns, self.cuts, strict=True)]
        name, many, far, word, count, occurs, doc = (np.concatenate(x) for x in zip(*own, strict=True))
        if not len(far):
            return None
        sizes = np.array([len(x[2]) for x in own])
        return np.repeat(name, many), *(self._names(x, sizes) for x in (far, word)), count.astype(np.int64), self.chunks, sizes, occurs, doc

    def _names(self, number: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        number = number.astype(np.int64)
        out = self.known[np.minimum(number, max(len(self.known) - 1, 0))] if len(self.known) else np.zeros(len(number), np.uint64)
        rare = np.flatnonzero(number >= len(self.known))
        out[rare] = self.rare[number[rare] - len(self.known) + np.repeat(self.rare_from, sizes)[rare]]
        return out


class Part:
    """The triples of one part, and who holds them.

    near: each triple's restaurant of one word, from 0; pair: that of two words; word: its word's place in words; count: training
    tokens; dish: the (near, word) it is of. dish_near, dish_word: of each dish. own: customers of the root from pass (3).
    Of each chunk that has some (chunks, and sizes: how many triples), in order: number, its triples; occurs, how often each occurs;
    doc, the places in the chunk of the documents it occurs in.
    """

    def __init__(self, blocks: list[tuple[int, bytes]], known: np.ndarray):
        """Of the blocks of a group that has but one part."""
        self._add_up(*Group(list(blocks), known, np.zeros(0, np.uint64)).columns_of(0))

    @classmethod
    def of(cls, *columns: np.ndarray) -> Part:
        self = cls.__new__(cls)
        self._add_up(*columns)
        return self

    def _add_up(self, near: np.ndarray, far: np.ndarray, word: np.ndarray, count: np.ndarray, chunks: np.ndarray, sizes: np.ndarray, occurs: np.ndarray, doc: np.ndarray) -> None:
        pair = mix(near + far * _FAR)
        order = np.lexsort((word, pair, near))
        near, pair, word = near[order], pair[order], word[order]
        first = runs(near, pair, word)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        self.count = np.add.reduceat(count[order], first)
        near, pair, word = near[first], pair[first], word[first]
        new = np.append(False, near[1:] != near[:-1])
        self.near, self.pair = np.cumsum(new), np.cumsum(new | np.append(False, pair[1:] != pair[:-1]))
        self.words, self.word = np.unique(word, return_inverse=True)
        self.own = np.zeros(len(self.words), np.int64)
        self.chunks, self.sizes, self.occurs, self.doc = chunks, sizes, occurs, doc
        self._dishes()

    def _dishes(self) -> None:
        names, self.dish = np.unique(self.near.astype(np.int64) << 32 | self.word, return_inverse=True)
        self.dish_near, self.dish_word = names >> 32, names & 0xFFFFFFFF

    @property
    def held(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By chunk: the chunk, and its number, occurs and doc."""
        ends = np.cumsum(self.sizes)
        docs = np.append(0, np.cumsum(self.occurs, dtype=np.int64))
        return [(int(c), self.number[a:b], self.occurs[a:b], self.doc[docs[a] : docs[b]]) for c, a, b in zip(self.chunks, ends - self.sizes, ends, strict=True)]

    @held.setter
    def held(self, chunks: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.chunks, self.sizes = np.array([x[0] for x in chunks], np.int64), np.array([len(x[1]) for x in chunks])
        self.number, self.occurs, self.doc = (np.concatenate([x[k] for x in chunks]) for k in (1, 2, 3))

    def pack(self) -> bytes:
        one = len(self.count)
        placed = np.repeat(np.arange(len(self.sizes)) * one, self.sizes) + self.number
        order = np.argsort(placed)  # as steps, in the order of triples of each chunk; an occurrence list goes with its triple
        occurs = self.occurs[order]
        starts = np.cumsum(self.occurs, dtype=np.int64) - self.occurs
        take = np.repeat(starts[order], occurs) + (np.arange(len(self.doc)) - np.repeat(np.cumsum(occurs, dtype=np.int64) - occurs, occurs))
        return pack([self.words, *map(small, (np.bincount(self.near), np.bincount(self.pair), self.word, self.count, self.own)), self.chunks, *map(small, (self.sizes, np.diff(placed[order], prepend=0))), small(occurs), self.doc[take]])

    @classmethod
    def unpacked(cls, raw: bytes) -> Part:
        self = cls.__new__(cls)
        self.words, nears, pairs, *rest, self.chunks, sizes, steps, self.occurs, self.doc = unpack(raw)
        self.near, self.pair = (np.repeat(np.arange(len(x)), x) for x in (nears, pairs))
        self.word, self.count, self.own = (x.astype(np.int64) for x in rest)
        self.sizes = sizes.astype(np.int64)
        self.number = np.cumsum(steps, dtype=np.int64) - np.repeat(np.arange(len(sizes)) * len(self.count), self.sizes)
        self._dishes()
        return self


class Model:
    """What is known of all parts: counts of the known words, contexts with rooms, and the root once its customers have been counted."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, hot: np.ndarray, rooms: np.ndarray, total: int, distinct: int, parts: int):
        self.known, self.counts, self.hot, self.rooms, self.total, self.distinct, self.parts = known, counts, hot, rooms, total, distinct, parts
        by_count = np.argsort(-counts, kind="stable")  # the most frequent have the smallest numbers in blocks
        self.by_count, self.number = known[by_count], np.argsort(by_count)
        self.discounts = (0.75, 0.75, 0.75)  # of the root, of one word, of two
        self.root: np.ndarray | None = None  # customers of the known words
        self.customers, self.tables = 0.0, float(distinct)  # of the root: all its words'

    def restaurant(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The name of the restaurant of one word that a token is in."""
        i = places(near, self.hot)
        room = np.where(i >= 0, mix(far.copy()) % (self.rooms[i] if len(self.rooms) else np.uint64(1)), 0).astype(np.uint64)
        return mix(near + room * _ROOM)

    def of_words(self, words: np.ndarray, known: np.ndarray | None, rare: np.ndarray) -> np.ndarray:
        """Values of a part's words: of known ones by their places, of the others in their order."""
        i = places(words, self.known)
        out = np.zeros(len(words), np.float64)
        if known is not None:
            out[i >= 0] = known[i[i >= 0]]
        out[i < 0] = rare
        return out

    def seat(self, part: Part, seed: int, samples: int, root: np.ndarray | None, counts: np.ndarray) -> Iterator[tuple]:
        """Per sample: tables of each triple, customers and tables of each dish, the part's customers of each word, and each
        triple's probability. root: the words' customers in all parts (None: not known yet; words are then as frequent as counts say)."""
        random = np.random.Generator(np.random.PCG64([seed, samples]))
        d1, d2, d3 = self.discounts
        new = (STRENGTH + d1 * self.tables) / (self.distinct + 1)
        guests = np.bincount(part.pair, part.count)
        tables3 = (part.count > 0).astype(np.int64)
        pair_tables = np.bincount(part.pair, tables3)
        dishes = len(part.dish_near)
        customers = np.bincount(part.dish, tables3, dishes).astype(np.int64)
        tables = (customers > 0).astype(np.int64)
        near_customers, near_tables = np.bincount(part.dish_near, customers), np.bincount(part.dish_near, tables)
        base = (counts + 1) / (self.total + self.distinct + 1)
        own = part.own
        for s in range(max(samples, 1)):
            for _ in range(BETWEEN if s else BURN):
                if root is not None:
                    all_customers = np.maximum(root + own - part.own, 0).astype(np.int64)
                    above = draw_tables(all_customers, np.full(len(all_customers), new), d1, random)
                    base = (all_customers - d1 * above + new) / (STRENGTH + self.customers + (own - part.own).sum())
                # a dish's own tables aren't there while they are drawn, and come one by one; a quarter of them agrees best with
                # seating single customers (a test compares)
                open_dish = (STRENGTH + d2 * near_tables[part.dish_near]) * base[part.dish_word]
                chance = (customers - d2 * tables + open_dish) / (STRENGTH + near_customers[part.dish_near])
                tables3 = draw_tables(part.count, (STRENGTH + d3 * np.maximum(pair_tables[part.pair] - (tables3 + 1) / 4, 0)) * chance[part.dish], d3, random)
                pair_tables = np.bincount(part.pair, tables3)
                customers = np.bincount(part.dish, tables3, dishes).astype(np.int64)
                tables = draw_tables(customers, (STRENGTH + d2 * np.maximum(near_tables[part.dish_near] - (tables + 1) / 4, 0)) * base[part.dish_word], d2, random)
                near_customers, near_tables = np.bincount(part.dish_near, customers), np.bincount(part.dish_near, tables)
                own = np.bincount(part.dish_word, tables, len(part.words)).astype(np.int64)
            open_dish = (STRENGTH + d2 * near_tables[part.dish_near]) * base[part.dish_word]
            chance = (customers - d2 * tables + open_dish) / (STRENGTH + near_customers[part.dish_near])
            yield tables3, customers, tables, own, (part.count - d3 * tables3 + (STRENGTH + d3 * pair_tables[part.pair]) * chance[part.dish]) / (STRENGTH + guests[part.pair])


def _train(key: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT


def count_words(docs: DataFrame) -> DataFrame:
    """(text) to (word hash, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in slices(batches, "text", CHUNK):
            held.append(tokens(batch.column("text"))[0])
            size += len(held[-1])
            if size > PART:
                yield out()
                size = 0
                trim()
        if held:
            yield out()
        trim()

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", train: F.Column | None = None, words_kept: int = KNOWN) -> DataFrame:
    """Per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Learns from the rows where train holds (default: crc32 of the key as text, modulo 7, is not 2; a null key counts as an
    empty text). A null text is empty: one token, the end. Rows with equal keys are scored each. Without training rows every
    word is unknown. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), (_train(key) if train is None else train).alias("train"))
    counted = materialize(count_words(docs.where("train")), "words", once=True, batch=CHUNK)
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    top = most_frequent(counted, "n", words_kept).toArrow()
    word, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(word)
    parts = max(1, math.ceil(sums["total"] / PART))
    busy = counted.where(F.col("n") > ROOM).toArrow()  # total / ROOM words at most
    hot, tokens_after = busy.column("word").to_numpy().view(np.uint64), busy.column("n").to_numpy()
    by_hash = np.argsort(hot)
    rooms = -(-tokens_after[by_hash] // ROOM)
    model = Model(word[order], n[order], hot[by_hash], rooms.astype(np.uint64), sums["total"], sums["distinct"], parts)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["key"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group of parts of a chunk, and a row (part -1) for the chunk's documents."""
        model, task = shared.value, TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "text", 2 * CHUNK)):  # batches are of about CHUNK
            chunk = task << 32 | number
            token, row = tokens(batch.column("text"))
            lengths, row = np.bincount(row, minlength=batch.num_rows), row.astype(np.uint16)
            near, far = before(token)
            near = model.restaurant(near, far)
            is_train = np.asarray(batch.column("train").to_pylist(), bool)
            which = triples(near, far, token)
            # by restaurant, then by triple as far as the bits go: what isn't added up here is added up in the part
            order = np.argsort((near & ~np.uint64(0xFFFFFF)) | (which & np.uint64(0xFFFFFF)))
            near, row, which = near[order], row[order], which[order]
            first = runs(near, which)
            ends = np.append(first, len(order))
            order = order[first]
            far, token, near = far[order], token[order], near[first]
            del which, order
            occurs, trained = np.diff(ends), np.add.reduceat(is_train[row].astype(np.int32), first)
            numbers_of = [places(x, model.known).astype(np.int32) for x in (far, token)]
            edges = [0, *np.searchsorted(near, borders[grouped - 1 :: grouped]), len(first)]
            payload, numbers = [], []
            for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if a == b:
                    continue
                names, who = runs(near[a:b]), []
                rare = np.unique(np.concatenate([x[a:b][i[a:b] < 0] for x, i in zip((far, token), numbers_of, strict=True)]))
                for x, i in zip((far, token), numbers_of, strict=True):
                    is_known = i[a:b] >= 0
                    number = np.empty(b - a, np.int64)
                    number[is_known] = model.number[i[a:b][is_known]]
                    number[~is_known] = len(model.known) + np.searchsorted(rare, x[a:b][~is_known])
                    who.append(small(number))
                payload.append(pack([near[a:b][names], small(np.diff(np.append(names, b - a))), *who, small(trained[a:b]), small(occurs[a:b]), small(row[ends[a] : ends[b]]), rare]))
                numbers.append(p)
            sink = pa.BufferOutputStream()
            inner = pa.RecordBatch.from_arrays([batch.column("key"), pa.array(~is_train), pa.array(lengths)], ["key", "held_out", "n_tokens"])
            with pa.ipc.new_stream(sink, inner.schema) as stream:
                stream.write_batch(inner)
            payload.append(sink.getvalue().to_pybytes())
            numbers.append(-1)
            del token, near, far, row, numbers_of, occurs, trained, first, ends
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([chunk] * len(numbers), pa.int64()), pa.array(payload, pa.binary())], ["part", "chunk", "payload"])
            del payload
            trim()

    # chunks are in the order of the upper bits, so these alone tell a part
    borders = np.array([(s << 64) // parts for s in range(1, parts)], np.uint64) & ~np.uint64(0xFFFFFF)
    grouped = min(max(parts // SPLIT, 1), MOST_GROUPED)
    shards = math.ceil(parts / ASKERS)
    limits = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group: add up each part's triples, seat them and ask for rare words' customers. Documents' rows pass through
        (payload); parts are in a column of their own (whole), which is not read for them."""
        model, held, now = shared.value, [], None

        def of_group() -> Iterator[pa.RecordBatch]:
            first = now * grouped
            group = Group(held, model.by_count, borders[first : min(first + grouped, parts) - 1])
            for p in range(first, min(first + grouped, parts)):
                columns = group.columns_of(p - first)
                if columns is not None:
                    yield out(p, Part.of(*columns))
                    del columns
                    trim()

        def out(now: int, part: Part) -> pa.RecordBatch:
            local = np.bincount(part.word, part.count, len(part.words)).astype(np.int64)
            is_known = places(part.words, model.known)
            counts = model.of_words(part.words, model.counts, local[is_known < 0])
            (_, customers, _, own, _), = model.seat(part, now, 1, None, counts)
            part.own = own
            rare, ids = part.words[is_known < 0], np.flatnonzero((is_known >= 0) & (own > 0))
            asked, edges = [], [0, *np.searchsorted(rare, limits), len(rare)]
            for a, b in zip(edges, edges[1:], strict=False):
                asked.append(pack([rare[a:b], *(small(x[is_known < 0][a:b]) for x in (own, local))]) if b > a else b"")
            few = own[is_known < 0]
            random = np.random.Generator(np.random.PCG64([now, 7]))
            tables = draw_tables(few, np.full(len(few), (STRENGTH + model.discounts[0] * model.tables) / (model.distinct + 1)), model.discounts[0], random)
            number = lambda x, k: int((x == k).sum())
            single = [(CUSTOMERS, own.sum()), (TABLES, tables.sum()), (ONE_3, number(part.count, 1)), (TWO_3, number(part.count, 2)), (ONE_2, number(customers, 1)), (TWO_2, number(customers, 2)), (ONE_1, number(few, 1)), (TWO_1, number(few, 2))]
            stats = [np.concatenate(x).astype(np.int64) for x in zip((is_known[ids], own[ids]), tuple(np.array(x) for x in zip(*single, strict=True)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([0], pa.int64()), pa.array([None], pa.binary()), pa.array([part.pack()], pa.binary()), pa.array([pack(stats)], pa.binary()), pa.array([asked], pa.list_(pa.binary()))], names)

        names = ["part", "chunk", "payload", "whole", "stats", "asked"]
        for batch in batches:
            for row in range(batch.num_rows):
                p, chunk, payload = (batch.column(i)[row].as_py() for i in range(3))
                if p < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([chunk], pa.int64()), pa.array([payload], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.list_(pa.binary()))], names)
                    continue
                if p != now and held:
                    yield from of_group()
                now = p
                held.append((chunk, payload))
        if held:
            yield from of_group()
        trim()

    spread = F.when(F.col("part") < 0, F.col("chunk")).otherwise(F.col("part"))
    release(spark)
    dealt = docs.mapInArrow(deal, "part int, chunk long, payload binary").repartition(spread, "part").sortWithinPartitions("part", "chunk")
    gathered = materialize(dealt.mapInArrow(gather, "part int, chunk long, payload binary, whole binary, stats binary, asked array<binary>"), "parts", once=True, batch=CHUNK)
    del dealt
    release(spark)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("stats").to_pylist():
                yield pa.RecordBatch.from_arrays(list(map(pa.array, unpack(raw))), ["id", "customers"])

    known = {r["id"]: r["customers"] for r in gathered.where("part >= 0").select("stats").mapInArrow(totals, "id long, customers long").groupBy("id").agg(F.sum("customers").alias("customers")).toLocalIterator()}
    final = copy.copy(model)
    final.root = np.array([known.get(i, 0) for i in range(len(model.known))], np.float64)
    share = lambda a, b: float(np.clip(a / (a + 2 * b), 0.1, 0.95)) if a + b else 0.75
    at = lambda i: known.get(i, 0)
    final.discounts = (share(at(ONE_1) + (final.root == 1).sum(), at(TWO_1) + (final.root == 2).sum()), share(at(ONE_2), at(TWO_2)), share(at(ONE_3), at(TWO_3)))
    final.customers, final.tables, random = float(at(CUSTOMERS)), float(at(TABLES) + (final.root > 0).sum()), np.random.Generator(np.random.PCG64(11))
    for _ in range(ROOT_DRAWS):  # the root's tables of known words, given how many there are in all
        opens = (STRENGTH + final.discounts[0] * final.tables) / (model.distinct + 1)
        final.tables = float(at(TABLES) + draw_tables(final.root.astype(np.int64), np.full(len(final.root), opens), final.discounts[0], random).sum())
    ready = spark.sparkContext.broadcast(final)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard: add its words' customers and counts up, and send each part those it asked for, in its order."""
        held, now = [], None

        def out() -> pa.RecordBatch:
            raw = [unpack(x) for _, x in held]
            ids, place = np.unique(np.concatenate([x[0] for x in raw]), return_inverse=True)
            sums = [np.bincount(place, np.concatenate([x[k] for x in raw])).astype(np.int64) for k in (1, 2)]
            edges = np.cumsum([0, *(len(x[0]) for x in raw)])
            payload = [pack([small(x[place[a:b]]) for x in sums]) for a, b in zip(edges, edges[1:], strict=False)]
            to = [p for p, _ in held]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([now] * len(to), pa.int64()), pa.array(payload, pa.binary())], ["part", "chunk", "payload"])

        for batch in batches:
            for p, shard, asked in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "payload")), strict=True):
                if shard != now and held:
                    yield out()
                now = shard
                held.append((p, asked))
        if held:
            yield out()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: a part, then its rare words' totals. Per chunk: its documents' known tokens, base and model log
        probabilities, summed over the task's parts."""
        model, held, size, now, whole, totals = ready.value, [], 0, None, None, []

        def add() -> int:
            rare = map(np.concatenate, zip(*map(unpack, totals), strict=True)) if totals else (np.zeros(0), np.zeros(0))
            held.append(terms_of(now, Part.unpacked(whole), model, *rare))
            totals.clear()
            trim()
            return len(held[-1][0])

        for batch in batches:
            for row in range(batch.num_rows):
                p, shard, payload = (batch.column(c)[row].as_py() for c in ("part", "chunk", "payload"))
                if shard >= 0:
                    if p != now:
                        raise ValueError("totals without their part")
                    totals.append(payload)
                    continue
                if whole is not None:
                    size += add()
                now, whole = p, payload
                if size > TERMS:
                    yield from out(held)
                    size = 0
        if whole is not None:
            add()
            whole = None
        yield from out(held)
        seatings.cache_clear()
        trim()

    def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        heads = [rows[runs(rows >> PLACE)] >> PLACE for rows, *_ in held]
        chunks = np.unique(np.concatenate(heads)) if held else np.zeros(0, np.int64)
        for i in range(0, len(chunks), CHUNKS_AT_ONCE):
            these = chunks[i : i + CHUNKS_AT_ONCE]
            cuts = [np.searchsorted(rows, [these[0] << PLACE, (these[-1] + 1) << PLACE]) for rows, *_ in held]
            rows, *values = summed(*map(np.concatenate, zip(*([x[a:b] for x in columns] for columns, (a, b) in zip(held, cuts, strict=True)), strict=True)))
            first = runs(rows >> PLACE)
            for a, b in zip(first, np.append(first[1:], len(rows)), strict=True):
                seen, base, score = (x[a:b] for x in values)
                body = pack([small(rows[a:b] & (1 << PLACE) - 1), small(seen.astype(np.int64)), base, score])
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([rows[a] >> PLACE], pa.int64()), pa.array([body], pa.binary())], ["part", "chunk", "payload"])
        held.clear()

    def summed(rows: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, place = np.unique(rows, return_inverse=True)
        return ids, *(np.bincount(place, x) for x in values)

    def terms_of(p: int, part: Part, model: Model, customers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Documents (their chunk, then PLACE bits of their place in it), and of each its known tokens, base and model log probability."""
        mean = np.zeros(len(part.word))
        count = model.of_words(part.words, model.counts, counts)
        for *_, probability in model.seat(part, p, SAMPLES, model.of_words(part.words, model.root, customers), count):
            mean += probability / SAMPLES
        del probability
        base = np.log10((count + 1) / (model.total + model.distinct + 1))[part.word]
        pair = np.repeat(part.number, part.occurs)
        rows = np.repeat(np.repeat(part.chunks, part.sizes), part.occurs) << PLACE | part.doc
        return summed(rows, (count > 0)[part.word][pair], base[pair], np.log10(mean)[pair])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by chunk and part, its documents first."""
        model, docs, now = ready.value, None, None
        sums: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            seen, base, score = sums
            return pa.RecordBatch.from_arrays([docs.column(0), docs.column(1), docs.column(2), pa.array(seen.astype(np.int64)), pa.array(np.full(len(seen), model.total, np.int64)), pa.array(base), pa.array(score)], result)

        result = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for batch in batches:
            for p, chunk, payload in zip(batch.column("part").to_pylist(), batch.column("chunk").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if p < 0:
                    if docs is not None:
                        yield out()
                    docs, now = pa.ipc.open_stream(payload).read_all().combine_chunks().to_batches()[0], chunk
                    sums[:] = [np.zeros(docs.num_rows) for _ in range(3)]
                else:
                    if chunk != now:
                        raise ValueError("terms without their documents")
                    ids, *values = unpack(payload)
                    for total, x in zip(sums, values, strict=True):
                        total[ids] += x
        if docs is not None:
            yield out()

    asked = gathered.where("part >= 0").select("part", F.posexplode("asked").alias("chunk", "payload")).where("length(payload) > 0")
    answers = asked.select("part", F.col("chunk").cast("long").alias("chunk"), "payload").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(answer, "part int, chunk long, payload binary")
    filled = gathered.where("part >= 0").select("part", F.lit(-1).cast("long").alias("chunk"), F.col("whole").alias("payload")).union(answers).repartition("part").sortWithinPartitions("part", "chunk")
    terms = materialize(filled.mapInArrow(apply, "part int, chunk long, payload binary"), "terms", once=True, batch=CHUNK)
    rows = terms.union(gathered.where("part < 0").select("part", "chunk", "payload"))
    return rows.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(finish, f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
