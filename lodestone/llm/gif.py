"""GIF as media columns: encoding of 8-bit samples, and decoding of LZW code streams to timed frames with colour histograms.

The decoder reads GIF87a and GIF89a: global and local palettes, interlace, transparency, the disposal rules and delays. The
encoder builds the LZW dictionary (compress=False: literal codes only). Texts become frames of 64 samples a row: a byte is an
index of the palette INK, blanks are transparent, frames stay or are cleared in turn, and a frame is shown as long as it has
rows to read. Frames of a text share nothing but the palette and the canvas, so samples are read back whole from each.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import materialize, slices, table

WIDTH, MOST_ROWS = 64, 64
#: Entries of the tables of frames that are coded together, and frames that go one by one instead.
TABLES, FEW = 1 << 23, 32
#: Pixels of a canvas or frame that the decoder reads; larger ones are errors (a header can ask for 4 billion).
MOST_PIXELS = 1 << 26
#: Payloads are filled with bytes 0 to a positive multiple of this.
UNIT = 64
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
BINS = 64
#: The texts' palette: red by the byte's kind (control, sign, digit, capital, letter, other), green and blue by the byte.
_BYTES = np.arange(256)
INK = np.stack([np.select([_BYTES < 33, _BYTES < 48, _BYTES < 58, _BYTES < 91, _BYTES < 127], [0, 60, 100, 140, 200], 250), _BYTES * 37 % 256, 255 - _BYTES], axis=1).astype(np.uint8).tobytes()
#: The texts' transparent index, disposal rules in turn, and hundredths of a second that a row is shown.
BLANK, DISPOSALS, ROW_TIME = 0x20, (1, 2, 3), 2


@dataclass
class Frame:
    x: int
    y: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    samples: np.ndarray  # palette indexes, height x width
    histogram: np.ndarray  # of the composed canvas: 4 x 4 x 4 colour cubes, opaque pixels only
    rgba: np.ndarray | None = None


@dataclass
class Media:
    width: int = 0
    height: int = 0
    loops: int | None = None
    frames: list[Frame] = field(default_factory=list)
    error: str | None = None


def pack_codes(codes: np.ndarray, bits: int) -> bytes:
    """Codes of one width as bytes, lowest bit first."""
    flat = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flat.reshape(-1), bitorder="little").tobytes()


def lzw_literal(samples: np.ndarray, depth: int = 8) -> bytes:
    """A clear code before every 2**depth - 2 literal codes, so all codes have depth + 1 bits."""
    run = 2**depth - 2
    pad = -len(samples) % run
    rows = np.zeros((len(samples) + pad) // run * (run + 1), np.uint16).reshape(-1, run + 1)
    rows[:, 0] = 2**depth
    rows[:, 1:] = np.append(samples, np.zeros(pad, samples.dtype)).reshape(-1, run)
    codes = rows.reshape(-1)[: rows.size - pad]
    return pack_codes(np.append(codes, 2**depth + 1), depth + 1)


@functools.lru_cache(8)
def _ends(depth: int) -> np.ndarray:
    """Bits of the first 0, 1, 2, ... codes of a run (between two clear codes): codes grow from depth + 1 bits to 12."""
    return np.cumsum([0, *(min(12, (2**depth + 1 + i).bit_length()) for i in range(3 * 4096))])


def lzw_compress(samples: bytes, depth: int = 8) -> bytes:
    """The dictionary coder: a clear code first and whenever the table is full."""
    clear, known = 2**depth, {}
    codes, get, following = [clear], known.get, clear + 2
    put, now = codes.append, None
    for b in samples:
        if now is None:
            now = b
        elif longer := get(now << 8 | b):
            now = longer
        else:
            put(now)
            if following < 4096:
                known[now << 8 | b] = following
                following += 1
            else:
                put(clear)
                known.clear()
                following = clear + 2
            now = b
    if now is not None:
        put(now)
    put(clear + 1)
    return _pack(np.array(codes, np.int64), np.array([0, len(codes)]), depth)[0]


def lzw_compress_all(frames: list[np.ndarray]) -> list[bytes]:
    """lzw_compress of each frame of 8-bit samples. Many frames take their steps together, a sample of each at a time."""
    out: list[bytes] = [b""] * len(frames)
    order = sorted(range(len(frames)), key=lambda i: -len(frames[i]))
    while order:
        slots = 1 << max(6, 2 * min(len(frames[order[0]]), 3838) - 1).bit_length()
        group, order = order[: max(1, TABLES // slots)], order[max(1, TABLES // slots) :]
        if len(group) < FEW or len(frames[group[-1]]) * 8 < len(frames[group[0]]) and len(frames[group[FEW - 1]]) * 2 < len(frames[group[0]]):
            group, order = group[:FEW], group[FEW:] + order
            streams = [lzw_compress(frames[i].tobytes()) for i in group]
        else:
            streams = _pack(*_together([frames[i] for i in group], slots), 8)
        for i, stream in zip(group, streams, strict=True):
            out[i] = stream
    return out


def _together(frames: list[np.ndarray], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """frames, longest first: all their codes, and where each frame's begin (and the end). The table of a frame is a row of
    `slots` entries by a hash, with the next ones tried in turn; an entry is key << 12 | code, the key prefix code << 8 | sample."""
    n, sizes = len(frames), np.array([len(f) for f in frames])
    data = np.zeros((int(sizes[0]), n), np.uint32)
    for i, f in enumerate(frames):
        data[: len(f), i] = f
    table_, shift, last = np.zeros(n * slots, np.uint32), np.uint32(33 - slots.bit_length()), slots - 1
    base = np.arange(n) * slots
    made = np.full((int(sizes[0]) + 1, n), 0xFFFF, np.uint16)  # the code put before each sample; 0x8000: a clear code after it
    now, following = data[0].copy(), np.full(n, 258, np.uint32)
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1), side="left")  # frames longer than t
    for t in range(1, int(sizes[0])):
        m = int(active[t])
        sample = data[t, :m]
        key = now[:m] << np.uint32(8) | sample
        at = base[:m] + (key * np.uint32(2654435761) >> shift)
        entry = table_[at]
        other = np.flatnonzero((entry != 0) & (entry >> np.uint32(12) != key))
        while len(other):
            at[other] = base[other] + ((at[other] + 1) & last)
            entry[other] = found = table_[at[other]]
            other = other[(found != 0) & (found >> np.uint32(12) != key[other])]
        now[:m] = np.where(entry, entry & np.uint32(4095), now[:m])
        miss = np.flatnonzero(entry == 0)
        put = now[miss]
        made[t, miss] = put
        full = following[miss] == 4096
        table_[at[miss]] = key[miss] << np.uint32(12) | following[miss] * ~full
        following[miss] += 1
        if full.any():
            for i in miss[full]:
                table_[base[i] : base[i] + slots] = 0
            following[miss[full]] = 258
            made[t, miss[full]] |= 0x8000
        now[miss] = sample[miss]
    made[sizes, np.arange(n)] = now
    flat, keep = made.T, made.T != 0xFFFF
    counts, codes = keep.sum(axis=1), flat[keep].astype(np.int64)
    clears = codes >= 0x8000
    edges = np.cumsum(np.append(0, counts))
    before = np.append(0, np.cumsum(clears))[edges]  # clear codes in earlier frames
    codes = np.insert(codes & 0x7FFF, np.flatnonzero(clears) + 1, 256)
    edges += before
    codes = np.insert(codes, np.repeat(edges, [1, *[2] * (n - 1), 1]), [256, *[257, 256] * (n - 1), 257])
    return codes, edges + 2 * np.arange(n + 1)


def _pack(codes: np.ndarray, edges: np.ndarray, depth: int) -> list[bytes]:
    """Each stream's codes as bytes, lowest bit first, a code as wide as its place in its run asks."""
    place = np.arange(len(codes))
    last = np.maximum.accumulate(np.where(codes == 2**depth, place, -1))
    run = place - np.append(-1, last[:-1]) - 1
    run[edges[:-1]] = 0
    ends = _ends(depth)
    run = np.minimum(run, 4095)
    width = ends[run + 1] - ends[run]
    upto = np.append(0, np.cumsum(width))
    size = -(-np.diff(upto[edges]) // 8)
    starts = np.append(0, np.cumsum(size))
    bit = upto[:-1] - np.repeat(upto[edges[:-1]], np.diff(edges)) + 8 * np.repeat(starts[:-1], np.diff(edges))
    spread, byte = codes << (bit & 7), bit >> 3
    out = sum(np.bincount(byte + i, spread >> 8 * i & 255, int(starts[-1]) + 2) for i in range(3)).astype(np.uint8).tobytes()
    return [out[a:b] for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]


def unpack_codes(streams: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all streams: the codes but clear and stop, in order, with each code's stream and its place in its run.

    All streams go block by block together: the widths of a run's codes are known beforehand, so a block is read as arrays,
    and what follows its first clear code is read again. A stream may end without a stop code, and go on with a full table.
    """
    clear, ends, block = 2**depth, _ends(depth), 4096
    size = np.array([len(x) for x in streams], np.int64)
    data = np.frombuffer(b"".join([*streams, bytes(3)]), np.uint8)
    finish = 8 * np.cumsum(size)
    at, place, active = finish - 8 * size, np.zeros(len(streams), np.int64), np.flatnonzero(size)
    out = []
    while len(active):
        a, p = at[active], np.minimum(place[active], 4096)
        n = np.minimum(np.searchsorted(ends, ends[p] + finish[active] - a, side="right") - 1 - p, block)
        active, a, p, n = active[n > 0], a[n > 0], p[n > 0], n[n > 0]
        if not len(active):
            break
        first = np.cumsum(n) - n
        k = np.arange(n.sum()) - np.repeat(first, n)
        q = np.repeat(p, n) + k
        begin = np.repeat(a - ends[p], n) + ends[q]
        byte = begin >> 3
        word = data[byte].astype(np.uint32) | data[byte + 1].astype(np.uint32) << np.uint32(8) | data[byte + 2].astype(np.uint32) << np.uint32(16)
        codes = word >> (begin & 7).astype(np.uint32) & ((1 << (ends[q + 1] - ends[q])) - 1).astype(np.uint32)
        here = np.minimum.reduceat(np.where((codes == clear) | (codes == clear + 1), k, block), first)
        used = k < np.repeat(here, n)
        out.append((codes[used].astype(np.int64), np.repeat(active, n)[used], (np.repeat(place[active], n) + k)[used]))
        special = here < n
        ended = special & (codes[first + np.minimum(here, n - 1)] == clear + 1)
        read = np.where(special, here + 1, n)
        at[active] = a + ends[p + read] - ends[p]
        place[active] = np.where(special, 0, place[active] + n)
        active = active[~ended]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    codes, stream, place = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(stream, kind="stable") if len(out) > 1 else slice(None)
    return codes[order], stream[order], place[order]


def lzw_decode_all(streams: list[bytes], depth: int, most: list[int]) -> list[np.ndarray]:
    """The first samples of each code stream, most of them at most; those before a code that has no entry.

    The entry that a run's k-th code makes is what that code stands for and the sample after it in the output. So a code is as
    long as the one it refers to and one more, and its samples are copies of earlier ones: both are found by doubling steps.
    """
    clear = 2**depth
    codes, stream, place = unpack_codes(streams, depth)
    index, literal = np.arange(len(codes)), codes < clear
    refers = np.where(literal, index, index - place + codes - clear - 2)
    bad = np.flatnonzero(refers > index - ~literal)
    if len(bad):  # a stream ends before its first such code
        cut = np.full(len(streams), len(codes))
        np.minimum.at(cut, stream[bad], bad)
        keep = index < cut[stream]
        moved = np.cumsum(keep) - 1
        codes, stream, literal, refers = codes[keep], stream[keep], literal[keep], moved[refers[keep]]
    length, step = 1 + ~literal, refers
    while True:
        more = length[step] - 1
        if not more.any():
            break
        length, step = length + more, step[step]
    edges = np.searchsorted(stream, np.arange(len(streams) + 1))
    upto = np.append(0, np.cumsum(length))
    keep = upto[:-1] - upto[edges[:-1]][stream] < np.array(most, np.int64)[stream]
    if not keep.all():  # a stream's first codes are kept, so what they refer to is too
        moved = np.cumsum(keep) - 1
        codes, stream, literal, refers, length = codes[keep], stream[keep], literal[keep], moved[refers[keep]], length[keep]
        edges = np.searchsorted(stream, np.arange(len(streams) + 1))
        upto = np.append(0, np.cumsum(length))
    kind = np.int32 if upto[-1] < 2**31 else np.int64
    start = upto[:-1].astype(kind)
    back = (start - start[refers]).astype(kind)  # how far before a sample its copy is
    source = np.arange(upto[-1], dtype=kind) - np.repeat(back, length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    samples = np.zeros(int(upto[-1]), np.uint8)
    samples[start[literal]] = codes[literal]
    samples = samples[source]
    return [samples[a : min(b, a + m)] for a, b, m in zip(upto[edges[:-1]].tolist(), upto[edges[1:]].tolist(), most, strict=True)]


def lzw_decode(raw: bytes, depth: int, most: int) -> np.ndarray:
    return lzw_decode_all([raw], depth, [most])[0]


def _by_code(raw: bytes, depth: int, most: int) -> np.ndarray:
    """lzw_decode bit by bit: its yardstick."""
    clear, stop = 2**depth, 2**depth + 1
    first = [bytes([i]) for i in range(clear)] + [b"", b""]
    known, width, before, out, size = list(first), depth + 1, None, [], 0
    held = bits = 0
    for b in raw:
        held |= b << bits
        bits += 8
        while bits >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            bits -= width
            if code == clear:
                known, width, before = list(first), depth + 1, None
                continue
            if code == stop:
                return np.frombuffer(b"".join(out), np.uint8)[:most]
            if before is None:
                if code >= clear:
                    raise ValueError("a run begins with a code that has no entry")
                now = known[code]
            else:
                if code < len(known):
                    now = known[code]
                elif code == len(known) and code < 4096:
                    now = before + before[:1]
                else:
                    raise ValueError("a code has no entry")
                if len(known) < 4096:
                    known.append(before + now[:1])
                    if len(known) == 1 << width and width < 12:
                        width += 1
            out.append(now)
            before = now
            size += len(now)
            if size >= most:
                return np.frombuffer(b"".join(out), np.uint8)[:most]
    return np.frombuffer(b"".join(out), np.uint8)[:most]


def _blocks(raw: bytes) -> bytes:
    """Sub-blocks of up to 255 bytes, each after its length, and the empty one."""
    whole = len(raw) // 255
    rows = np.empty((whole, 256), np.uint8)
    rows[:, 0] = 255
    rows[:, 1:] = np.frombuffer(raw, np.uint8)[: whole * 255].reshape(whole, 255)
    rest = raw[whole * 255 :]
    return rows.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_gifs(payloads: list[bytes], width: int = WIDTH, most_rows: int = MOST_ROWS, palette: bytes = GREY, delay_ms: int | None = 100, disposal: int | tuple[int, ...] = 2, transparent: int | None = None, compress: bool = True) -> list[bytes]:
    """8-bit samples, row by row, as frames of up to most_rows rows. disposal: one for all frames, or several in turn.
    delay_ms: of each frame; None: as many rows as it has, by ROW_TIME."""
    size = width * most_rows
    if any(not x or len(x) % width for x in payloads):
        raise ValueError("the samples don't fill rows")
    parts = [np.frombuffer(x, np.uint8)[at : at + size] for x in payloads for at in range(0, len(x), size)]
    streams = iter(lzw_compress_all(parts) if compress else map(lzw_literal, parts))
    out = []
    for x in payloads:
        rules = itertools.cycle((disposal,) if isinstance(disposal, int) else disposal)
        rows = len(x) // width
        made = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, most_rows), 0xF7, 0, 0), palette, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
        for top in range(0, rows, most_rows):
            height = min(most_rows, rows - top)
            delay = height * ROW_TIME if delay_ms is None else delay_ms // 10
            made.append(b"\x21\xf9\x04" + struct.pack("<BHB", next(rules) << 2 | (transparent is not None), delay, transparent or 0) + b"\0")
            made.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08")
            made.append(_blocks(next(streams)))
        out.append(b"".join([*made, b"\x3b"]))
    return out


def encode_gif(samples: bytes, **options) -> bytes:
    """One payload of encode_gifs."""
    return encode_gifs([samples], **options)[0]


def decode_gifs(raws: list[bytes | None], with_rgba: bool = False) -> list[Media]:
    """All frames of each; where a stream breaks, those before it and an error. The code streams are decoded together."""
    found = [(Media(), []) for _ in raws]
    for raw, (media, parts) in zip(raws, found, strict=True):
        try:
            _parse(raw or b"", media, parts)
        except (ValueError, IndexError, struct.error) as e:
            media.error = str(e) or type(e).__name__
    every = [p for _, parts in found for p in parts]
    for depth in {p.depth for p in every}:
        of = [p for p in every if p.depth == depth]
        for p, samples in zip(of, lzw_decode_all([p.stream for p in of], depth, [p.width * p.height for p in of]), strict=True):
            p.samples = samples
    for media, parts in found:
        try:
            _compose(media, parts, with_rgba)
        except ValueError as e:
            media.error = str(e)
    return [media for media, _ in found]


def decode_gif(raw: bytes | None, with_rgba: bool = False) -> Media:
    return decode_gifs([raw], with_rgba)[0]


@dataclass
class Part:
    """A frame as it is stored."""

    x: int
    y: int
    width: int
    height: int
    interlaced: bool
    palette: bytes
    depth: int
    stream: bytes
    delay: int
    disposal: int
    transparent: int | None
    samples: np.ndarray | None = None


def _parse(raw: bytes, media: Media, parts: list[Part]) -> None:
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    media.width, media.height, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
    at, shared = 13, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        shared, at = raw[at : at + size], at + size
    if media.height * media.width > MOST_PIXELS:
        raise ValueError("a canvas of too many pixels")
    delay, disposal, transparent = 0, 0, None

    def blocks() -> bytes:
        nonlocal at
        found = []
        while size := raw[at]:
            if at + 1 + size > len(raw):
                raise ValueError("a block is cut off")
            found.append(raw[at + 1 : at + 1 + size])
            at += 1 + size
        at += 1
        return b"".join(found)

    while True:
        kind = raw[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = raw[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                flags, delay, index = struct.unpack("<BHB", body[:4])
                disposal, transparent = flags >> 2 & 7, index if flags & 1 else None
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                media.loops = struct.unpack("<H", body[12:14])[0]
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        x, y, w, h, flags = struct.unpack_from("<HHHHB", raw, at)
        at += 9
        palette = shared
        if flags & 0x80:
            size = 3 << ((flags & 7) + 1)
            palette, at = raw[at : at + size], at + size
        if palette is None:
            raise ValueError("a frame has no palette")
        depth = raw[at]
        at += 1
        if not 1 <= depth <= 8:
            raise ValueError("a code size out of range")
        if w * h > MOST_PIXELS:
            raise ValueError("a frame of too many pixels")
        parts.append(Part(x, y, w, h, bool(flags & 0x40), palette, depth, blocks(), delay, disposal, transparent))
        delay, disposal, transparent = 0, 0, None


@functools.lru_cache(64)
def _colours(palette: bytes, transparent: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each index: red, green, blue, alpha; and its colour cube (BINS: transparent)."""
    colours = np.zeros((256, 4), np.uint8)
    table_ = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    colours[: len(table_), :3], colours[: len(table_), 3] = table_, 255
    if transparent is not None:
        colours[transparent] = 0
    return colours, np.where(colours[:, 3] > 0, colours[:, 0] >> 6 << 4 | colours[:, 1] >> 6 << 2 | colours[:, 2] >> 6, BINS).astype(np.uint8)


def _compose(media: Media, parts: list[Part], with_rgba: bool) -> None:
    """Draw the frames on the canvas: what shows of each, and what its disposal leaves for the next."""
    if not parts:
        return
    shade = np.full((media.height, media.width), BINS, np.uint8)  # each pixel's colour cube
    canvas = np.zeros((media.height, media.width, 4), np.uint8) if with_rgba else None
    for p in parts:
        if len(p.samples) < p.width * p.height:
            raise ValueError("a frame has too few samples, or a code without an entry")
        samples = p.samples.reshape(p.height, p.width)
        if p.interlaced:
            order = np.concatenate([np.arange(s, p.height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        colours, cubes = _colours(p.palette, p.transparent)
        seen = samples[: max(0, media.height - p.y), : max(0, media.width - p.x)]
        layers = [(shade, cubes, BINS)] + [(canvas, colours, 0)] * with_rgba
        places = [layer[p.y : p.y + seen.shape[0], p.x : p.x + seen.shape[1]] for layer, _, _ in layers]
        before = [x.copy() for x in places] if p.disposal == 3 else None
        shows = seen != p.transparent if p.transparent is not None else np.True_
        for place, (_, paint, _) in zip(places, layers, strict=True):
            np.copyto(place, paint[seen], where=shows if place.ndim == 2 or p.transparent is None else shows[:, :, None])
        histogram = np.bincount(shade.reshape(-1), minlength=BINS + 1)[:BINS]
        media.frames.append(Frame(p.x, p.y, p.width, p.height, p.delay * 10, p.disposal, p.transparent, samples, histogram, canvas.copy() if with_rgba else None))
        for i, (place, (_, _, nothing)) in enumerate(zip(places, layers, strict=True)):
            if p.disposal == 2:
                place[:] = nothing
            elif p.disposal == 3:
                place[:] = before[i]


MEDIA = "width int, height int, loops int, frames array<struct<x: int, y: int, width: int, height: int, delay_ms: int, disposal: int, transparent: int, samples: binary, histogram: array<long>, rgba: binary>>, error string"


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, n_bytes, media (a GIF of the text's UTF-8 bytes, filled with bytes 0 to a multiple of UNIT).

    A null text is empty (one row of 64 zeros). Other columns are ignored; repeated rows and null keys are kept.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 3 << 20):
            raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
            media = encode_gifs([x + bytes(-len(x) % UNIT or UNIT * (not x)) for x in raw], palette=INK, delay_ms=None, disposal=DISPOSALS, transparent=BLANK)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return docs.mapInArrow(encode, f"{key} {docs.schema['key'].dataType.simpleString()}, n_bytes long, media binary")


def decode_media(rows: DataFrame, key: str = "doc_id", media: str = "media", with_rgba: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, the columns named in keep, and those of MEDIA. Null or broken media have an error and the frames before it."""
    rows = rows.select(F.col(key).alias("key"), F.col(media).alias("media"), *keep)
    schema = StructType([StructField(key, rows.schema["key"].dataType), *(rows.schema[c] for c in keep), *StructType.fromDDL(MEDIA)])
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 1 << 20):
            found = decode_gifs(batch.column(1).to_pylist(), with_rgba)
            frames = [f for m in found for f in m.frames]
            kinds = arrow.field("frames").type.value_type
            whole = [[getattr(f, n) for f in frames] for n in ("x", "y", "width", "height", "delay_ms", "disposal", "transparent")]
            histogram = np.concatenate([f.histogram for f in frames]) if frames else np.zeros(0, np.int64)
            histograms = pa.ListArray.from_arrays(pa.array(np.arange(len(frames) + 1) * BINS, pa.int32()), pa.array(histogram))
            values = [*whole, [f.samples.tobytes() for f in frames], histograms, [None if f.rgba is None else f.rgba.tobytes() for f in frames]]
            made = pa.StructArray.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k.type) for v, k in zip(values, kinds, strict=True)], fields=list(kinds))
            edges = pa.array(np.cumsum([0, *(len(m.frames) for m in found)]), pa.int32())
            of = lambda n: pa.array([getattr(m, n) for m in found], arrow.field(n).type)
            columns = [batch.column(0), *batch.columns[2:], of("width"), of("height"), of("loops"), pa.ListArray.from_arrays(edges, made), of("error")]
            yield pa.RecordBatch.from_arrays(columns, [key, *keep, "width", "height", "loops", "frames", "error"])

    return rows.mapInArrow(decode, schema)


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(encode_texts(table(spark, sf_dir, "documents")), "media").withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    decoded = decode_media(stored, keep=("n_bytes", "media_bytes", "media_sha256"))
    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for error, width, height, frames in zip(*(batch.column(c) for c in ("error", "width", "height", "frames")), strict=True):
                if error.is_valid:
                    raise ValueError(error.as_py())
                of = frames.values.flatten()
                names = [k.name for k in frames.type.value_type]
                payload = b"".join(of[names.index("samples")].to_pylist())
                histogram = of[names.index("histogram")].flatten().to_numpy().reshape(-1, BINS).sum(axis=0)
                shown = sum(of[names.index("delay_ms")].to_pylist())
                feature = f"{len(frames)}x{width}x{height};{shown}ms;" + ",".join(f"{i}:{n}" for i, n in enumerate(histogram.tolist()) if n)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature))
            arrays = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256")), *arrays], ["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    kind = decoded.schema["doc_id"].dataType.simpleString()
    found = decoded.drop("loops").mapInArrow(digest, f"doc_id {kind}, n_bytes long, media_bytes long, media_sha256 string, {made}")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
