"""Models as functions that a user supplies: text and image vectors, tags, recognised text. None is bundled.

A factory is called once a Python worker and gives a function of a list; it is applied to Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts in one call, and the shortest text to which a refused one is cut (by a third each time).
CALL, SHORTEST = 4, 80


class TooLarge(Exception):
    """Raised by a model that can't take so much at once."""


def with_recovery(model: Callable[[list[str]], list[list[float]]], texts: list[str]) -> list[list[float]]:
    """A refused call is made text by text, and a refused text cut to two thirds."""
    try:
        return model(texts)
    except TooLarge:
        if len(texts) > 1:
            return [v for t in texts for v in with_recovery(model, [t])]
        if len(texts[0]) <= SHORTEST:
            raise
        return with_recovery(model, [texts[0][: max(SHORTEST, len(texts[0]) * 2 // 3)]])


def embed_text(column: Column, factory: Callable[[], Callable[[list[str]], list[list[float]]]], purpose: str = "passage") -> Column:
    """A vector of each text (null: null), with the prefix for its purpose: query or passage."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            out: list[list[float] | None] = [None] * len(texts)
            have = [i for i, t in enumerate(texts) if t is not None]
            for s in range(0, len(have), CALL):
                part = have[s : s + CALL]
                for i, v in zip(part, with_recovery(model, [f"{purpose}: {texts.iloc[i]}" for i in part]), strict=True):
                    out[i] = v
            yield pd.Series(out)

    return embed(column)


def analyze_images(column: Column, factory: Callable[[], Callable[[bytes], list[tuple[str, str, float]]]]) -> Column:
    """Tags of each image: name, category, confidence. A failed image has none."""

    @F.pandas_udf("array<struct<name: string, category: string, confidence: double>>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for images in batches:
            out = []
            for image in images:
                try:
                    out.append([] if image is None else [{"name": n, "category": c, "confidence": float(x)} for n, c, x in model(image)])
                except ValueError:
                    out.append([])
            yield pd.Series(out)

    return tag(column)


#: Bytes of an image or document that are recognised, characters kept, pixels of a side of a model's input, and the least
#: aspect from which the middle of an image is looked at as well.
MOST_BYTES, MOST_CHARACTERS, SIDE, ASPECT = 48 << 20, 12_000, 224, 1.18


def recognize_text(column: Column, factory: Callable[[], Callable[[bytes], str]], most: int = MOST_CHARACTERS, most_bytes: int = MOST_BYTES) -> Column:
    """Text in each image, at most so many characters; larger files have none."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for images in batches:
            yield pd.Series([None if i is None else model(i)[:most] for i in images], dtype=object)

    return read(F.when(F.octet_length(column) <= most_bytes, column))


def pages_of(pages: int) -> list[int]:
    """Numbers of the pages that are recognised: all of three, else the first, middle and last."""
    return list(range(pages)) if pages <= 3 else [0, pages // 2, pages - 1]


def recognize_pages(column: Column, factory: Callable[[], tuple[Callable[[bytes], int], Callable[[bytes, int], str]]], most: int = MOST_CHARACTERS, most_bytes: int = MOST_BYTES) -> Column:
    """Text of a document's sampled pages: struct of text, pages (in all), analyzed, was_truncated. factory gives two functions:
    how many pages a document has, and the text of one. A document that can't be read has none."""

    @F.pandas_udf("struct<text: string, pages: int, analyzed: int, was_truncated: boolean>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count, page = factory()
        for documents in batches:
            out = []
            for d in documents:
                try:
                    n = 0 if d is None else count(d)
                    chosen = pages_of(n)
                    text = " ".join(" ".join(page(d, i) for i in chosen).split())
                    out.append((text[:most] if n else None, n, len(chosen), len(text) > most or len(chosen) < n))
                except ValueError:
                    out.append((None, 0, 0, False))
            yield pd.DataFrame(out, columns=["text", "pages", "analyzed", "was_truncated"])

    return read(F.when(F.octet_length(column) <= most_bytes, column))


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, of height x width x channels."""
    ys, xs = ((np.arange(n) + 0.5) * old / n - 0.5 for n, old in ((height, image.shape[0]), (width, image.shape[1])))
    y0, x0 = np.clip(np.floor(ys).astype(int), 0, image.shape[0] - 1), np.clip(np.floor(xs).astype(int), 0, image.shape[1] - 1)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None, None], np.clip(xs - x0, 0, 1)[None, :, None]
    image = image.astype(np.float64)
    return (image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx) * (1 - fy) + (image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx) * fy


def frames(image: np.ndarray) -> list[list[float]]:
    """An image (height x width x 3, 0 to 255) as a model's inputs: whole, and its middle square if it is long; planes of red,
    green and blue from -1 to 1."""
    h, w = image.shape[:2]
    cuts, side = [image], min(h, w)
    if max(h, w) / side >= ASPECT:
        top, left = (h - side) // 2, (w - side) // 2
        cuts.append(image[top : top + side, left : left + side])
    return [((resize(c, SIDE, SIDE) / 255.0 - 0.5) / 0.5).transpose(2, 0, 1).ravel().astype(np.float32).tolist() for c in cuts]


def image_frames(column: Column, factory: Callable[[], Callable[[bytes], np.ndarray]]) -> Column:
    """frames() of each image that the decoder can read; others have none."""

    @F.pandas_udf("array<array<float>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = factory()
        for images in batches:
            out = []
            for image in images:
                try:
                    out.append([] if image is None else frames(decode(image)))
                except ValueError:
                    out.append([])
            yield pd.Series(out)

    return cut(column)


def embed_regions(column: Column, factory: Callable[[], Callable[[list[list[float]]], list[list[float]]]]) -> Column:
    """Vectors of an image's frames, a vector a frame; an image without frames has none."""

    @F.pandas_udf("array<array<float>>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for images in batches:
            yield pd.Series([[list(map(float, v)) for v in model([list(x) for x in i])] if i is not None and len(i) else [] for i in images])

    return embed(column)


def prompt_pieces(column: Column, path: str, length: int = 64) -> Column:
    """Struct of ids and mask: a prompt in lower case as a SentencePiece model's ids with the end id last, cut to the length (the
    end stays) and filled up with the padding id."""

    @F.pandas_udf("struct<ids: array<int>, mask: array<int>>")
    def encode(texts: pd.Series) -> pd.DataFrame:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        end, pad = model.eos_id(), max(model.pad_id(), 0)
        out = []
        for text in texts.fillna(""):
            ids = [*model.encode(" ".join(text.lower().split())), end]
            ids = ids if len(ids) <= length else [*ids[: length - 1], end]
            out.append((ids + [pad] * (length - len(ids)), [1] * len(ids) + [0] * (length - len(ids))))
        return pd.DataFrame(out, columns=["ids", "mask"])

    return encode(column)


def sampled_pages(pages: Column) -> Column:
    """pages_of() as a column."""
    return F.when(pages <= 3, F.sequence(F.lit(0), F.greatest(pages, F.lit(1)) - 1)).otherwise(F.array(F.lit(0), F.floor(pages / 2).cast("int"), pages - 1))
