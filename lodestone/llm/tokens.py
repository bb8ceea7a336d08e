"""Byte-level BPE with the public 50k vocabulary: pre-tokens, ids and piece counts, equal to what the tokenizers library gives.

The pre-tokens come from a regular expression wherever its character classes agree with the library's (the code points of
COMMON, which a test compares one by one); texts with other characters go through the library's own pre-tokenizer.
"""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np
import public_tokenizers
import regex
import tiktoken
import tokenizers

#: Latin, Greek, Cyrillic and Armenian letters, and general punctuation.
COMMON = ((0x0000, 0x0557), (0x2000, 0x206F))
_RARE = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in COMMON) + "]")
_PIECES = regex.compile(public_tokenizers.PATTERN)


class ByteBPE:
    """path: a tokenizers JSON file of a byte-level BPE; a .tiktoken file of the same name beside it holds its ranks."""

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.special = {x["content"]: x["id"] for x in json.load(open(path, encoding="utf-8"))["added_tokens"]}
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.first = min((x[:2] for x in self.special), default="")

    def ids(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit, special strings recognised, nothing added."""
        if _RARE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.ranks.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The text's pre-tokens and how many special strings it holds (each one token)."""
        if not self.special or self.first not in text:
            return self._plain(text), 0
        parts = self.split.split(text)
        return [x for part in parts for x in self._plain(part)], len(parts) - 1

    def _plain(self, text: str) -> list[str]:
        if not _RARE.search(text):
            return _PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, pre_token: str) -> int:
        """Pieces of one pre-token."""
        if _RARE.search(pre_token):
            return len(self.library.encode(pre_token, add_special_tokens=False).ids)
        return len(self.ranks._core_bpe.encode_ordinary(pre_token))


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    """One instance a worker."""
    return ByteBPE(path)
