"""Regular expressions in linear time: an automaton reads each character once, whatever the pattern repeats.

The matcher is RE2, as in Arrow, over batches. What no automaton can tell (a back-reference, a look around, a group that is
possessive or atomic) is refused by name before anything is planned.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What backtracking engines have and an automaton hasn't.
_BEYOND = (
    ("back-references", r"\\[1-9]|\\k[<{']|\(\?P=|\(\?\("),
    ("looking ahead or behind", r"\(\?<?[=!]"),
    ("atomic groups", r"\(\?>"),
    ("possessive repeats", r"[*+?}]\+"),
)


def without_literals(pattern: str) -> str:
    """The pattern with escaped backslashes, quoted parts and classes of characters taken out: what is left are operators."""
    return re.sub(r"\\\\|\\Q.*?(?:\\E|$)|\[\^?\]?(?:\\.|[^\]\\])*\]|\\[^1-9k]", "", pattern, flags=re.S)


def validate(pattern: str) -> None:
    """ValueError, which says why, for what isn't a pattern or can't be matched in linear time."""
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
        return
    except pa.ArrowInvalid as e:
        for name, sign in _BEYOND:
            if re.search(sign, without_literals(pattern)):
                raise ValueError(f"{name} can't be matched in linear time") from e
        raise ValueError(f"not a regular expression: {e}") from e


def matches(column: Column, pattern: str, match_case: bool = True) -> Column:
    """Whether the pattern is found in a text; null for null."""
    validate(pattern)

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts.cast(pa.large_string()), pattern, ignore_case=not match_case)

    return found(column)
