"""Text column builders. All but nfkc are built-in expressions.

Two classes of letters and digits are kept apart: tokens take every number (\\p{N}), identifiers and profiles decimal digits
only (\\p{Nd}).
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans import fixed

HANGUL, LATIN, DIGIT, LETTER = "가-힣ᄀ-ᇿ㄰-㆏", "A-Za-z", r"\p{Nd}", r"\p{L}"
#: Occurrences of a word that count.
MOST_OCCURRENCES = 8


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which has no built-in."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def count_of(column: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(column, f"[^{characters}]", "")).cast("long")


def script_profile(column: Column) -> Column:
    """Struct of Hangul, Latin, digit and letter counts; null text: null (unknown)."""
    return F.when(column.isNotNull(), F.struct(count_of(column, HANGUL).alias("hangul"), count_of(column, LATIN).alias("latin"), count_of(column, DIGIT).alias("digits"), count_of(column, LETTER).alias("letters")))


def script_matches(profile: Column, script: str, mode: str) -> Column:
    """Whether a profile meets a predicate; null if the profile is unknown."""
    count = profile[{"Hangul": "hangul", "Latin": "latin", "Digit": "digits"}[script]]
    meaningful = profile["letters"] + profile["digits"]
    return {
        "Excludes": count == 0,
        "Contains": count > 0,
        "Only": (count > 0) & (count == meaningful),
        "Predominantly": (count >= 5) & (count / F.greatest(F.lit(1), meaningful) >= 0.6),
    }[mode]


def attribute(predicate: tuple[str, str, str], name: Column, path: Column, content: Column) -> Column:
    """A (script, scope, mode) predicate in three-valued logic: content is a profile, null if unknown."""
    script, scope, mode = predicate
    by_name, by_path, by_text = (script_matches(x, script, mode) for x in (script_profile(name), script_profile(path), content))
    if scope == "NameOrContent":
        return by_name & by_text if mode == "Excludes" else by_name | by_text
    return {"Name": by_name, "Path": by_path, "Content": by_text}[scope]


#: A word with an ending that leaves two characters or a short word; the longest such ending goes.
_ENDED = f"^([{''.join(sorted(fixed.SHORT_WORDS))}]|.{{2,}}?)(?:{'|'.join(fixed.ENDINGS)})$"


def tokens(column: Column) -> Column:
    """Words of letters and numbers in lower case, without their Korean endings."""
    found = F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.when(column.rlike("[가-힣]"), F.transform(found, lambda w: F.regexp_replace(w, _ENDED, "$1"))).otherwise(found)


_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "\u3000"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def narrow(column: Column) -> Column:
    """Full-width forms as ordinary letters, digits and signs: the part of compatibility composition that names need, built in."""
    return F.translate(column, _WIDE, _NARROW)


def normalized(column: Column) -> Column:
    """Lower-case letters and digits, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{Nd}]+", " "))


def compact(column: Column) -> Column:
    return F.regexp_replace(F.lower(column), r"[^\p{L}\p{Nd}]+", "")


def split_identifier(column: Column) -> Column:
    """Words of an identifier: cut where a capital follows a small letter, and at other signs."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(column, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"[^\p{L}\p{Nd}]+", " ")))


def occurrences(column: Column, word: str) -> Column:
    """Non-overlapping occurrences, MOST_OCCURRENCES at most."""
    return F.least(F.lit(MOST_OCCURRENCES), F.floor((F.length(column) - F.length(F.replace(column, F.lit(word), F.lit("")))) / F.lit(len(word)))).cast("long")


def first_place(column: Column, word: str) -> Column:
    """From 0; -1 if it isn't there."""
    return (F.instr(column, word) - 1).cast("long")


def has_word(column: Column, word: str) -> Column:
    """In a normalized column, bounded by spaces."""
    return F.contains(F.concat(F.lit(" "), column, F.lit(" ")), F.lit(f" {word} "))


def whole_word(column: Column, word: str) -> Column:
    """Bounded by no letter or digit, as typed."""
    return column.rlike(rf"(?<![\p{{L}}\p{{Nd}}]){quoted(word)}(?![\p{{L}}\p{{Nd}}])")


def quoted(word: str) -> str:
    """A Java pattern of exactly these characters."""
    return re.sub(r"([^\w\s])", r"\\\1", word)


def clean(column: Column, most: int) -> Column:
    """White space as single spaces, trimmed, at most so many characters."""
    return F.substring(F.trim(F.regexp_replace(column, r"\s+", " ")), 1, most)


def strip_markup(column: Column) -> Column:
    """Text of an HTML page: scripts, styles, comments and tags go, the basic entities are read."""
    bare = F.regexp_replace(F.regexp_replace(column, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")), bare)


def compact_segment(column: Column) -> Column:
    """At most 240 characters: the first 165 and the last 72 around an ellipsis."""
    return F.when(F.length(column) <= 240, column).otherwise(F.concat(F.substring(column, 1, 165), F.lit(" … "), F.right(column, F.lit(72))))


def sample_parts(column: Column, most: int) -> Column:
    """At most so many characters: the first half, a quarter from the middle (not before the first's end), the rest from the end."""
    head, middle = most // 2, most // 4
    tail = most - head - middle
    start = F.greatest(F.lit(head), F.floor(F.length(column) / 2).cast("int") - middle // 2) + 1
    return F.when(F.length(column) <= most, column).otherwise(F.concat_ws("\n…\n", F.substring(column, 1, head), F.substring(column, start, F.lit(middle)), F.right(column, F.lit(tail))))


def sample_ends(column: Column, most: int) -> Column:
    """At most so many characters: the first two thirds and the rest from the end."""
    head = most * 2 // 3
    return F.when(F.length(column) <= most, column).otherwise(F.concat_ws("\n…\n", F.substring(column, 1, head), F.right(column, F.lit(most - head))))


def tag_terms(column: Column) -> Column:
    """A tag as one run of letters and digits, and its parts."""
    parts = F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    return F.array_distinct(F.filter(F.concat(F.array(F.array_join(parts, "")), parts), lambda x: x != ""))


def segments(column: Column, count: int = 5, width: int = 240) -> Column:
    """Up to count windows of width characters, evenly spaced, once each."""
    span = F.greatest(F.length(column) - width, F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring(column, F.bround(span * i / (count - 1), 0).cast("int") + 1, F.lit(width)))
    return F.array_distinct(windows)


#: The patterns of fixed.FLOOR for floors below ground, and for those above, as Java has them (lower case).
_UNDER = r"(?:지하[\s._-]*0*(\d{1,3})[\s._-]*층|(?<![a-z0-9])b[\s._-]*0*(\d{1,3})[\s._-]*(?:f|층)?(?![a-z0-9]))"
_GROUND = r"(?<![\p{L}\p{N}])0*(\d{1,3})[\s._-]*층"


def floor_references(column: Column) -> Column:
    """Distinct floors named, 1 to 999: 'B3', 'b3f' and '지하 3층' are -3, '2층' is 2."""
    lower = F.lower(narrow(column))
    number = lambda i: F.transform(F.regexp_extract_all(lower, F.lit(_UNDER), F.lit(i)), lambda x: F.when(x != "", -x.cast("int")))
    ground = F.transform(F.regexp_extract_all(F.regexp_replace(lower, _UNDER, " "), F.lit(_GROUND), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(F.concat(number(1), number(2), ground), lambda x: x.isNotNull() & (x != 0)))


def has_all_floors(column: Column, wanted: tuple[tuple[bool, int], ...]) -> Column:
    return F.size(F.array_except(F.array(*(F.lit(-n if under else n) for under, n in wanted)), floor_references(column))) == 0
