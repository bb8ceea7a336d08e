"""What kind of image a query wants: limits, prompts, names that may identify a subject, and tag words. Pure Python."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import fixed
from .intent import Intent, once, tokenize


@dataclass(frozen=True)
class Profile:
    """kind: General, Character, OfficeMaterial, Document or UserInterface. margin, lift: None where nothing is asked."""

    kind: str
    named: bool = False
    least: float = 0.055
    distance: float = 0.1
    margin: float | None = None
    lift: float | None = None

    @property
    def suppresses_interfaces(self) -> bool:
        return self.kind == "Character"


def _has(query: str, words: tuple[str, ...]) -> bool:
    return any(w.lower() in query for w in words)


def wants_images(intent: Intent) -> bool:
    """Image files by category or extension, or a word that images are described with."""
    query = intent.query.lower()
    return "Image" in intent.categories or any(fixed.CATEGORIES.get(e) == "Image" for e in intent.extensions) or _has(query, tuple(fixed.VISUAL_WORDS)) or _has(query, fixed.IMAGE_WORDS)


def _subjects(intent: Intent) -> list[str]:
    return [t.original for t in intent.terms if t.original not in fixed.GENERIC_WORDS and t.original not in fixed.CHARACTER_WORDS]


def is_named_subject(intent: Intent) -> bool:
    """Image files of one to four words that describe nothing one could draw."""
    query = intent.query.lower()
    image = "Image" in intent.categories or any(fixed.CATEGORIES.get(e) == "Image" for e in intent.extensions)
    apart = {*fixed.GENERIC_WORDS, *fixed.CHARACTER_WORDS, *fixed.INTERFACE_WORDS}
    concrete = any(w not in apart and w.lower() in query for w in fixed.VISUAL_WORDS) or any(t in fixed.CONCRETE_WORDS for t in tokenize(query))
    return image and not concrete and 1 <= len(_subjects(intent)) <= 4


def profile(intent: Intent) -> Profile:
    query, named = intent.query.lower(), is_named_subject(intent)
    if _has(query, fixed.INTERFACE_WORDS) or "ui" in tokenize(query):
        kind, named = "UserInterface", False
    elif _has(query, fixed.CHARACTER_WORDS) or named:
        kind = "Character"
    else:
        kind = "OfficeMaterial" if _has(query, fixed.OFFICE_WORDS) else "Document" if _has(query, fixed.DOCUMENT_WORDS) else "General"
    return Profile(kind, named, *fixed.VISUAL_LIMITS["NamedCharacter" if named else kind])


def _bare(query: str) -> str:
    return re.sub(r"\s+", " ", re.sub(fixed.QUERY_NOISE, " ", query.lower(), flags=re.I)).strip()


def _longest_first() -> list[tuple[str, str]]:
    return sorted(fixed.VISUAL_WORDS.items(), key=lambda x: -len(x[0]))


def _without_particles(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(fixed.PARTICLE, " ", text)).strip()


def readings(text: str) -> str:
    """How the Hangul that is left without the dictionary's words reads, plain and as a loanword."""
    from ..functions.phonetic import romanize

    if not re.search("[가-힣]", text):
        return ""
    for word, _ in _longest_first():
        text = re.sub(re.escape(word), " ", text, flags=re.I)
    plain = re.sub(r"\s+", " ", romanize(_without_particles(text), keep=True)).strip()
    loan = plain.replace("eu", "u").replace("eo", "o")
    return plain if loan == plain else f"{plain} / {loan}"


def subject(query: str, named: bool) -> str:
    """The query, its translation by the dictionary (longest words first), and a named subject's readings."""
    bare = translated = _bare(query)
    for word, meaning in _longest_first():
        translated = re.sub(re.escape(word), lambda _, m=meaning: f" {m} ", translated, flags=re.I)
    known = translated != bare
    translated = _without_particles(translated)
    parts = [bare, translated if known else "", readings(bare) if named else ""]
    return ", ".join(dict.fromkeys(x for x in parts if x)) or fixed.NO_SUBJECT


def prompts(query: str, wanted: Profile) -> list[str]:
    """What images are compared with, the first two always: the query and a description of its kind."""
    about, bare = subject(query, wanted.named), _bare(query)
    made = [about if wanted.named else bare, fixed.PROMPTS[wanted.kind].format(about), *(x.format(about) for x in fixed.MORE_PROMPTS.get(wanted.kind, ()))]
    return once(x for x in made if x.strip())


def identity_aliases(intent: Intent) -> list[str]:
    """Words that may name the subject in a file's name, path or tags."""
    wanted = list(dict.fromkeys(_subjects(intent)))
    if not wanted:
        return []
    return list(dict.fromkeys([*wanted, *(x for x in re.split(r"[ /]+", readings(" ".join(wanted))) if len(x) >= 2)]))


def tag_aliases(intent: Intent) -> list[str]:
    """Words that may be an image's tags."""
    own = [w for t in (*intent.terms, *intent.literal_terms) for w in (t.original, *t.names)]
    meanings = [m for w, m in fixed.VISUAL_WORDS.items() if w.lower() in intent.query.lower()]
    return list(dict.fromkeys(x for x in (*own, *meanings, *identity_aliases(intent)) if x.strip()))


def tag_terms(value: str) -> list[str]:
    """A tag or alias as one run of letters and digits, and its parts."""
    parts = re.findall(r"[^\W_]+", value.lower())
    return list(dict.fromkeys(x for x in ("".join(parts), *parts) if x))
