"""A language model's plan of a query, read safely: it may explain the search, never widen it. Pure Python."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from .intent import Intent, once, references_previous, sort_mode

#: Lengths and numbers that a plan's parts are cut to; confidence below which a plan isn't followed.
TERM_LENGTH, EXTENSION_LENGTH, SUMMARY_LENGTH = 80, 40, 200
MOST_TERMS, MOST_ALTERNATIVES, MOST_EXTENSIONS = 10, 16, 16
LEAST_CONFIDENCE = 0.4
SORTS = {"created_newest": "CreatedNewest", "created_oldest": "CreatedOldest", "modified_newest": "ModifiedNewest", "modified_oldest": "ModifiedOldest", "name_match": "NameMatch", "path_match": "PathMatch", "large_first": "LargeFirst", "small_first": "SmallFirst"}
ONLY_SURE = "확실하게 확인된 검색 조건만 적용"


@dataclass(frozen=True)
class Plan:
    query: str
    terms: tuple[tuple[str, tuple[str, ...]], ...] = ()
    extensions: tuple[str, ...] = ()
    target: str = "Any"  # File, Folder
    sort: str = "Relevance"
    use_previous: bool = False
    confidence: float = 1.0
    summary: str = ""
    by_model: bool = False


def sanitize(text: str, most: int) -> str:
    """One line without runs of spaces, at most so many characters."""
    return re.sub(" {2,}", " ", re.sub(r"[\r\n\t]", " ", text).strip())[:most]


def from_intent(intent: Intent, previous: int = 0) -> Plan:
    """The plan that the words themselves say. previous: how many results the last search had."""
    target = "Folder" if intent.folders_only else "File" if intent.files_only else "Any"
    return Plan(intent.query, tuple((t.original, t.names) for t in intent.terms), tuple(sorted(intent.extensions)), target, sort_mode(intent), previous > 0 and references_previous(intent.query), 1.0, intent.query)


def _texts(values: object, length: int, most: int) -> tuple[str, ...]:
    kept = [sanitize(x, length) for x in values if isinstance(x, str) and x.strip()] if isinstance(values, list) else []
    return tuple(once(x for x in kept if x)[:most])


def parse(content: str, query: str, fallback: Plan, previous: int = 0) -> Plan:
    """A model's JSON as a plan: what is missing, of another type or unknown gives way to the fallback.

    Raises ValueError where the content isn't JSON; null gives the fallback.
    """
    raw = json.loads(content)
    if raw is None:
        return fallback
    if not isinstance(raw, dict):
        raise ValueError("a plan must be an object")
    given = raw.get("confidence")
    confidence = min(max(float(given), 0.0), 1.0) if isinstance(given, int | float) and not isinstance(given, bool) else 0.5
    if confidence < LEAST_CONFIDENCE:
        return replace(fallback, confidence=confidence, summary=ONLY_SURE, by_model=True)
    groups: dict[str, tuple[str, tuple[str, ...]]] = {}
    for g in raw.get("termGroups") or []:
        term = sanitize(g["term"], TERM_LENGTH) if isinstance(g, dict) and isinstance(g.get("term"), str) else ""
        if term:
            groups.setdefault(term.lower(), (term, _texts(g.get("alternatives"), TERM_LENGTH, MOST_ALTERNATIVES)))
    word = lambda k: str(raw.get(k) or "").strip().lower()
    target = {"file": "File", "folder": "Folder"}.get(word("target"), fallback.target)
    sort = SORTS.get(word("sort"), fallback.sort)
    summary = raw["interpretation"] if isinstance(raw.get("interpretation"), str) else fallback.summary
    return Plan(query.strip(), tuple(groups.values())[:MOST_TERMS] or fallback.terms, _texts(raw.get("requestedExtensions"), EXTENSION_LENGTH, MOST_EXTENSIONS), target, sort, previous > 0 and raw.get("usePreviousResults") is True or fallback.use_previous, confidence, sanitize(summary, SUMMARY_LENGTH), True)


def compile_plan(intent: Intent, plan: Plan, has_model: bool) -> Plan:
    """What runs: the words' own plan. A model's part is its confidence, and that it was asked; results of the last search
    are used only if both say so."""
    own = from_intent(intent)
    return replace(own, use_previous=own.use_previous and plan.use_previous, confidence=min(max(plan.confidence, 0.0), 1.0), by_model=has_model and plan.by_model)


def interpret(intent: Intent, model: Callable[[str], str] | None = None, previous: int = 0) -> Plan:
    """Ask a model for a plan, if there is one; where it fails, the words' own plan stands."""
    own = from_intent(intent, previous)
    if model is None:
        return own
    try:
        plan = parse(model(intent.query), intent.query, own, previous)
    except (ValueError, OSError):
        return own
    return compile_plan(intent, plan, True)
