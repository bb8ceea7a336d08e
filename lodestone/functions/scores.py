"""Score column builders: preferences, evidence, percentages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import fixed
from ..plans.intent import Directive


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def age_days(micros: Column, now_micros: int) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(now_micros) - micros) / F.lit(86_400_000_000.0))


def recency(micros: Column, half_life_days: float, now_micros: int) -> Column:
    """Half after each half-life; a missing time is 0."""
    faded = F.pow(F.lit(0.5), age_days(micros, now_micros) / min(max(half_life_days, 1.0), 3650.0))
    return F.when(micros.isNull(), F.lit(0.0)).otherwise(faded)


def effective_created(created: Column, modified: Column, now_micros: int) -> Column:
    return F.when((created >= 0) & (created <= now_micros + 86_400_000_000), created).otherwise(modified)


def size_score(size: Column) -> Column:
    """From 1 KB (0) to 10 GB (1) by logarithm."""
    return F.when(size > 0, clamp((F.log10(size.cast("double")) - 3.0) / 7.0)).otherwise(F.lit(0.0))


def preference(directives: tuple[Directive, ...], signals: dict[str, Column], now_micros: int, primary_only: bool = False) -> Column:
    """The weighted mean of the wished features. signals: by feature, and created and modified in microseconds, size in bytes."""
    total, terms = 0.0, []
    for d in directives:
        if primary_only and not d.primary:
            continue
        weight = min(max(d.weight, 0.01), 1.0)
        if d.feature == "CreatedRecency":
            value = recency(effective_created(signals["created"], signals["modified"], now_micros), d.half_life_days, now_micros)
        elif d.feature == "ModifiedRecency":
            value = recency(signals["modified"], d.half_life_days, now_micros)
        elif d.feature == "FileSize":
            value = size_score(signals["size"])
        else:
            value = signals.get(d.feature, F.lit(0.0))
        value = clamp(value)
        terms.append((value if d.higher_first else 1.0 - value) * weight)
        total += weight
    return clamp(reduce(lambda a, b: a + b, terms) / total) if terms else F.lit(0.0)


def adjustment(directives: tuple[Directive, ...], signals: dict[str, Column], now_micros: int) -> Column:
    return preference(directives, signals, now_micros) * sum(min(max(d.weight, 0.01), 1.0) for d in directives) * 1000.0


def primary_evidence(kinds: Column, coverage: Column, visual_query: bool = False) -> Column:
    """The kind that decides a merged row's place, of the set of its kinds."""
    has = lambda k: F.array_contains(kinds, k)
    order = F.when(has("ExactName"), F.lit("ExactName"))
    if visual_query:
        order = order.when(has("VisualCandidate"), F.lit("VisualCandidate"))
    order = order.when(has("Combined") | (has("Content") & has("NameCandidate") & (coverage >= 0.99)), F.lit("Combined"))
    for kind in ("NameCandidate", "Content", "Path", "SemanticCandidate", "VisualCandidate"):
        order = order.when(has(kind), F.lit(kind))
    return order.otherwise(F.lit("Metadata"))


def _by(kind: Column, values: dict[str, int], other: int, visual: int | None) -> Column:
    out = reduce(lambda c, kv: c.when(kind == kv[0], F.lit(kv[1])), (values | ({"VisualCandidate": visual} if visual is not None else {})).items(), F)
    return out.otherwise(F.lit(other))


def guardrail(kind: Column, visual_query: bool = False) -> Column:
    return _by(kind, fixed.GUARDRAILS, 1, fixed.VISUAL_GUARDRAIL if visual_query else None)


def priority(kind: Column, count: Column, visual_query: bool = False) -> Column:
    return _by(kind, fixed.PRIORITIES, fixed.OTHER_PRIORITY, fixed.VISUAL_PRIORITY if visual_query else None) + count


def relative_confidence(similarity: Column, best: Column) -> Column:
    """1 for the best, 0 from 0.08 below it on; 0 where nothing is known."""
    known = clamp(1.0 - F.greatest(F.lit(0.0), best - similarity) / 0.08)
    return F.when(similarity.isNull() | best.isNull() | (best <= 5e-324), F.lit(0.0)).otherwise(known)


def semantic_signal(similarity: Column) -> Column:
    """A cosine of a text model as a ranking signal: 0.68 is nothing, 0.92 is all."""
    return F.when(similarity.isNull(), F.lit(0.0)).otherwise(clamp((similarity - 0.68) / 0.24))


def match_percent(kind: Column, evidence: Column, coverage: Column, name_matches: Column, total_terms: Column, semantic: Column, best_semantic: Column, visual: Column, best_visual: Column) -> Column:
    """What is shown, rounded half up. coverage, semantic and visual may be null; evidence: all kinds of the row."""
    clear = clamp(F.coalesce(coverage, F.lit(0.5)), 0.5, 1.0)
    share = F.when(total_terms <= 0, 0.5).otherwise(clamp(name_matches / F.greatest(total_terms, F.lit(1))))
    seen = clamp(35.0 + 55.0 * clamp((visual - 0.04) / 0.26) + 5.0 * relative_confidence(visual, best_visual), 35.0, 95.0)
    return (
        F.when(kind == "ExactName", F.when((total_terms > 0) & (name_matches >= total_terms), 99.0).otherwise(92.0))
        .when(kind == "Combined", F.round(92.0 + 7.0 * clear))
        .when(kind == "NameCandidate", F.round(62.0 + 24.0 * share))
        .when(kind == "Content", F.when(F.array_contains(evidence, "ExactName"), 99.0).otherwise(F.round(72.0 + 24.0 * clear)))
        .when(kind == "Path", F.lit(45.0))
        .when(kind == "SemanticCandidate", F.round(45.0 + 27.0 * relative_confidence(semantic, best_semantic)))
        .when(kind == "VisualCandidate", F.when(visual.isNull(), 35.0).otherwise(F.round(seen)))
        .otherwise(F.lit(70.0))
    )


def badge(kind: Column, percent: Column, advanced: Column) -> Column:
    """A result's short label."""
    number = F.round(percent).cast("int").cast("string")
    fill = lambda text: F.concat(*(F.lit(x) if i == 0 else F.concat(number, F.lit(x)) for i, x in enumerate(text.split("{}"))))
    out = F.when(advanced, fill(fixed.ADVANCED_BADGE))
    for name, text in fixed.BADGES.items():
        out = out.when(kind == name, fill(text))
    return out.otherwise(fill(fixed.OTHER_BADGE))


def relevance(kind: Column, percent: Column) -> Column:
    """A result's long label: its evidence, or how high its percentage is."""
    out = reduce(lambda c, kv: c.when(kind == kv[0], F.lit(kv[1])), fixed.RELEVANCE.items(), F)
    return reduce(lambda c, kv: c.when(percent >= kv[0], F.lit(kv[1])), fixed.RELEVANCE_STEPS[:-1], out).otherwise(F.lit(fixed.RELEVANCE_STEPS[-1][1]))


def display_reason(reasons: Column, wish: str = "") -> Column:
    """The three weightiest of a row's reasons, each once whatever its case, in their first order among equals."""
    first = F.filter(reasons, lambda x, i: x.isNotNull() & (F.array_position(F.transform(reasons, lambda y: F.lower(y)), F.lower(x)) == i + 1))

    def weight(x: Column) -> Column:
        return reduce(lambda c, kv: c.when(F.contains(F.lower(x), F.lit(kv[0])), kv[1]), fixed.REASON_PRIORITIES, F).otherwise(1)

    ranked = F.array_sort(F.transform(first, lambda x, i: F.struct((-weight(x)).alias("w"), i.alias("i"), x.alias("text"))))
    shown = F.array_join(F.transform(F.slice(ranked, 1, 3), lambda x: x["text"]), " ")
    return F.trim(F.concat_ws(" ", shown, F.lit(wish))) if wish else shown
