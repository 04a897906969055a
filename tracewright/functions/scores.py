"""Similarities, scores and small numeric rules as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions import paths as P
from tracewright.functions.text import Text, _c


@dataclass(frozen=True)
class FileWeights:
    path_keyword: float = 2.0
    api_impact: float = 2.0
    test_path: float = 1.0
    ci_path: float = 1.0
    size_log: float = 0.4
    status_added: float = 0.3
    status_deleted: float = 0.3
    noise_penalty: float = 1.5


@dataclass(frozen=True)
class CommitWeights:
    impact: float = 0.65
    intent: float = 0.35
    issue_link: float = 1.5
    starts_with_verb: float = 1.0
    cmg_quality: float = 1.0
    identifier_overlap: float = 0.8
    short_penalty: float = 0.7


def jaccard(a: Text, b: Text) -> Column:
    """0 if either is empty."""
    x, y = _c(a), _c(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_union(x, y)))), F.lit(0.0))


def cosine(a: Text, b: Text) -> Column:
    """M3: raw cosine of two vectors; 0 if either has no length."""
    x, y = _c(a), _c(b)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))), F.lit(0.0))


def semantic(a: Text, b: Text) -> Column:
    """M3: cosine moved to 0..1 and clamped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(a, b) + 1) / 2))


def file_score(path: Text, patch: Text, changes: Text, status: Text, w: FileWeights = FileWeights()) -> Column:  # noqa: B008
    """M11."""
    s = F.lower(F.coalesce(_c(status), F.lit("")))
    n = F.coalesce(F.expr(f"try_cast({changes} AS double)") if isinstance(changes, str) else changes.cast("double"), F.lit(0.0))
    on = lambda cond, weight: F.when(cond, weight).otherwise(0.0)
    return (
        w.size_log * F.log1p(F.greatest(F.lit(0.0), n))
        + on(P.has_keyword(path), w.path_keyword)
        + on(P.api_impact(patch), w.api_impact)
        + on(P.is_test(path), w.test_path)
        + on(P.is_ci(path), w.ci_path)
        + on(s.isin("added", "new"), w.status_added)
        + on(s.isin("removed", "deleted"), w.status_deleted)
        - on(P.is_noise(path), w.noise_penalty)
    )


def f1(overlap: Column, candidate: Column, reference: Column) -> Column:
    """F1 of precision overlap/candidate and recall overlap/reference; 0 without overlap."""
    return F.when(overlap > 0, 2.0 * overlap / (candidate + reference)).otherwise(0.0)


def judge_score(*penalties: Text) -> Column:
    """5 less the penalties' sizes, within 1 and 5, one decimal."""
    total = sum((F.abs(F.coalesce(_c(p), F.lit(0.0))) for p in penalties), F.lit(0.0))
    return F.round(F.greatest(F.lit(1.0), F.least(F.lit(5.0), 5.0 - total)), 1)


def preference(generated: Text, original: Text) -> Column:
    """Generated only if strictly greater."""
    return F.when(_c(generated) > _c(original), "generated").otherwise("original")


def primary_reason(correctness: Text, coverage: Text, clarity: Text) -> Column:
    """The greatest penalty in this order; null if none is above 0."""
    a, b, c = (F.coalesce(_c(x), F.lit(0.0)) for x in (correctness, coverage, clarity))
    top = F.greatest(a, b, c)
    return F.when(top <= 0, F.lit(None)).when(a == top, "correctness").when(b == top, "coverage").otherwise("clarity")


def safe_double(x: str, default: float = 0.0) -> Column:
    """M18."""
    return F.coalesce(F.expr(f"try_cast({x} AS double)"), F.lit(default))


def safe_ratio(a: Text, b: Text) -> Column:
    """0 for a zero denominator."""
    return F.coalesce(F.try_divide(_c(a), _c(b)), F.lit(0.0))
