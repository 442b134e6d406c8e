"""Similarities, normalisations and scalar scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def dot(a: Column, b: Column) -> Column:
    """The inner product in doubles; 0 for nulls or different lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(0.0)


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """M01; with ``eps`` M03, which also clamps to 0..1."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    if eps:
        return clamp(dot(a, b) / (norms + eps))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def clamp(x: Column) -> Column:
    """to 0..1, null is 0."""
    return F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def jaccard(a: Column, b: Column, eps: float = 0.0) -> Column:
    """M05; with ``eps`` M06."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return both / (all_ + eps) if eps else both / F.greatest(all_, F.lit(1))


def overlap(a: Column, b: Column) -> Column:
    """The overlap coefficient."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(1))


def minmax(x: Column, by: WindowSpec, flat: float, eps: float = 0.0, least: float = 1e-8) -> Column:
    """The four rules in one: M15 (flat .5, eps), M16 (0, none), M17 and M18 (0, eps), G27 (.5, none), M11."""
    lo, hi = F.min(x).over(by), F.max(x).over(by)
    return F.when(hi - lo <= least, flat).otherwise((x - lo) / (hi - lo + eps))


def sigmoid(x: Column) -> Column:
    """M12."""
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))


def smooth(x: Column) -> Column:
    """M13."""
    return F.greatest(x, F.lit(0.0)) / (1 + F.greatest(x, F.lit(0.0)))


def standardise(x: Column, by: WindowSpec) -> Column:
    """The population z-score through the sigmoid, 0.5 where all are equal."""
    sd = F.stddev_pop(x).over(by)
    return F.when(sd <= 1e-9, 0.5).otherwise(sigmoid((x - F.avg(x).over(by)) / sd))


def rank_by(score: Column, *ties: Column, by: list[str]) -> Column:
    """unique ranks, best first; equal scores (to 9 places) by the tie columns."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), *ties))


def rrf(ranks: list[Column], k: int = 60) -> Column:
    """reciprocal rank fusion as a share of the best possible; null ranks are skipped, none gives 0."""
    n = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in ranks), F.lit(0))
    total = sum((F.coalesce(1 / (k + r), F.lit(0.0)) for r in ranks), F.lit(0.0))
    return F.when(n > 0, total / (n / (k + 1))).otherwise(0.0)


def safe_delta(a: Column, b: Column) -> Column:
    """M29."""
    return a - b


def percent_delta(now: Column, base: Column) -> Column:
    """Null-safe change in percent."""
    return F.when(base != 0, (now - base) / F.abs(base) * 100)


def score_display(x: Column, stretched: bool = False) -> Column:
    """Percent with one decimal, optionally on the display scale."""
    return F.round((0.20 + 0.74 * clamp(x) if stretched else clamp(x)) * 100, 1)


def containment_terms(p: Column, r: Column) -> Column:
    """The terms of p that equal, hold or lie in a term of r."""
    return F.filter(p, lambda a: F.exists(r, lambda b: (a == b) | (F.instr(b, a) > 0) | (F.instr(a, b) > 0)))


def term_overlap(p: Column, r: Column, floor: int = 3, most: int = 10, cap: float = 1.0) -> Column:
    """A17; G24 and G25 with their own divisors and caps."""
    n = F.size(p)
    return F.least(F.lit(cap), F.size(containment_terms(p, r)) / F.greatest(F.lit(floor), F.least(n, F.lit(most))))


def soft_similarity(a: Column, b: Column) -> Column:
    """A18 for two token arrays: 1 if equal, .85 if one holds the other, else the larger of Jaccard and .75 containment."""
    both = F.size(F.array_intersect(a, b))
    inside = both / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))
    return F.when(F.array_sort(a) == F.array_sort(b), 1.0).when((inside == 1) & (both > 0), 0.85).otherwise(F.greatest(jaccard(a, b), 0.75 * inside))


def relevance(sim: Column, authority: Column, graph: Column) -> Column:
    """A24."""
    return F.when(sim < 0.4, 0.75 * sim).otherwise(0.6 * sim + 0.2 * authority + 0.2 * graph)


def relevance_label(x: Column) -> Column:
    """Bands at .40 and .65."""
    return F.when(x < 0.40, "low").when(x < 0.65, "medium").otherwise("high")


def graph_effective(graph: Column, sim: Column, confidence: Column, full: bool = True) -> Column:
    """F09."""
    return (F.least(graph, sim + 0.25) if full else graph) * confidence


def policy(score: Column, sim: Column, h: Column, role: Column, floor: float = 0.40) -> Column:
    """the penalties and bonuses, in their order."""
    x = F.when(sim < floor, score * 0.75).otherwise(score)
    x = F.when(h <= 2, x * 0.68).otherwise(x)
    x = F.when(role == "fresher", F.greatest(x, 0.58 * sim)).otherwise(x)
    return clamp(F.when(role == "expert", x + 0.05).otherwise(x))


def available(score: Column, load: Column, capacity: Column) -> Column:
    """the score times the free share of the capacity."""
    return score * F.greatest(F.lit(0.0), 1 - load / capacity)
