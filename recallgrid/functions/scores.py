"""Scores and decays as Columns; all in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (ceiling's decay scale in days, shape, floor) of each tier of confidence.
WEIBULL = {"core": (180.0, 0.8, 0.4), "hot": (60.0, 1.0, 0.3), "warm": (30.0, 1.2, 0.2), "cold": (14.0, 1.5, 0.1)}

# Weights of recency, meaning, trust and feedback by intent.
INTENT_WEIGHTS = {
    "entity_lookup": (0.05, 0.5, 0.2, 0.15),
    "conceptual": (0.05, 0.5, 0.1, 0.2),
    "factual": (0.15, 0.3, 0.5, 0.1),
    "exploratory": (0.35, 0.1, 0.2, 0.15),
    "cross_domain": (0.1, 0.4, 0.2, 0.15),
}

#: Weights where no intent is known.
DEFAULT_WEIGHTS = (0.15, 0.3, 0.2, 0.15)

#: The scoring stages in their order; the last three drop rows or depend on the others' scores.
STAGES = ("recency", "importance", "trust_boost", "feedback_boost", "length_norm", "time_decay", "ppr_boost", "semantic_boost", "min_score", "noise_filter", "pairwise_dedup")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, zero, or of different lengths."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def weibull(age: Column, kind: str, scale: Column | None = None) -> Column:
    """floor + (1 - floor) * exp(-(age / scale) ** shape); 1 at or before age 0."""
    base, shape, floor = WEIBULL[kind]
    scale = F.lit(base) if scale is None else scale
    return F.when(age <= 0, 1.0).otherwise(floor + (1 - floor) * F.exp(-F.pow(age / scale, F.lit(shape))))


def reinforced(base: float, count: Column, since: Column) -> Column:
    """A half-life lengthened by accesses that fade over 30 days, ten times the base at most."""
    return F.least(base * (1 + F.log1p(count * F.pow(F.lit(2.0), -since / 30))), F.lit(10 * base))


def recency(age: Column, weight: float = 0.15, scale: float = 14.0) -> Column:
    return 1 + weight * F.exp(-age / scale)


def importance(confidence: Column) -> Column:
    c = F.when(F.coalesce(confidence, F.lit(0.0)) == 0, 0.5).otherwise(confidence)
    return 0.7 + 0.3 * c


def trust_boost(trust: Column, weight: float) -> Column:
    return 1 - weight * (1 - trust)


def feedback_boost(net: Column, weight: float) -> Column:
    return 1 + weight * F.tanh(net / 3)


def length_norm(n_chars: Column) -> Column:
    return 1 / (1 + 0.3 * F.abs(F.log2(F.greatest(n_chars, F.lit(1)) / 500)))


def time_decay(age: Column, confidence: Column, accesses: Column) -> Column:
    """Weibull decay with the scale of the confidence tier, reinforced where a block has been used."""

    def of(kind: str) -> Column:
        return F.when(accesses > 0, weibull(age, kind, reinforced(WEIBULL[kind][0], accesses, age))).otherwise(weibull(age, kind))

    c = F.coalesce(confidence, F.lit(0.5))
    return F.when(c >= 0.8, of("core")).when(c >= 0.5, of("hot")).when(c >= 0.3, of("warm")).otherwise(of("cold"))


def ppr_boost(ppr: Column) -> Column:
    return 1 + 0.3 * ppr


def semantic_boost(likeness: Column, weight: float) -> Column:
    return 1 + weight * F.greatest(F.lit(0.0), likeness)


def bm25(tf: Column, length: Column, mean_length: float | Column, idf: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length)) * idf


def frontier(centrality: Column, degree: Column, days: Column, in_gap: Column) -> Column:
    """What is central, linked and lately touched, more so if a known gap; a missing date counts as 30 days."""
    d = F.coalesce(days, F.lit(30.0))
    return centrality * F.log(degree + 1) * F.exp(-d / 30) * F.when(in_gap, 1.5).otherwise(1.0)
