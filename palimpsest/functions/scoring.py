"""Scores and boosts of retrieval as column expressions."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters of ranking (fixed values).
RRF_K, AUTHORITY_WEIGHT = 60, 0.5
STRONG_RANK, STRONG_AUTHORITY, STRONG_RERANK, STRONG_SUPPORTS = 0.05, 0.3, 0.6, 2
LOWEST_BOOST, HIGHEST_BOOST = 0.7, 1.3
HALF_LIFE_DAYS, LOOK_AHEAD_DAYS = 30, 7
SUPPORT_CAP, ACTOR_CAP = 4, 8
KIND_WEIGHT = {"human": 1.0, "agent": 0.6, "system": 0.4, "adapter": 0.3}
SOURCE_WEIGHT = {"channel": 1.0, "thread": 0.8, "call": 0.7, "native": 0.4, "record": 0.3}
MERGE_SCORE, MERGE_RECENCY, NEUTRAL_RECENCY = 0.85, 0.15, 0.5


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def _weight(c: Column, weights: dict[str, float]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), c), F.lit(0.0))


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a fraction, by milliseconds."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return (ms(later) - ms(earlier)) / 86_400_000.0


def rrf(rank: Column, k: int = RRF_K) -> Column:
    """Share of one channel in the fused score."""
    return F.lit(1.0) / (F.lit(k) + rank)


def authority(created_by_kind: Column, actor_count: Column, source_class: Column, social: Column) -> Column:
    """How much the origin of a version counts, in [0, 1]."""
    actors = F.least(F.log(F.greatest(F.lit(1), F.coalesce(actor_count, F.lit(1))).cast("double")) / log(ACTOR_CAP), F.lit(1.0))
    return clamp(0.3 * _weight(created_by_kind, KIND_WEIGHT) + 0.3 * actors + 0.3 * _weight(source_class, SOURCE_WEIGHT) + 0.1 * F.coalesce(social, F.lit(False)).cast("int"), 0.0, 1.0)


def authority_weighted(score: Column, auth: Column, weight: float = AUTHORITY_WEIGHT) -> Column:
    return score * (1 + weight * auth)


def corroboration_factor(supports: Column, contradicts: Column) -> Column:
    """1 without any; else between the lowest and highest boost, more with supports, less with contradictions."""
    part = lambda c: 0.5 * F.least(F.lit(1.0), F.log1p(c.cast("double")) / log(1 + SUPPORT_CAP))
    unit = clamp(0.5 + part(supports) - part(contradicts), 0.0, 1.0)
    return F.when((supports == 0) & (contradicts == 0), 1.0).otherwise(boost(unit))


def boost(unit: Column) -> Column:
    """A value in [0, 1] as a multiplier."""
    return clamp(LOWEST_BOOST + (HIGHEST_BOOST - LOWEST_BOOST) * unit, LOWEST_BOOST, HIGHEST_BOOST)


def effective_authority(auth: Column, supports: Column, contradicts: Column) -> Column:
    return clamp(auth * corroboration_factor(supports, contradicts), 0.0, 1.0)


def strong_gate(auth: Column, supports: Column, provenance: Column, created_by_kind: Column) -> Column:
    """Whether a version may be strong evidence: authority, and stated by a human or supported often enough."""
    stated = (F.coalesce(provenance, F.lit("")) == "stated") & (F.coalesce(created_by_kind, F.lit("")) == "human")
    return (F.round(auth, 7) >= STRONG_AUTHORITY) & (stated | (F.coalesce(supports, F.lit(0)) >= STRONG_SUPPORTS))


def recency_boost(occurred_at: Column, now: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    return boost(F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), days_between(now, occurred_at)) / half_life_days))


def temporal_boost(temporal_class: Column, occurred_at: Column, valid_until: Column, now: Column) -> Column:
    """Events fade, states and lessons don't, deadlines gain as they come near and fall when they have passed."""
    left = days_between(valid_until, now)
    deadline = F.when(valid_until.isNull(), 1.0).when(left <= 0, LOWEST_BOOST).when(left >= LOOK_AHEAD_DAYS, 1.0).otherwise(clamp(1 + 0.3 * (1 - left / LOOK_AHEAD_DAYS), LOWEST_BOOST, HIGHEST_BOOST))
    return F.when(temporal_class.isin("state", "lesson"), 1.0).when(temporal_class == "deadline", deadline).otherwise(recency_boost(occurred_at, now))


def recency_prior(updated_at: Column, now: Column) -> Column:
    """Prior of a merged item by its age; neutral without a readable time."""
    age = F.when(updated_at.isNotNull(), F.greatest(F.lit(0.0), days_between(now, updated_at)))  # greatest skips nulls
    return F.coalesce(F.exp(-log(2) * age / HALF_LIFE_DAYS), F.lit(NEUTRAL_RECENCY))


def merged_score(norm: Column, recency: Column) -> Column:
    return MERGE_SCORE * norm + MERGE_RECENCY * recency


def overfetch(k: int, multiplier: int = 5) -> int:
    """Candidates per channel for k results."""
    return min(k * max(3, min(10, multiplier)), 500)


def clamp_k(k: int | float | None) -> int:
    """Results asked for, in bounds; 8 if not said."""
    return max(1, min(100, int(k if k is not None else 8)))


def ef_search(limit: int) -> int:
    """Search breadth a graph index would use; kept for callers that report it (dense search here is exact)."""
    return max(40, min(1000, int(limit)))


def batch_within_bound(queries: list[str]) -> bool:
    return 1 <= len(queries) <= 5
