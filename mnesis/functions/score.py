"""How reachable a memory is: the forgetting curve, rehearsal and importance, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Similarity that stands in where there is no query (eviction).
NOMINAL_SIMILARITY = 0.3


def recency(created_at: Column, as_of: Column, half_life_hours: float = 168.0) -> Column:
    """exp(-age / scale) for an age in ms, not below 0; the scale is the time to fall to 1/e."""
    age = F.greatest(F.lit(0.0), (as_of - created_at).cast("double"))
    return F.exp(-age / F.lit(half_life_hours * 3_600_000.0))


def strength(access_count: Column) -> Column:
    """1 - exp(-count / 3)."""
    return F.lit(1.0) - F.exp(-access_count / F.lit(3.0))


def accessibility(similarity: Column, created_at: Column, importance: Column, access_count: Column, as_of: Column, half_life_hours: float = 168.0) -> Column:
    """(0.55 similarity + 0.25 recency + 0.2 importance) * (0.5 + 0.5 strength)."""
    base = F.lit(0.55) * similarity + F.lit(0.25) * recency(created_at, as_of, half_life_hours) + F.lit(0.2) * importance
    return base * (F.lit(0.5) + F.lit(0.5) * strength(access_count))
