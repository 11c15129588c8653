"""Story features and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: default weights
NEWS = {"coverage": 0.15, "authority": 0.075, "freshness": 0.10, "velocity": 0.075, "topic_fit": 0.60}
CURATED = {"topic_fit": 0.55, "engagement": 0.15, "authority": 0.10, "freshness": 0.10, "depth": 0.10}
# fixed values: counts at which engagement is full
FULL = {"views": 1e6, "likes": 5e4, "score": 1e4, "comments": 2e3}


def coverage(sources: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.greatest(sources.cast("double"), F.lit(0.0))) / F.log1p(F.lit(8.0)))


def freshness(age_hours: Column, half_life: Column) -> Column:
    return F.pow(F.lit(0.5), age_hours / F.greatest(half_life.cast("double"), F.lit(0.1)))


def velocity(recent: Column) -> Column:
    return F.least(F.lit(1.0), recent / 5.0)


def depth(chars: Column) -> Column:
    return F.least(F.lit(1.0), chars / 4000.0)


def engagement(counts: dict[str, Column]) -> Column:
    """The best logarithmic share of the full counts; null where none is measured."""
    shares = [F.when(c >= 0, F.least(F.lit(1.0), F.log1p(c.cast("double")) / F.log1p(F.lit(FULL[k])))) for k, c in counts.items()]
    return F.greatest(*shares, F.lit(None).cast("double"))


def authority(own: Column, performance: Column) -> Column:
    return F.least(F.lit(1.0), own * F.coalesce(performance, F.lit(1.0)))


def parts(weights: dict[str, float], own: dict[str, float] | None = None, neutral: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """The weighted sum of columns, and its breakdown by name; own weights replace known ones and others are ignored; they need not sum to one."""
    used = {k: float((own or {}).get(k, w)) for k, w in weights.items()}
    each = {k: F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in used.items()}
    rows = [
        F.struct(F.lit(k), F.struct(F.round(F.coalesce(F.col(k), F.lit(0.0)), 4).alias("value"), F.lit(w).alias("weight"), F.round(each[k], 4).alias("contribution"), (neutral or {}).get(k, F.lit(False)).alias("neutral")))
        for k, w in used.items()
    ]
    return F.round(sum(each.values()), 4), F.map_from_entries(F.array(*rows))


def weighted(df: DataFrame, weights: dict[str, float], own: dict[str, float] | None = None, neutral: dict[str, Column] | None = None) -> DataFrame:
    """Adds score and breakdown."""
    score, breakdown = parts(weights, own, neutral)
    return df.withColumns({"score": score, "breakdown": breakdown})


def suggested(hits: Column, rating: Column) -> Column:
    repeat = F.least(F.lit(1.0), hits / 3)
    return F.round(F.when(rating.isNull(), repeat).otherwise(0.4 * repeat + 0.6 * rating / 10), 4)


def renormalized(weights: dict[str, float]) -> dict[str, float]:
    """Weights of known names, made to sum to one; the defaults if they sum to nothing."""
    known = {k: float(weights.get(k, 0.0)) for k in NEWS}
    total = sum(known.values())
    return {k: w / total for k, w in known.items()} if total > 0 else dict(NEWS)


def passes_topic(value: Column, neutral: Column, threshold: float) -> Column:
    return F.lit(threshold <= 0) | neutral | (F.coalesce(value, F.lit(0.5)) >= threshold)
