"""Scoring arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_round(value: Column, digits: int) -> Column:
    """Round half away from zero on a decimal, so that every engine agrees."""
    return F.round(value.cast("decimal(38,6)"), digits).cast("double")


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def guarded_ratio(num: Column, den: Column, eps: float) -> Column:
    """num / max(den, eps)."""
    return num / F.greatest(den, F.lit(eps))


def weighted_score(parts: dict[Column, float] | list[tuple[Column, float]]) -> Column:
    """Weighted sum, missing parts count as 0, clamped to 0..100, one decimal."""
    items = parts.items() if isinstance(parts, dict) else parts
    total = F.lit(0.0)
    for value, weight in items:
        total = total + F.coalesce(value, F.lit(0.0)) * F.lit(weight)
    return fixed_round(clamp(total), 1)


def quality_points(blur: Column, glare: Column, contrast: Column, brightness: Column) -> Column:
    """Capture quality 0..100: sharpness 35, glare 25, contrast 20, exposure 20 points."""
    sharp = F.least(blur / 300.0, F.lit(1.0)) * 35.0
    clear = F.greatest(F.lit(0.0), F.lit(1.0) - glare / 0.25) * 25.0
    range_ = F.least(contrast / 60.0, F.lit(1.0)) * 20.0
    light = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(brightness - 128.0) / 128.0) * 20.0
    return fixed_round(sharp + clear + range_ + light, 1)


def noise_anomaly(max_var: Column, median_var: Column, std_var: Column) -> Column:
    ratio = guarded_ratio(max_var, median_var, 0.01)
    return fixed_round(clamp((ratio - 1.5) * 20.0 + std_var * 3.0), 1)


def edge_anomaly(boundary: Column, overall: Column) -> Column:
    return fixed_round(clamp((guarded_ratio(boundary, overall, 0.1) - 1.8) * 35.0), 1)


def compression_anomaly(std_diff: Column, regions: Column, max_diff: Column, mean_diff: Column) -> Column:
    return fixed_round(clamp(std_diff * 4.0 + regions * 12.0 + guarded_ratio(max_diff, mean_diff, 0.1) * 2.0), 1)


def clone_anomaly(coherent: Column, pairs: Column) -> Column:
    return fixed_round(clamp(coherent * 16.0 + F.least(pairs * 1.5, F.lit(30.0))), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Clipped cosine, four decimals; 0 when a side is missing or has no length."""
    na, nb = l2_norm(a), l2_norm(b)
    value = F.when((na < 1e-6) | (nb < 1e-6), F.lit(0.0)).otherwise(clamp(dot(a, b) / (na * nb), -1.0, 1.0))
    return F.coalesce(fixed_round(value, 4), F.lit(0.0))
