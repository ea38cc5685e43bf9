"""Scores and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def anomaly_score(decision: Column, ratio: Column, amount: Column, ready: Column) -> tuple[Column, Column]:
    """(score, is_anomaly) from a forest's decision value: clip(0.5 - decision, 0, 1). Amounts at or below the reference are never
    anomalies and score 0.05 at most; without a model or a positive amount the score is 0.05. Rounded to four places."""
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) - decision))
    low = ~ready | amount.isNull() | (amount <= 0)
    score = F.when(low, 0.05).when(ratio <= 0, F.least(raw, F.lit(0.05))).otherwise(raw)
    return F.round(score, 4), ~low & (ratio > 0) & (decision < 0)


def lower_is_fake(a: Column, b: Column, gap: float = 10.0) -> Column:
    """a or b, whichever scores lower by more than a gap; null if neither does."""
    return F.when(a < b - gap, "a").when(b < a - gap, "b")


def fused(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of scores, weights brought to a sum of one; weights that add up to nothing are an error."""
    total = sum(w for _, w in parts)
    if total <= 0:
        raise ValueError("weights add up to nothing")
    out = F.lit(0.0)
    for c, w in parts:
        out = out + c * F.lit(w / total)
    return out


def clamped(n: Column, size: Column, default: int = 5) -> Column:
    """A wanted number within 1 and size; the default, within size too, where it is null."""
    return F.least(size, F.greatest(F.lit(1), F.coalesce(n, F.lit(default)))).cast("int")
