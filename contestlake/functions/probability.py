"""Scoring rules, calibration bins and interval arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def log_loss(label: Column, prob: Column, eps: float = 1e-7) -> Column:
    p = clip(prob, eps, 1 - eps)
    return -F.when(label == 1, F.log(p)).otherwise(F.log(1.0 - p))


def brier(label: Column, prob: Column) -> Column:
    return (prob - label) * (prob - label)


def logit(prob: Column, eps: float = 1e-6) -> Column:
    p = clip(prob, eps, 1 - eps)
    return F.log(p / (1.0 - p))


def pinball(actual: Column, quantile: Column, level: float) -> Column:
    err = actual - quantile
    return F.greatest(err * level, err * (level - 1.0))


def local_sd(prob: Column, eps: float = 1e-2) -> Column:
    return F.sqrt(F.greatest(prob * (1.0 - prob), F.lit(eps)))


def elo_expected(diff: Column) -> Column:
    return F.lit(1.0) / (1.0 + F.pow(F.lit(10.0), -diff / 400.0))


# fixed values: rating scale and yearly deviation growth
RATING_SCALE = 173.7177
DEVIATION_GROWTH = 34.6
DEVIATION_MAX = 350.0


def inflate_deviation(rd: Column, idle_days: Column) -> Column:
    """Rating deviation after idle time, in display units, capped at the maximum."""
    phi, c = rd / RATING_SCALE, DEVIATION_GROWTH / RATING_SCALE
    grown = F.sqrt(phi * phi + F.lit(c * c) * (idle_days / 365.0)) * RATING_SCALE
    return F.when(idle_days > 0, F.least(F.lit(DEVIATION_MAX), grown)).otherwise(rd)


def decay_weight(years: Column, half_life: float = 6.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(years, F.lit(0.0)) / half_life)


LOG2 = math.log(2.0)
