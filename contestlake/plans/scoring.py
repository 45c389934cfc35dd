"""Scoring of scheduled contests: intervals, classes from rates, bets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contestlake.operators import calibrate, pricing, reconcile


def predictions(scored: DataFrame, group: str, local: DataFrame | None, groups: DataFrame | None, whole: DataFrame) -> DataFrame:
    """Intervals and class probabilities on scored rows (p and per-side knockout and submission rates)."""
    with_interval = calibrate.intervals(scored, group, local, groups, whole)
    return reconcile.from_rates(with_interval)


def bets(pred: DataFrame, quotes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Distinct, gated bets on the quoted selections of predicted contests."""
    return pricing.dedup(pricing.gate(pricing.value(pricing.price(quotes, pred)), buckets))


def confidence(pred: DataFrame) -> DataFrame:
    return pred.withColumn("tier", F.when(F.col("spread") < 0.07, "High").when(F.col("spread") < 0.12, "Medium").otherwise("Low"))
