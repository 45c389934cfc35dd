"""Split-conformal intervals: global, per group and locally weighted; isotonic jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contestlake.functions import probability as prob
from contestlake.operators import order

MIN_GROUP = 50


def _level(alpha: float):
    return F.ceil((F.col("n") + 1) * F.lit(1 - alpha)) / F.col("n")


def halfwidth(df: DataFrame, alpha: float = 0.10) -> DataFrame:
    """One row: the finite-sample quantile of the absolute residual."""
    rows = df.select(F.abs(F.col("label") - F.col("p")).alias("score"))
    return order.quantiles(rows, [], "score", _level(alpha)).selectExpr("n", "q AS halfwidth")


def halfwidth_by_group(df: DataFrame, group: str, alpha: float = 0.10, min_rows: int = MIN_GROUP) -> DataFrame:
    """The same per group; small groups take the global value."""
    rows = df.select(group, F.abs(F.col("label") - F.col("p")).alias("score"))
    own = order.quantiles(rows, [group], "score", _level(alpha))
    return own.withColumn("_whole", halfwidth(df, alpha).select("halfwidth").scalar()).selectExpr(
        group, "n", f"CASE WHEN n < {min_rows} THEN _whole ELSE q END AS halfwidth", f"int(n < {min_rows}) AS fallback")


def scaled(df: DataFrame, alpha: float = 0.10) -> DataFrame:
    """Quantile of the residual over the local Bernoulli deviation."""
    rows = df.select((F.abs(F.col("label") - F.col("p")) / prob.local_sd(F.col("p"))).alias("score"))
    return order.quantiles(rows, [], "score", _level(alpha)).selectExpr("n", "q AS scaled")


def intervals(df: DataFrame, group: str, local: DataFrame | None, groups: DataFrame | None, whole: DataFrame) -> DataFrame:
    """Clipped interval per row; local beats group beats global."""
    out = df.withColumn("_whole", whole.select("halfwidth").scalar())
    if groups is not None:
        out = out.join(groups.selectExpr(group, "halfwidth AS _group"), group, "left")
    else:
        out = out.withColumn("_group", F.lit(None).cast("double"))
    if local is not None:
        out = out.withColumn("_local", local.select("scaled").scalar())
    else:
        out = out.withColumn("_local", F.lit(None).cast("double"))
    half = F.coalesce(F.col("_local") * prob.local_sd(F.col("p")), F.col("_group"), F.col("_whole"))
    return out.withColumns({"lo": prob.clip(F.col("p") - half, 0, 1), "hi": prob.clip(F.col("p") + half, 0, 1)}).drop(
        "_whole", "_group", "_local")
