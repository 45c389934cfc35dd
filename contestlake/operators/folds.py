"""Time-ordered folds, splits and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contestlake.functions import probability as prob
from contestlake.operators import order


def fold_rows(rows: DataFrame, years: list[int]) -> DataFrame:
    """Rows tagged per expanding fold: part is train, calib (last year before) or val."""
    tags = F.array(*[F.struct(F.lit(y).alias("fold"), F.when(F.col("yr") < y - 1, "train").when(F.col("yr") == y - 1, "calib")
                              .when(F.col("yr") == y, "val").alias("part")) for y in years])
    return rows.select("*", F.inline(tags)).filter("part IS NOT NULL")


def fold_sizes(rows: DataFrame, first: int) -> DataFrame:
    """Sizes of the expanding yearly folds, from year totals only."""
    years = rows.groupBy("yr").agg(F.count("*").alias("n"))
    w = "OVER (PARTITION BY 1 ORDER BY yr RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)"
    sizes = years.selectExpr("yr AS fold", f"coalesce(sum(n) {w}, 0) AS n_train", "n AS n_val",
                             "coalesce(sum(n) OVER (PARTITION BY 1 ORDER BY yr RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS n_calib")
    return sizes.filter(F.col("fold") >= first)


def chronological(rows: DataFrame, cuts: dict[str, float], last: str) -> DataFrame:
    """Parts of the order (dt, contest_id) by cumulative share; ranks come from range bins."""
    placed = order.position(rows, "contest_id")
    part = F.lit(last)
    for name, share in reversed(list(cuts.items())):
        part = F.when(F.col("pos") < F.floor(F.col("total") * share), name).otherwise(part)
    return placed.withColumn("part", part).drop("pos", "total")


def decay_weights(rows: DataFrame, half_life: float = 6.0) -> DataFrame:
    """Weight halves every ``half_life`` years back from the newest row."""
    years = F.date_diff(rows.select(F.max("dt")).scalar(), F.col("dt")) / 365.25
    return rows.withColumn("weight", prob.decay_weight(years, half_life))
