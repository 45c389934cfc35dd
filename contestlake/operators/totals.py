"""Totals markets: monotone quantiles, chance of going over a line, graded edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contestlake.functions import odds, probability as prob

# fixed values: modelled quantile levels
LEVELS = {"q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90}
_Q = list(LEVELS)


def monotone(rows: DataFrame) -> DataFrame:
    """Running maximum across the five quantiles, and their mean as the estimate."""
    fixed = {_Q[0]: F.col(_Q[0])}
    for i, q in enumerate(_Q[1:], start=2):
        fixed[q] = F.greatest(*[F.col(c) for c in _Q[:i]])
    out = rows.withColumns(fixed)
    return out.withColumn("estimate", (F.col("q10") + F.col("q25") + F.col("q50") + F.col("q75") + F.col("q90")) / 5)


def over_probability(line: Column, q: list[Column] | None = None) -> Column:
    """1 - F(line): linear between quantiles, extended beyond the outer two, clipped."""
    v = q or [F.col(c) for c in _Q]
    lv = list(LEVELS.values())

    def between(i):
        gap = v[i + 1] - v[i]
        return F.when(gap < 1e-9, F.lit(lv[i + 1])).otherwise(lv[i] + (line - v[i]) / gap * (lv[i + 1] - lv[i]))

    def slope(a, b):
        return F.greatest(F.when(b > a, b - a).otherwise(F.lit(1.0)), F.lit(1e-6))

    below = F.greatest(F.lit(0.0), lv[0] - (v[0] - line) / slope(v[0], v[1]) * (lv[1] - lv[0]))
    above = F.least(F.lit(1.0), lv[4] + (line - v[4]) / slope(v[3], v[4]) * (lv[4] - lv[3]))
    cdf = F.when(line <= v[0], below).when(line >= v[4], above)
    for i in (3, 2, 1):
        cdf = cdf.when(line >= v[i], between(i))
    return prob.clip(1.0 - cdf.otherwise(between(0)), 0.005, 0.995)


def pair_quotes(quotes: DataFrame) -> DataFrame:
    """Over and under prices of a (contest, market, line); complete pairs beat single ones.

    When any line of a market has both prices, lines with only one are dropped.
    """
    paired = quotes.groupBy("contest_id", "market", "line").agg(
        F.max(F.when(F.col("direction") == "over", F.col("price"))).alias("over_price"),
        F.max(F.when(F.col("direction") == "under", F.col("price"))).alias("under_price"))
    full = (F.col("over_price").isNotNull() & F.col("under_price").isNotNull()).cast("int")
    any_full = paired.groupBy("contest_id", "market").agg(F.max(full).alias("_any"))
    return paired.join(any_full, ["contest_id", "market"]).filter((F.col("_any") == 0) | (full == 1)).drop("_any")


def backtest(pairs: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Both directions of a paired line with model probability, vig-free price, outcome and P&L.

    Equality with the line pays the over.
    """
    rows = pairs.join(quantiles, ["contest_id", "market"]).withColumn("_p", over_probability(F.col("line")))
    io, iu = odds.decimal_to_implied(F.col("over_price")), odds.decimal_to_implied(F.col("under_price"))
    both = F.col("over_price").isNotNull() & F.col("under_price").isNotNull()
    legs = rows.select("contest_id", "market", "line", F.inline(F.array(
        F.struct(F.lit("over").alias("direction"), F.col("over_price").alias("price"), F.col("_p").alias("our_prob"),
                 F.when(both, odds.fair_share(io, iu)).otherwise(io).alias("fair"), (F.col("actual") >= F.col("line")).cast("int").alias("won")),
        F.struct(F.lit("under").alias("direction"), F.col("under_price").alias("price"), (1.0 - F.col("_p")).alias("our_prob"),
                 F.when(both, odds.fair_share(iu, io)).otherwise(iu).alias("fair"), (F.col("actual") < F.col("line")).cast("int").alias("won")))))
    return legs.filter("price IS NOT NULL").withColumns({
        "edge": F.col("our_prob") - F.col("fair"),
        "pnl": F.when(F.col("won") == 1, F.col("price") - 1).otherwise(F.lit(-1.0))})


def market_coverage(quotes: DataFrame, targets: list[str]) -> DataFrame:
    """Which modelled markets have any quotes at all."""
    have = quotes.groupBy("market").agg(F.count("*").alias("n"))
    every = quotes.sparkSession.createDataFrame([(m,) for m in targets], "market string")
    return every.join(have, "market", "left").select("market", F.coalesce("n", F.lit(0)).alias("n"))
