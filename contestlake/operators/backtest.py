"""Edges against vig-free prices, bucket returns and bankroll growth as products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contestlake.functions import odds, probability as prob
from contestlake.functions.plan import once
from contestlake.operators import order

START = 1000.0
STAKE_CAP = 0.05
# fixed values: edge buckets [lo, hi) and minimum edges of the reports
BUCKETS = [(-1.0, 0.0), (0.0, 0.02), (0.02, 0.05), (0.05, 0.10), (0.10, 0.20), (0.20, 1.0)]
MIN_EDGES = [0.0, 0.02, 0.03, 0.05, 0.07, 0.10, 0.15]
SIDE_MIN_EDGES = [0.0, 0.02, 0.05, 0.10]


def orient(rows: DataFrame) -> DataFrame:
    """Prices of sides A and B from red and blue; the side column is required."""
    red = F.col("a_is_red") == 1
    return rows.withColumns({"odds_a": F.when(red, F.col("odds_red")).otherwise(F.col("odds_blue")),
                             "odds_b": F.when(red, F.col("odds_blue")).otherwise(F.col("odds_red"))})


def closing_line(rows: DataFrame) -> DataFrame:
    """Model log-loss over all rows and over priced rows, against the closing line."""
    priced = F.col("odds_a").isNotNull() & F.col("odds_b").isNotNull()
    fair = odds.fair_share(odds.american_to_implied(F.col("odds_a")), odds.american_to_implied(F.col("odds_b")))
    mine, line = prob.log_loss(F.col("label"), F.col("p")), prob.log_loss(F.col("label"), fair)
    out = orient(rows).agg(
        F.count("*").alias("n"), F.count_if(priced).alias("n_priced"), F.avg(mine).alias("model_log_loss"),
        F.avg(F.when(priced, mine)).alias("model_log_loss_priced"), F.avg(F.when(priced, line)).alias("line_log_loss"))
    return out.withColumns({"delta": F.col("line_log_loss") - F.col("model_log_loss"),
                            "beats_line": (F.col("model_log_loss") < F.col("line_log_loss")).cast("int")})


def bets(rows: DataFrame) -> DataFrame:
    """One unit bet per priced contest on the side with the larger edge."""
    r = orient(rows).filter("odds_a IS NOT NULL AND odds_b IS NOT NULL")
    ia, ib = odds.american_to_implied(F.col("odds_a")), odds.american_to_implied(F.col("odds_b"))
    r = once(r, {"_fa": odds.fair_share(ia, ib), "_fb": odds.fair_share(ib, ia)})
    on_a = (F.col("p") - F.col("_fa")) >= ((1.0 - F.col("p")) - F.col("_fb"))
    r = once(r, {
        "side": F.when(on_a, "A").otherwise("B"), "our_prob": F.when(on_a, F.col("p")).otherwise(1.0 - F.col("p")),
        "fair": F.when(on_a, F.col("_fa")).otherwise(F.col("_fb")),
        "price": odds.american_to_decimal(F.when(on_a, F.col("odds_a")).otherwise(F.col("odds_b"))),
        "won": F.when(on_a, F.col("label")).otherwise(1 - F.col("label"))})
    return once(r, {"edge": F.col("our_prob") - F.col("fair"), "pnl": F.when(F.col("won") == 1, F.col("price") - 1).otherwise(F.lit(-1.0))},
                keep=["contest_id", "dt", "side", "our_prob", "fair", "price", "won"])


def bucket_of(edge: Column, buckets=BUCKETS) -> Column:
    """Index of the half-open bucket, NULL outside all of them; buckets touch each other."""
    starts = F.array(*[F.lit(lo) for lo, _ in buckets])
    return F.nullif(F.size(F.filter(F.filter(starts, lambda s: edge < buckets[-1][1]), lambda s: s <= edge)), F.lit(0)) - 1


def bucket_stats(rows: DataFrame, groups: list[str], keep_empty: bool, buckets=BUCKETS) -> DataFrame:
    """Flat-stake return, win rate and means per edge bucket."""
    got = rows.withColumn("bucket", bucket_of(F.col("edge"), buckets)).filter("bucket IS NOT NULL").groupBy(*groups, "bucket").agg(
        F.count("*").alias("n"), (100.0 * F.sum("pnl") / F.count("*")).alias("roi_pct"), F.avg("won").alias("win_rate"),
        F.avg("price").alias("avg_price"), F.avg("edge").alias("avg_edge"))
    if keep_empty and not groups:
        spark = rows.sparkSession
        every = spark.range(len(buckets)).selectExpr("int(id) AS bucket")
        got = every.join(got, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lo, hi = (F.array(*[F.lit(b[i]) for b in buckets]) for i in (0, 1))
    return got.withColumns({"edge_lo": F.element_at(lo, F.col("bucket") + 1), "edge_hi": F.element_at(hi, F.col("bucket") + 1)}).drop("bucket")


def kelly_curve(rows: DataFrame, groups: list[str], min_edges=MIN_EDGES, cap: float | None = None) -> DataFrame:
    """Final bankroll per minimum edge.

    The stake share does not depend on the bankroll, so growth is a product of
    (1 + share * pnl), summed as logarithms: combined map-side, no underflow.
    """
    share = odds.kelly_stake(F.col("our_prob"), F.col("price"))
    if cap is not None:
        share = F.least(share, F.lit(cap))
    grown = rows.filter("price > 1").withColumn("_g", F.log(1.0 + share * F.col("pnl")))
    taken = grown.select("*", F.explode(F.filter(F.array(*[F.lit(e) for e in min_edges]), lambda e: e <= F.col("edge"))).alias("min_edge"))
    out = taken.groupBy(*groups, "min_edge").agg(F.count("*").alias("n_bets"), F.sum("_g").alias("log_growth"),
                                                 F.avg("won").alias("win_rate"))
    out = out.withColumn("final_bankroll", START * F.exp("log_growth"))
    return out.withColumn("roi_pct", 100.0 * (F.col("final_bankroll") - START) / START)


def bankroll_history(rows: DataFrame) -> DataFrame:
    """Bankroll before and after each bet in the order (dt, contest_id).

    Side B takes the price implied by side A's, without removing the vig.
    """
    r = orient(rows).filter("odds_a IS NOT NULL").withColumn("_da", odds.american_to_decimal(F.col("odds_a")))
    implied = F.lit(1.0) / F.col("_da")
    on_a = F.col("p") > implied
    r = once(r, {
        "side": F.when(on_a, "A").otherwise("B"), "our_prob": F.when(on_a, F.col("p")).otherwise(1.0 - F.col("p")),
        "implied": F.when(on_a, implied).otherwise(1.0 - implied),
        "price": F.when(on_a, F.col("_da")).otherwise(F.col("_da") / (F.col("_da") - 1.0)),
        "won": F.when(on_a, F.col("label")).otherwise(1 - F.col("label"))})
    r = r.withColumn("share", odds.kelly_stake(F.col("our_prob"), F.col("price")))
    r = once(r, {"growth": 1.0 + F.col("share") * F.when(F.col("won") == 1, F.col("price") - 1).otherwise(F.lit(-1.0))})
    r = r.withColumn("_g", F.log("growth"))
    placed = order.running(order.by_day(r, "contest_id"), [], ["dt", "id_bin"], ["contest_id"], {"log_before": "_g"})
    before = F.exp(F.col("log_before")) * START
    return placed.select("contest_id", "dt", "side", "our_prob", "implied", (F.col("our_prob") - F.col("implied")).alias("edge"), "share",
                         (before * F.col("share")).alias("stake"), (before * (F.col("growth") - 1.0)).alias("pnl"),
                         (before * F.col("growth")).alias("bankroll"), (F.col("log_before") + F.col("_g")).alias("log_growth"), "won")
