"""Event cards, period totals, prices and tracked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contestlake.functions import odds, probability as prob
from contestlake.operators import order
from contestlake.operators.history import sides


def with_totals(periods: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Period rows plus their total as period 0."""
    totals = periods.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters]).withColumn("period", F.lit(0))
    return periods.select(*keys, "period", *counters).unionByName(totals.select(*keys, "period", *counters))


def median_price(quotes: DataFrame, keys: list[str], price: str) -> DataFrame:
    """Exact median over sources, with their number.

    Equal prices are merged first and order statistics come from range bins, so a
    market that holds most quotes is not gathered in one task.
    """
    mid = order.quantiles(quotes.select(*keys, F.col(price).alias("_v")), keys, "_v", F.lit(0.5))
    return mid.withColumnRenamed("q", "price")


def neutral_classes(rows: DataFrame) -> DataFrame:
    """Six side classes collapsed to three, whoever wins."""
    return rows.withColumns({
        "p_ko": F.col("pa_ko") + F.col("pb_ko"), "p_sub": F.col("pa_sub") + F.col("pb_sub"), "p_dec": F.col("pa_dec") + F.col("pb_dec"),
        "neutral_true": F.regexp_replace("method_true", "^[AB]_", "")})


def finish_rows(rows: DataFrame) -> DataFrame:
    """Binary view: does the contest end before the distance."""
    return rows.select((F.col("p_ko") + F.col("p_sub")).alias("p"), (F.col("neutral_true") != "DEC").cast("int").alias("label"))


def event_accuracy(rows: DataFrame) -> DataFrame:
    """Share of right favourites per event; placeholder probabilities do not count."""
    right = ((F.col("p") > 0.5) == (F.col("label") == 1)).cast("int")
    return rows.filter(F.abs(F.col("p") - 0.5) >= 0.005).groupBy("dt").agg(
        F.count("*").alias("n"), F.sum(right).alias("n_correct"), F.avg(right).alias("accuracy"))


def tracked(rows: DataFrame) -> DataFrame:
    """Accuracy, scores and realised profit of side-A value bets."""
    price = odds.american_to_decimal(F.when(F.col("a_is_red") == 1, F.col("odds_red")).otherwise(F.col("odds_blue")))
    value = F.col("p") * price > 1
    pnl = F.when(F.col("label") == 1, price - 1).otherwise(F.lit(-1.0))
    return rows.agg(
        F.count("*").alias("n"), F.avg(((F.col("p") > 0.5) == (F.col("label") == 1)).cast("int")).alias("accuracy"),
        F.avg(prob.brier(F.col("label"), F.col("p"))).alias("brier"), F.avg(prob.log_loss(F.col("label"), F.col("p"), 1e-6)).alias("log_loss"),
        F.count_if(value).alias("value_bets"), F.sum(F.when(value, pnl)).alias("value_pnl"))


def event_cards(rows: DataFrame, value: Column) -> DataFrame:
    """One row per event with its ordered contests and counts."""
    return rows.groupBy("dt").agg(
        F.count("*").alias("n"), F.count("odds_red").alias("n_priced"),
        F.count_if(value & F.col("odds_red").isNotNull()).alias("n_value"),
        F.min("contest_id").alias("first_contest"), F.max("contest_id").alias("last_contest"))


def nested(rows: DataFrame, event: str, fields: list[str], size: int = 500) -> DataFrame:
    """Contests nested under their event in id order, in pages of at most ``size`` entries.

    An event of any size becomes as many pages as it needs, so no task holds it whole.
    """
    binned = order.with_bin(rows.withColumns({"_id": order.sortable(rows, "contest_id"), "_one": F.lit(1).cast("bigint")}), "_id")
    placed = order.running(binned, [event], ["bin"], ["contest_id"], {"pos": "_one"})
    return placed.groupBy(event, F.floor(F.col("pos") / size).alias("page")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("contest_id", *fields))).alias("contests"))


def by_event_and_all(rows: DataFrame, event: str, amount: str) -> DataFrame:
    """Per-event groups and the group of everything."""
    return rows.groupingSets([[F.col(event)], []], F.col(event)).agg(
        F.count("*").alias("n"), F.sum(F.col(amount).cast("double")).alias("total")).select(
        F.coalesce(F.col(event).cast("string"), F.lit("all")).alias("event"), "n", "total")


def records(contests: DataFrame) -> DataFrame:
    won = F.coalesce(F.col("winner_id") == F.col("entity_id"), F.lit(False))
    return sides(contests, "winner_id").groupBy("entity_id").agg(
        F.concat_ws("-", F.count_if(won).cast("string"), F.count_if(~won).cast("string"), F.lit("0")).alias("record"))
