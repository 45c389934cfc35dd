"""Stakes over many bets: initial sizing, compatible legs, caps and summary.

``scope`` separates independent portfolios (one event, or everything).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: caps in percent of the bankroll
PER_BET, PER_CONTEST, IN_TOTAL, SMALLEST = 5.0, 15.0, 50.0, 1.0
TOP_N, MAX_LEGS = 8, 5
STRATEGIES = ["kelly", "flat", "concentrated"]


def initial(bets: DataFrame, strategy: str, top_n: int = TOP_N, in_total: float = IN_TOTAL) -> DataFrame:
    if strategy == "kelly":
        return bets.withColumn("stake", F.coalesce("kelly_pct", F.lit(0.0)))
    if strategy == "flat":
        counts = bets.groupBy("scope").agg(F.count("*").alias("_n"))
        return bets.join(counts, "scope").withColumn("stake", F.lit(in_total) / F.col("_n")).drop("_n")
    if strategy == "concentrated":
        w = Window.partitionBy("scope").orderBy(F.col("kelly_pct").desc_nulls_last(), "bet_id")
        best = bets.select("scope", "bet_id", "kelly_pct").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_n)
        picked = bets.join(best.select("scope", "bet_id", "_r"), ["scope", "bet_id"], "left")
        return picked.withColumn("stake", F.when(F.col("_r").isNotNull(), F.coalesce("kelly_pct", F.lit(0.0))).otherwise(F.lit(0.0))).drop("_r")
    raise ValueError(f"unknown strategy {strategy!r}")


def compatible(bets: DataFrame, max_legs: int = MAX_LEGS) -> DataFrame:
    """Keep per contest, largest stake first, the legs that can still all win together.

    At most ``max_legs`` legs with the same outcome set can ever be kept, so each
    set is cut to that many in every task before a contest's legs are gathered;
    what is gathered is bounded by the number of distinct outcome sets.
    """
    staked = bets.filter("stake > 0").withColumn("_set", F.array_join(F.array_sort("outcome_keys"), ","))
    per_set = Window.partitionBy("scope", "contest", "_set").orderBy(F.col("stake").desc(), "bet_id")
    cut = staked.withColumn("_r", F.row_number().over(per_set)).filter(F.col("_r") <= max_legs)
    legs = cut.groupBy("scope", "contest").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("stake")).alias("order"), "bet_id", F.coalesce("outcome_keys", F.array().cast("array<string>")).alias("keys")))).alias("legs"))
    start = F.struct(F.array().cast(f"array<{dict(bets.dtypes)['bet_id']}>").alias("kept"), F.lit(None).cast("array<string>").alias("open"))

    def step(acc: Column, leg: Column) -> Column:
        free = F.size(leg["keys"]) == 0
        left = F.when(acc["open"].isNull(), leg["keys"]).otherwise(F.array_intersect(acc["open"], leg["keys"]))
        fits = (F.size(acc["kept"]) < max_legs) & (free | (F.size(left) > 0))
        return F.when(fits, F.struct(F.concat(acc["kept"], F.array(leg["bet_id"])).alias("kept"),
                                     F.when(free, acc["open"]).otherwise(left).alias("open"))).otherwise(acc)

    kept = legs.select("scope", F.explode(F.aggregate("legs", start, step)["kept"]).alias("bet_id"))
    return staked.drop("_set").join(kept, ["scope", "bet_id"], "left_semi")


def build(bets: DataFrame, strategy: str = "kelly", per_bet: float = PER_BET, per_contest: float = PER_CONTEST,
          in_total: float = IN_TOTAL, smallest: float = SMALLEST, top_n: int = TOP_N, max_legs: int = MAX_LEGS) -> DataFrame:
    """Final stakes; bets need scope, bet_id, contest, our_prob, price, kelly_pct, outcome_keys."""
    sized = initial(bets, strategy, top_n, in_total).withColumn("stake", F.least("stake", F.lit(per_bet)))
    legs = compatible(sized, max_legs)
    sums = legs.groupBy("scope", "contest").agg(F.sum("stake").alias("_c"))
    legs = legs.join(sums, ["scope", "contest"]).withColumn("stake", F.col("stake") * F.least(F.lit(1.0), F.lit(per_contest) / F.col("_c")))
    whole = legs.groupBy("scope").agg(F.sum("stake").alias("_t"))
    legs = legs.join(whole, "scope").withColumn("stake", F.col("stake") * F.least(F.lit(1.0), F.lit(in_total) / F.col("_t")))
    # sums may differ in the last bits between runs; a stake exactly on a limit must not
    legs = legs.withColumn("stake", F.round("stake", 8))
    return legs.filter(F.col("stake") >= smallest).drop("_c", "_t").withColumns({
        "stake_pct": F.round("stake", 2), "ev_per_unit": F.col("our_prob") * F.col("price") - 1, "payout": F.col("price") - 1}).drop("stake")


def summary(legs: DataFrame) -> DataFrame:
    """Totals per scope, with the best case over each contest's atomic outcomes.

    A leg without keys wins in every outcome; a contest of only such legs counts
    all their payouts.
    """
    per_contest = legs.groupBy("scope", "contest").agg(
        F.sum("stake_pct").alias("staked"), F.sum(F.col("stake_pct") * F.col("ev_per_unit")).alias("expected"), F.count("*").alias("n"),
        F.sum(F.when(F.size("outcome_keys") == 0, F.col("stake_pct") * F.col("payout")).otherwise(F.lit(0.0))).alias("sure"),
        F.sum(F.when(F.size("outcome_keys") > 0, F.col("stake_pct")).otherwise(F.lit(0.0))).alias("at_risk"))
    # net of an outcome = what wins there - what is at risk but does not cover it
    won = (legs.select("scope", "contest", F.explode("outcome_keys").alias("key"), (F.col("stake_pct") * (F.col("payout") + 1)).alias("back"))
           .groupBy("scope", "contest", "key").agg(F.sum("back").alias("back")).groupBy("scope", "contest").agg(F.max("back").alias("back")))
    best = per_contest.join(won, ["scope", "contest"], "left").withColumn(
        "best", F.col("sure") + F.coalesce(F.col("back") - F.col("at_risk"), F.lit(0.0)))
    return best.groupBy("scope").agg(
        F.sum("staked").alias("total_stake_pct"), F.sum("expected").alias("expected_pnl_pct"), F.sum("best").alias("best_case_pct"),
        (-F.sum("staked")).alias("worst_case_pct"), F.sum("n").alias("n_bets"), F.count("*").alias("n_contests"))


def with_scopes(bets: DataFrame, event: str) -> DataFrame:
    """Every bet in its event's portfolio and in the one of everything."""
    return bets.select("*", F.explode(F.array(F.col(event).cast("string"), F.lit("all"))).alias("scope"))


def by_strategy(bets: DataFrame) -> DataFrame:
    """Summaries of all strategies for all scopes."""
    parts = [summary(build(bets, s)).withColumn("strategy", F.lit(s)) for s in STRATEGIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
