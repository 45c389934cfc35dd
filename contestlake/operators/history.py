"""Long history: one row per entity and contest with own and opposing statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NOT_RATED = ["NC", "DQ", "CANCELLED"]
STATS = ["kd", "sig_l", "sig_a", "td_l", "td_a", "sub_att", "ctrl"]


def rated(method: Column) -> Column:
    """Contests that count: a method is known and is not a void one."""
    return method.isNotNull() & ~method.isin(NOT_RATED)


def eligible(contests: DataFrame, since_year: int) -> DataFrame:
    return contests.filter(rated(F.col("method")) & F.col("winner_id").isNotNull()
                           & (F.col("dt") >= F.make_date(F.lit(since_year), F.lit(1), F.lit(1))))


def entity_history(contests: DataFrame, totals: DataFrame, duration_col: str = "time_ended_sec") -> DataFrame:
    """Rated contests of each entity that has totals; the other side's totals may be absent.

    ``duration_col`` names the seconds that per-minute rates divide by.
    """
    own = totals.select("contest_id", "entity_id", *STATS)
    other = totals.selectExpr("contest_id AS _c", "entity_id AS _e",
                              *[f"{c} AS opp_{c}" for c in ("td_l", "td_a", "sig_l", "sig_a")])
    base = contests.filter(rated(F.col("method"))).selectExpr(
        "contest_id", "dt", "pool", "red_id", "blue_id", "winner_id", "upper(method) AS m",
        f"bigint(greatest(coalesce({duration_col}, 0), 30)) AS sec")
    joined = (base.join(own, "contest_id").filter("entity_id IN (red_id, blue_id)")
              .join(other, (F.col("contest_id") == F.col("_c")) & (F.col("entity_id") != F.col("_e")), "left")
              .selectExpr("*", "int(coalesce(winner_id = entity_id, false)) AS won",
                          "int(contains(m, 'KO')) AS ko", "int(contains(m, 'SUB')) AS sub"))
    return joined.selectExpr(
        "contest_id", "entity_id", "dt", "pool", *STATS, "opp_td_l", "opp_td_a", "opp_sig_l", "opp_sig_a",
        "won", "ko", "greatest(ko, sub) AS finish", "sub * won AS sub_win", "ko * (1 - won) AS ko_loss",
        "sub * (1 - won) AS sub_loss", "greatest(ko, sub) * (1 - won) AS finish_loss", "sec")


def sides(contests: DataFrame, *keep: str) -> DataFrame:
    """Both sides of each contest as rows (entity_id, opponent_id, is_red)."""
    pair = F.array(F.struct(F.col("red_id").alias("entity_id"), F.col("blue_id").alias("opponent_id"),
                            F.lit(1).alias("is_red")),
                   F.struct(F.col("blue_id").alias("entity_id"), F.col("red_id").alias("opponent_id"),
                            F.lit(0).alias("is_red")))
    return contests.select(*keep, F.inline(pair))
