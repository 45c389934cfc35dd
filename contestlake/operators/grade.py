"""Grading of bets and predictions against results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contestlake.functions import names


def result_method(text: Column) -> Column:
    up = F.upper(text)
    return (F.when(F.trim(up).isin("", "FINAL"), F.lit(None).cast("string")).when(up.contains("KO"), "KO").when(up.contains("SUB"), "SUB")
            .when(up.rlike("DEC|POINT|DRAW"), "DEC"))


def actual_key(side: Column, method: Column, period: Column) -> Column:
    """'A|KO|2' or 'B|DEC|DEC'; NULL when side, method or round is not known."""
    m = result_method(method)
    return F.when(side.isin("A", "B"), F.when(m == "DEC", F.concat(side, F.lit("|DEC|DEC")))
                  .when(m.isNotNull() & period.between(1, 5), F.concat_ws("|", side, m, period.cast("string"))))


def actual_totals(stats: DataFrame) -> DataFrame:
    """(contest, market, actual) rows of the seven totals targets from side statistics a_*, b_*."""
    t = {"total_sig_strikes_a": "a_sig", "total_sig_strikes_b": "b_sig", "total_takedowns_a": "a_td", "total_takedowns_b": "b_td"}
    cells = {k: F.coalesce(F.col(v), F.lit(0)) for k, v in t.items()}
    cells["total_sig_strikes_combined"] = cells["total_sig_strikes_a"] + cells["total_sig_strikes_b"]
    cells["total_takedowns_combined"] = cells["total_takedowns_a"] + cells["total_takedowns_b"]
    cells["total_knockdowns_combined"] = F.coalesce("a_kd", F.lit(0)) + F.coalesce("b_kd", F.lit(0))
    return stats.select("contest_id", F.inline(F.array(*[F.struct(F.lit(k).alias("market"), v.cast("double").alias("actual")) for k, v in cells.items()])))


def grade(bets: DataFrame, results: DataFrame, totals: DataFrame) -> DataFrame:
    """won / lost / NULL per bet.

    Totals keys compare with the actual total (equality loses both ways); other
    bets win when they cover the actual outcome; with an unknown method a bet is
    still decided when all its outcomes are on one side.
    """
    first = F.element_at("outcome_keys", 1)
    is_total = (F.size("outcome_keys") > 0) & first.startswith("TOTAL|")
    b = bets.withColumns({"_total": is_total, "_parts": F.when(is_total, F.split(first, r"\|"))})
    b = b.withColumns({"_target": F.col("_parts")[1], "_dir": F.col("_parts")[2], "_line": F.col("_parts")[3].try_cast("double")})
    # both meet the bets by contest, as the bets already lie: a key of (contest, market) would deal all bets out anew
    t = totals.groupBy("contest_id").agg(F.collect_list(F.struct(F.col("market").alias("m"), "actual")).alias("_actuals"))
    b = b.join(results.select("contest_id", "actual_key", "actual_side").hint("shuffle_hash"), "contest_id", "left").join(t.hint("shuffle_hash"), "contest_id", "left")
    met = F.filter("_actuals", lambda x: x["m"] == F.col("_target"))
    b = b.select(*[c for c in b.columns if c != "_actuals"], F.explode_outer(met).alias("_met")).withColumn("actual", F.col("_met.actual"))
    who = F.array_distinct(F.transform("outcome_keys", lambda k: F.substring(k, 1, 1)))
    total = F.when(F.col("_dir") == "over", F.col("actual") > F.col("_line")).when(F.col("_dir") == "under", F.col("actual") < F.col("_line"))
    one_side = F.when((F.size(who) == 1) & (who[0] == F.col("actual_side")), True).when(~F.array_contains(who, F.col("actual_side")), False)
    hit = (F.when(F.size("outcome_keys") == 0, F.lit(None).cast("boolean")).when(F.col("_total"), total)
           .when(F.col("actual_key").isNotNull(), F.array_contains("outcome_keys", F.col("actual_key")))
           .when(F.col("actual_side").isNotNull(), one_side))
    return b.withColumn("result", F.when(hit, "won").when(~hit, "lost")).drop("_total", "_parts", "_target", "_dir", "_line", "_met", "actual")


def ranked(graded: DataFrame, top: int = 5) -> DataFrame:
    """Rank by expected value, and the top picks with value bets first."""
    by_ev = Window.partitionBy("contest_id").orderBy(F.col("ev_pct").desc(), "market", "selection")
    value_first = Window.partitionBy("contest_id").orderBy(F.col("is_value").desc(), F.col("ev_pct").desc(), "market", "selection")
    return graded.withColumns({"rank": F.row_number().over(by_ev), "pick": F.row_number().over(value_first)}).withColumn(
        "is_top", (F.col("pick") <= top).cast("int")).drop("pick")


def top_picks(graded: DataFrame, top: int = 5) -> DataFrame:
    """Only the top picks, limited in every task before contests are gathered."""
    w = Window.partitionBy("contest_id").orderBy(F.col("is_value").desc(), F.col("ev_pct").desc(), "market", "selection")
    return graded.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= top)


def names_match(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    last = names.last_token(x) == names.last_token(y)
    return F.coalesce((x != "") & (y != "") & ((x == y) | y.contains(x) | x.contains(y) | last), F.lit(False))


def prediction_correct(winner: Column, a: Column, b: Column, p: Column) -> Column:
    """1, 0 or NULL: did the favoured side win, matching the winner's name to a side."""
    a_won = F.when(names_match(winner, a), True).when(names_match(winner, b), False)
    return F.when(F.abs(p - 0.5) >= 0.005, ((p >= 0.5) == a_won).cast("int"))


def split_events(rows: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """Completed and open contests as of a day."""
    done = (F.col("dt") < today) | F.col("winner_id").isNotNull()
    return rows.filter(done), rows.filter(~done)
