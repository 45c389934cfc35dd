"""Results attached to stored predictions whose names are spelled differently.

Names are scored once per distinct pair.  A prediction keeps only the candidates of
its two names that have a contest near its day; each pair of them is one unordered
key, so both orders of the sides meet in a single equi-join with the contests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contestlake.functions import names
from contestlake.functions.plan import durable
from contestlake.operators import fuzzy, grade, resolve, worklists


def _near(rows: DataFrame, days: int, spread: bool) -> DataFrame:
    """Rows with the bucket of their day, and of the two beside it when ``spread``; a bucket is one window wide."""
    own = F.floor(F.unix_date("dt") / (days + 1))
    return rows.withColumn("_bucket", F.explode(F.array(*[own + i for i in (-1, 0, 1)])) if spread else own)


def match(predictions: DataFrame, contests: DataFrame, threshold: float = 70.0, days: int = 3, scorer: str = "set") -> DataFrame:
    """Best contest of each prediction: prediction_id, contest_id, score, a_is_red.

    The score is the lower one of the two names' scores, in the better of both orders; among equal scores the
    latest contest wins, then the smallest contest_id.  Side A is red when its name scores at least as well
    against red as against blue.  ``predictions`` needs prediction_id, dt, a_name, b_name; ``contests``
    contest_id, dt, red_name, blue_name.  Rows without a day or with an empty name match nothing; repeated
    predictions are matched each on their own.  A score of 100 cannot be beaten: only predictions without one are
    compared at ``threshold``, and with the contests of the days near them.
    """
    key = lambda c: names.name_key(F.col(c))
    p = predictions.select("prediction_id", "dt", key("a_name").alias("_a"), key("b_name").alias("_b")).filter("_a <> '' AND _b <> '' AND dt IS NOT NULL").distinct()
    c = contests.select("contest_id", "dt", key("red_name").alias("_x"), key("blue_name").alias("_y")).filter("_x <> '' AND _y <> '' AND dt IS NOT NULL")
    p, c = durable(p), durable(c)       # dozens of branches of the search read them
    if threshold >= 100:
        return _match(p, c, threshold, days, scorer)
    key = ["prediction_id", "dt", "_a", "_b"]
    first = durable(_match(p, c, 100.0, days, scorer))
    rest = durable(p.join(first.select(*key), key, "left_anti").join(resolve.days_around(c, days), "dt", "left_semi"))
    if rest.isEmpty():
        return first
    return first.unionByName(_match(rest, c.join(resolve.days_around(rest, days), "dt", "left_semi"), threshold, days, scorer))


def _match(p: DataFrame, c: DataFrame, threshold: float, days: int, scorer: str) -> DataFrame:
    asked = durable(p.select(F.explode(F.array("_a", "_b")).alias("l")).distinct())
    known = durable(c.select(F.explode(F.array("_x", "_y")).alias("r")).distinct())
    # four joins read the scores, which are Python work
    score = durable(fuzzy.name_pairs(asked, known, threshold, scorer))

    placed = _near(c, days, False)
    active = placed.select(F.explode(F.array("_x", "_y")).alias("r"), "_bucket").distinct()
    spread = _near(p.select("prediction_id", "dt", "_a", "_b"), days, True)

    def candidates(side: str, name: str, points: str) -> DataFrame:
        found = spread.join(score.withColumnRenamed("l", side), side).join(active, ["r", "_bucket"])
        return found.select("prediction_id", "dt", "_a", "_b", "_bucket", F.col("r").alias(name), F.col("score").alias(points))

    pairs = candidates("_a", "_p", "_s1").join(candidates("_b", "_q", "_s2"), ["prediction_id", "dt", "_a", "_b", "_bucket"])
    pairs = pairs.withColumn("_pair", resolve.pair_key(F.col("_p"), F.col("_q")))
    there = placed.withColumn("_pair", resolve.pair_key(F.col("_x"), F.col("_y"))).withColumnRenamed("dt", "_day")
    met = pairs.join(there, ["_bucket", "_pair"]).filter(F.abs(F.date_diff("dt", "_day")) <= days)
    met = met.withColumn("score", F.least("_s1", "_s2"))
    w = Window.partitionBy("prediction_id", "dt", "_a", "_b").orderBy(F.col("score").desc(), F.col("_day").desc(), "contest_id")
    best = met.withColumn("_r", F.row_number().over(w)).filter("_r = 1")

    def against(side: str, out: str) -> DataFrame:
        return score.select(F.col("l").alias("_a"), F.col("r").alias(side), F.col("score").alias(out))

    best = best.join(against("_x", "_red"), ["_a", "_x"], "left").join(against("_y", "_blue"), ["_a", "_y"], "left")
    # a score below the threshold is absent, and lower than the one that made the match
    red = F.coalesce("_red", F.lit(0.0)) >= F.coalesce("_blue", F.lit(0.0))
    return best.select("prediction_id", "dt", "_a", "_b", "contest_id", "score", red.alias("a_is_red"))


def _with_match(predictions: DataFrame, contests: DataFrame, found: DataFrame, how: str, keep: list[str]) -> DataFrame:
    """Predictions with their contest's columns ``keep``, the score and whether side A is red."""
    rows = predictions.withColumns({"_a": names.name_key(F.col("a_name")), "_b": names.name_key(F.col("b_name"))})
    there = contests.select("contest_id", *[F.col(c).alias(f"_{c}") for c in keep])
    return rows.join(found, ["prediction_id", "dt", "_a", "_b"], how).join(there, "contest_id", how).drop("_a", "_b")


def decided(predictions: DataFrame, contests: DataFrame, today: Column, threshold: float = 70.0, days: int = 3) -> DataFrame:
    """Predictions with a decided contest before ``today``, and whether side A won it.

    Contests need a winner and a method.  Predictions that match none are left out.
    """
    past = contests.filter((F.col("dt") < today) & F.col("winner_id").isNotNull() & F.col("method").isNotNull())
    rows = _with_match(predictions, past, match(predictions, past, threshold, days), "inner", ["winner_id", "red_id", "method"])
    won = (F.col("_winner_id") == F.col("_red_id")) == F.col("a_is_red")
    return rows.withColumns({"a_won": won.cast("int"), "method": F.col("_method"), "match_score": F.col("score")}).drop("_winner_id", "_red_id", "_method", "score")


def _live_side() -> Column:
    """Side whose name holds the live winner's name or is held by it, side A first."""
    w = F.lower(F.trim("live_winner"))

    def same(name: str) -> Column:
        n = F.lower(F.trim(name))
        return (n != "") & (w != "") & (n.contains(w) | w.contains(n))

    return F.when(F.col("is_completed"), F.when(same("a_name"), "A").when(same("b_name"), "B"))


def past(predictions: DataFrame, contests: DataFrame, totals: DataFrame, counters: list[str], threshold: float = 70.0, days: int = 3) -> DataFrame:
    """Every prediction with what happened: winner's side, method, round, both sides' totals, right or not.

    ``predictions`` needs prediction_id, dt, a_name, b_name, p, is_completed, live_winner, live_method, live_round
    and stored_correct; ``contests`` the columns of ``match`` and red_id, blue_id, winner_id, method, round.
    A prediction without a contest takes the live result if it has one; its stored grade then stays.  A
    contest without a winner decides nothing.  Probabilities near one half are not graded.  Totals are a_* and
    b_*: NULL without a row of that side, missing counters 0.
    """
    keep = ["red_id", "blue_id", "winner_id", "method", "round"]
    rows = _with_match(predictions, contests, match(predictions, contests, threshold, days, "set_left"), "left", keep)
    found, red = F.col("contest_id").isNotNull(), F.col("a_is_red")
    winner_red = F.col("_winner_id") == F.col("_red_id")
    side = F.when(found, F.when(winner_red == red, "A").when(winner_red != red, "B")).otherwise(_live_side())
    rows = rows.withColumns({
        "actual_side": side,
        "actual_method": F.when(found, F.col("_method")).when(F.col("is_completed"), F.col("live_method")),
        "actual_round": F.when(found, F.col("_round")).when(F.col("is_completed"), F.col("live_round")),
        "_a_id": F.when(red, F.col("_red_id")).otherwise(F.col("_blue_id")), "_b_id": F.when(red, F.col("_blue_id")).otherwise(F.col("_red_id"))})
    p = worklists.informative(F.col("p"))
    graded = F.when(found, (p >= 0.5) == (F.col("actual_side") == "A")).when(F.col("is_completed") & p.isNotNull() & F.col("live_winner").isNotNull(), F.col("stored_correct") == 1)
    rows = rows.withColumns({"actual_key": grade.actual_key(F.col("actual_side"), F.col("actual_method"), F.col("actual_round")), "pred_correct": graded.cast("int")})
    for s in "ab":
        t = totals.select(F.col("contest_id"), F.col("entity_id").alias(f"_{s}_id"), *[F.coalesce(F.col(c), F.lit(0)).alias(f"{s}_{c}") for c in counters])
        rows = rows.join(t, ["contest_id", f"_{s}_id"], "left")
    return rows.drop(*[f"_{c}" for c in keep], "_a_id", "_b_id").withColumnRenamed("score", "match_score")


def event_accuracy(rows: DataFrame) -> DataFrame:
    """Right and graded predictions of each event, and their whole percentage."""
    n, right = F.count("pred_correct"), F.coalesce(F.sum("pred_correct"), F.lit(0))
    return rows.groupBy("dt").agg(right.alias("n_correct"), n.alias("n_resolved"), F.when(n > 0, F.bround(100.0 * right / n)).alias("accuracy_pct"))
