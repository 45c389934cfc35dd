"""Ratings, trained models and calibrated predictions (checked by tests and row counts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from contestlake.functions import sql as sql_functions
from contestlake.functions.plan import durable
from contestlake.operators import backtest, calibrate, cross, ratings
from contestlake.plans import matrix, scoring, training
from workload.aggregates import CLASSES
from workload.features import sided, with_sides
from workload.pricing import QUOTES
from workload.registry import query

C = F.col
NUMERIC = ["diff_win_rate", "diff_slpm", "diff_sig_acc", "diff_td_def", "diff_ewma_win_rate", "diff_l5_win_rate", "diff_win_streak", "share"]


#: The probability of the first side may only rise with these.
SIGNS = {"share": 1, "diff_win_rate": 1, "diff_slpm": 1}


def training_rows(t):
    """As-of differences and price share of every decided contest, written once."""
    diffs = with_sides(t).select("contest_id", *[cross.difference(c[5:]) for c in NUMERIC if c.startswith("diff_")],
                                 *[C(f"f{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("ko_rate", "sub_rate")])
    base = t.oof.selectExpr("contest_id", "dt", "yr", "pool", "is_long", "label", "a_id", "b_id", "a_is_red", "odds_red", "odds_blue", "method", "period_ended", "p AS share")
    return durable(base.join(diffs, "contest_id"))


def weighted(rows):
    data, stages, inputs = training.prepare(rows, NUMERIC, ["pool"])
    return training.folds.decay_weights(data), stages, inputs


query("contest_ratings", "contest_id pool:s elo_a:d elo_b:d glicko_a:d glicko_b:d glicko_rd_a:d glicko_rd_b:d diff_elo:d diff_glicko:d")(lambda t: ratings.rate(sided(t))[0])
query("latest_ratings", "entity_id pool:s elo:d glicko:d glicko_rd:d n_contests last_dt:s")(lambda t: ratings.latest(ratings.rate(sided(t))[1]))
query("ratings_and_schedule_strength", "contest_id elo_a:d elo_b:d glicko_a:d a_sos_opponent:d b_sos_opponent:d diff_sos_quality_wins:d")(lambda t: matrix.rated_contests(sided(t))[0])
query("training_matrix", "contest_id dt:s label a_is_red elo_a:d glicko_rd_b:d diff_win_rate:d expected_a_td_landed:d diff_age:d a_post_peak:d diff_sos_opponent:d")(
    lambda t: matrix.training_matrix(t.contest, t.totals, t.entity))


query("walk_forward_predictions", "contest_id fold label raw:d p:d")(lambda t: training.walk_forward(training_rows(t), NUMERIC, ["pool"], 0))
query("stacked_calibration", "fold n per_fold:d stacked:d")(
    lambda t: training.calibration_table(training.stacked(training.walk_forward(training_rows(t), NUMERIC, ["pool"], 0))))


def _importance(t):
    data, stages, inputs = weighted(training_rows(t))
    return training.importances([training.booster(data, stages)], inputs, t.spark)


query("feature_gains", "feature:s gain:d")(_importance)


def _bagged(t):
    return training.bagged_walk_forward(training_rows(t), NUMERIC, ["pool"], 0, signs=SIGNS)


query("bagged_predictions", "contest_id mean:d spread:d")(_bagged)


def _final(t):
    rows = training_rows(t)
    # the parts of the folds are stored already; a checkpoint of their union does not resolve
    return training.final(rows, NUMERIC, ["pool"], training.walk_forward(rows, NUMERIC, ["pool"], 0))(rows)


query("final_predictions", "contest_id label raw:d p:d")(_final)


def _blend(t):
    rows = training_rows(t)
    rated, _ = ratings.rate(rows)
    oof = training.walk_forward(rows, NUMERIC, ["pool"], 0).select("contest_id", "label", "p")
    return training.blend(oof.join(rated.select("contest_id", "elo_a", "elo_b"), "contest_id"))


query("blended_predictions", "contest_id p:d blended:d used_blend final:d")(_blend)
TRUE = "concat(CASE label WHEN 1 THEN 'A_' ELSE 'B_' END, CASE method WHEN 'KO/TKO' THEN 'KO_TKO' WHEN 'SUB' THEN 'SUB' ELSE 'DEC' END)"
ROUND = "CASE WHEN method NOT LIKE 'Dec%' THEN concat('R', period_ended) END"
query("method_class_predictions", "contest_id fold method_true:s " + " ".join(f"c_{c}:d" for c in CLASSES))(
    lambda t: training.class_walk_forward(training_rows(t).withColumn("method_true", F.expr(TRUE)), NUMERIC, ["pool"], CLASSES, "method_true", 0))
query("round_class_predictions", "contest_id fold round_true:s c_R1:d c_R2:d c_R3:d c_R4:d c_R5:d")(
    lambda t: training.class_walk_forward(training_rows(t).withColumn("round_true", F.expr(ROUND)), NUMERIC, ["pool"], [f"R{i}" for i in range(1, 6)], "round_true", 0))


def _totals(t):
    from contestlake.operators import resolve
    names = {f"{side}_{counter}": f"total_{name}_{'combined' if side == 'both' else side}" for counter, name in (("sig_l", "sig_strikes"), ("td_l", "takedowns"), ("kd", "knockdowns"))
             for side in ("both", "a", "b") if counter != "kd" or side == "both"}
    counts = resolve.side_totals(t.oof, t.totals, ["sig_l", "td_l", "kd"]).select("contest_id", *[C(c).alias(n) for c, n in names.items()])
    return training.quantile_walk_forward(training_rows(t).join(counts, "contest_id"), list(names.values()), NUMERIC, ["pool"], 0)


query("totals_quantiles", "contest_id fold target:s q10:d q25:d q50:d q75:d q90:d estimate:d actual:d")(_totals)


def _score(t):
    """Each year with enough years before it as the schedule: train and calibrate before it, score it, and price its quotes."""
    data, stages, _ = training.prepare(training_rows(t), NUMERIC, ["pool"])
    data = durable(data)
    return reduce(DataFrame.unionByName, [durable(_score_year(t, data, stages, y)) for y in training.fold_years(data, 0)])


def _score_year(t, data, stages, year):
    past, coming = training.folds.decay_weights(data.filter(C("yr") < year)), data.filter(C("yr") == year)
    model = training.booster(past.filter(C("yr") < year - 1), stages)
    held = durable(training.raw_probability(model, past.filter(C("yr") == year - 1)))
    curve = training.fit_isotonic(held, "raw", "label")
    calibrated = training.calibrate(curve, held, "raw", "p")
    scored = training.calibrate(curve, training.raw_probability(model, coming), "raw", "p")
    scored = scored.withColumns({"diff_ko_rate": C("a_ko_rate") - C("b_ko_rate"), "diff_sub_rate": C("a_sub_rate") - C("b_sub_rate"),
                                 "a_name": F.concat(F.lit("Ann Lee"), F.lpad(C("a_id").cast("string"), 6, "0")),
                                 "b_name": F.concat(F.lit("Bo Roe"), F.lpad(C("b_id").cast("string"), 6, "0"))})
    pred = durable(scoring.predictions(scored, "pool", calibrate.scaled(calibrated), None, calibrate.halfwidth(calibrated)))
    history = backtest.bucket_stats(backtest.bets(calibrated), [], keep_empty=False).withColumn("market_class", F.lit("moneyline"))
    found = scoring.bets(pred, t.sql(QUOTES), history)
    best = found.groupBy("contest_id").agg(F.count("*").alias("n_bets"), F.sum("is_value").alias("n_value"), F.max("ev_pct").alias("best_ev"))
    return pred.join(best, "contest_id", "left")


query("scored_schedule", "contest_id p:d lo:d hi:d pa_ko:d pb_dec:d p_finish:d p_r1:d n_bets n_value best_ev:d")(_score)
query("sql_function_surface", "contest_id implied:d decimal:d stake:d fair:d loss:d", """
SELECT contest_id, CASE WHEN odds_red >= 0 THEN 100 / (odds_red + 100) ELSE -odds_red / (100 - odds_red) END AS implied, CASE WHEN odds_red >= 0 THEN odds_red / 100 + 1 ELSE 100 / abs(odds_red) + 1 END AS decimal,
  greatest(0, (CASE WHEN odds_red >= 0 THEN odds_red / 100 ELSE 100 / abs(odds_red) END * p - (1 - p)) / CASE WHEN odds_red >= 0 THEN odds_red / 100 ELSE 100 / abs(odds_red) END * 0.25) AS stake,
  p / (p + 0.5) AS fair, -CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END AS loss FROM oof WHERE odds_red IS NOT NULL
""")(lambda t: sql_functions.register(t.spark) or t.sql(
    "SELECT contest_id, american_to_implied(odds_red) AS implied, american_to_decimal(odds_red) AS decimal, kelly_stake(p, american_to_decimal(odds_red)) AS stake, fair_share(p, 0.5D) AS fair, log_loss(label, p) AS loss FROM oof WHERE odds_red IS NOT NULL"))
