"""Aggregations: period totals, prices, probability quality, drift, event cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.functions import probability as prob
from contestlake.operators import cards, folds, metrics, order
from workload.registry import query

C = F.col
COUNTERS = ["kd", "sig_l", "sig_a", "td_l", "td_a", "ctrl"]

query("period_totals", "contest_id entity_id period " + " ".join(COUNTERS), f"""
SELECT contest_id, entity_id, period, {", ".join(COUNTERS)} FROM periods
UNION ALL SELECT contest_id, entity_id, 0, {", ".join(f"sum({c})" for c in COUNTERS)} FROM periods GROUP BY contest_id, entity_id
""")(lambda t: cards.with_totals(t.periods, ["contest_id", "entity_id"], COUNTERS))

query("median_prices", "user_id market:s price:d n", """
SELECT user_id, event_type AS market, median(value) AS price, count(*) AS n FROM events GROUP BY 1, 2
""")(lambda t: cards.median_price(t.events, ["user_id", "event_type"], "value").withColumnRenamed("event_type", "market"))

query("priced_event_counts", "dt:s n n_priced", """
SELECT dt, count(*) AS n, count(odds_red) AS n_priced FROM contest GROUP BY dt HAVING count(odds_red) >= 3
""")(lambda t: t.contest.groupBy("dt").agg(F.count("*").alias("n"), F.count("odds_red").alias("n_priced")).filter("n_priced >= 3"))

AUC = """(SELECT {g} (sum(CASE WHEN label = 1 THEN r END) - (sum(label) * (sum(label) + 1) / 2.0E0)) / (sum(label) * (count(*) - sum(label))) AS auc
  FROM (SELECT {g} label, rank() OVER ({w} ORDER BY p) + (count(*) OVER (PARTITION BY {g} p) - 1) / 2.0E0 AS r FROM oof) AS x {by})"""
LOSS = "avg(-CASE WHEN label = 1 THEN ln(greatest(least(p, 1 - 1E-7), 1E-7)) ELSE ln(1 - greatest(least(p, 1 - 1E-7), 1E-7)) END)"
query("probability_quality", "n log_loss:d brier:d accuracy:d auc:d", f"""
SELECT n, log_loss, brier, accuracy, auc FROM (SELECT count(*) AS n, {LOSS} AS log_loss, avg((p - label) * (p - label)) AS brier,
  avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM oof) AS a, {AUC.format(g="", w="", by="")} AS b
""")(lambda t: metrics.binary(t.oof, []))
query("probability_quality_by_year", "yr n log_loss:d brier:d accuracy:d auc:d", f"""
SELECT a.yr, n, log_loss, brier, accuracy, auc FROM (SELECT yr, count(*) AS n, {LOSS} AS log_loss, avg((p - label) * (p - label)) AS brier,
  avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM oof GROUP BY yr) AS a JOIN {AUC.format(g="yr,", w="PARTITION BY yr", by="GROUP BY yr")} AS b ON a.yr = b.yr
""")(lambda t: metrics.binary(t.oof, ["yr"]))
query("exact_auc", "auc:d", f"SELECT auc FROM {AUC.format(g='', w='', by='')} AS b")(lambda t: metrics.auc(t.oof, []))

query("reliability_bins", "slot mean_pred:d observed:d n", """
SELECT least(floor(p * 10), 9) AS slot, avg(p) AS mean_pred, avg(label) AS observed, count(*) AS n FROM oof GROUP BY 1
""")(lambda t: metrics.reliability(t.oof))

# Six class probabilities per contest, side probability split by a hash of the contest.
CLASSES = ["A_KO_TKO", "A_SUB", "A_DEC", "B_KO_TKO", "B_SUB", "B_DEC"]
CLASS_P = """SELECT contest_id, dt, yr, is_long, p, label, method, period_ended, a_is_red,
  concat(CASE label WHEN 1 THEN 'A_' ELSE 'B_' END, CASE WHEN method = 'KO/TKO' THEN 'KO_TKO' WHEN method = 'SUB' THEN 'SUB' ELSE 'DEC' END) AS method_true,
  CASE WHEN method LIKE 'Dec%' THEN 'DEC' ELSE concat('R', CAST(period_ended AS STRING)) END AS round_true,
  p * (0.2E0 + (contest_id % 5) * 0.05E0) AS pa_ko, p * (0.15E0 + (contest_id % 3) * 0.05E0) AS pa_sub,
  p * (0.65E0 - (contest_id % 5) * 0.05E0 - (contest_id % 3) * 0.05E0) AS pa_dec,
  (1 - p) * (0.3E0 + (contest_id % 4) * 0.05E0) AS pb_ko, (1 - p) * 0.2E0 AS pb_sub, (1 - p) * (0.5E0 - (contest_id % 4) * 0.05E0) AS pb_dec,
  0.3E0 + (contest_id % 3) * 0.02E0 AS r1, 0.2E0 AS r2, 0.2E0 AS r3, 0.1E0 AS r4, 0.1E0 AS r5 FROM oof"""
PROBS = dict(zip(CLASSES, ["pa_ko", "pa_sub", "pa_dec", "pb_ko", "pb_sub", "pb_dec"]))
LONG = f"""(SELECT contest_id, class, class_p / (pa_ko + pa_sub + pa_dec + pb_ko + pb_sub + pb_dec) AS class_p, CASE WHEN method_true = class THEN 1 ELSE 0 END AS hit FROM (
  {" UNION ALL ".join(f"SELECT *, '{k}' AS class, {v} AS class_p FROM cp" for k, v in PROBS.items())}) AS u)"""
HIT_LOSS = "avg(-CASE WHEN hit = 1 THEN ln(greatest(least(class_p, 1 - 1E-7), 1E-7)) ELSE ln(1 - greatest(least(class_p, 1 - 1E-7), 1E-7)) END)"

query("class_quality", "class:s n log_loss:d brier:d base_rate:d mean_pred:d auc:d", f"""
WITH cp AS ({CLASS_P}), long AS {LONG},
ranked AS (SELECT class, hit, rank() OVER (PARTITION BY class ORDER BY class_p) + (count(*) OVER (PARTITION BY class, class_p) - 1) / 2.0E0 AS r FROM long),
area AS (SELECT class, (sum(CASE WHEN hit = 1 THEN r END) - (sum(hit) * (sum(hit) + 1) / 2.0E0)) / (sum(hit) * (count(*) - sum(hit))) AS auc FROM ranked GROUP BY class)
SELECT a.class, n, log_loss, brier, base_rate, mean_pred, auc FROM (SELECT class, count(*) AS n, {HIT_LOSS} AS log_loss, avg((class_p - hit) * (class_p - hit)) AS brier,
  avg(hit) AS base_rate, avg(class_p) AS mean_pred FROM long GROUP BY class) AS a JOIN area ON area.class = a.class
""")(lambda t: metrics.per_class(metrics.explode_classes(t.sql(CLASS_P), CLASSES, "method_true", PROBS)))

MULTI = """
SELECT n, log_loss, top1, base_log_loss, base_log_loss - log_loss AS lift FROM (
  SELECT count(*) AS n, avg(-ln(greatest(least(pt, 1), 1E-7))) AS log_loss, avg(CASE WHEN truth = top THEN 1.0 ELSE 0.0 END) AS top1 FROM t) AS a,
  (SELECT -sum(c * ln(c / total)) / max(total) AS base_log_loss FROM (SELECT truth, count(*) AS c, sum(count(*)) OVER () AS total FROM t GROUP BY truth) AS s) AS b"""
query("multiclass_quality", "n log_loss:d top1:d base_log_loss:d lift:d", f"""
WITH cp AS ({CLASS_P}), t AS (SELECT method_true AS truth, CASE method_true {" ".join(f"WHEN '{k}' THEN {v}" for k, v in PROBS.items())} END / (pa_ko + pa_sub + pa_dec + pb_ko + pb_sub + pb_dec) AS pt,
  CASE {" ".join(f"WHEN {v} / s >= best THEN '{k}'" for k, v in PROBS.items())} END AS top
  FROM (SELECT *, greatest(pa_ko / s, pa_sub / s, pa_dec / s, pb_ko / s, pb_sub / s, pb_dec / s) AS best FROM (SELECT *, pa_ko + pa_sub + pa_dec + pb_ko + pb_sub + pb_dec AS s FROM cp) AS z) AS y) {MULTI}
""")(lambda t: metrics.multiclass(t.sql(CLASS_P), CLASSES, "method_true", PROBS))

query("neutral_class_quality", "n log_loss:d top1:d base_log_loss:d lift:d", f"""
WITH cp AS ({CLASS_P}), t AS (SELECT regexp_replace(method_true, '^[AB]_', '') AS truth,
  CASE regexp_replace(method_true, '^[AB]_', '') WHEN 'KO_TKO' THEN pa_ko + pb_ko WHEN 'SUB' THEN pa_sub + pb_sub ELSE pa_dec + pb_dec END / (pa_ko + pb_ko + (pa_sub + pb_sub) + (pa_dec + pb_dec)) AS pt,
  CASE WHEN k / s >= best THEN 'KO_TKO' WHEN u / s >= best THEN 'SUB' ELSE 'DEC' END AS top
  FROM (SELECT *, greatest(k / s, u / s, d / s) AS best FROM (SELECT *, pa_ko + pb_ko AS k, pa_sub + pb_sub AS u, pa_dec + pb_dec AS d, pa_ko + pb_ko + (pa_sub + pb_sub) + (pa_dec + pb_dec) AS s FROM cp) AS z) AS y) {MULTI}
""")(lambda t: metrics.multiclass(cards.neutral_classes(t.sql(CLASS_P)), ["KO_TKO", "SUB", "DEC"], "neutral_true",
                                  {"KO_TKO": "p_ko", "SUB": "p_sub", "DEC": "p_dec"}))
query("finish_binary_quality", "n log_loss:d brier:d offset_mean:d", f"""
WITH cp AS ({CLASS_P}), f AS (SELECT pa_ko + pb_ko + (pa_sub + pb_sub) AS p, CASE WHEN method_true LIKE '%DEC' THEN 0 ELSE 1 END AS label FROM cp)
SELECT count(*) AS n, {LOSS} AS log_loss, avg((p - label) * (p - label)) AS brier, avg(p) - avg(label) AS offset_mean FROM f
""")(lambda t: cards.finish_rows(cards.neutral_classes(t.sql(CLASS_P))).transform(
    lambda f: metrics.binary(f, []).withColumn("offset_mean", f.select(F.avg("p") - F.avg("label")).scalar())))

query("event_accuracy", "dt:s n n_correct accuracy:d", """
SELECT dt, count(*) AS n, sum(ok) AS n_correct, avg(ok) AS accuracy FROM (SELECT dt, CASE WHEN (p > 0.5) = (label = 1) THEN 1 ELSE 0 END AS ok FROM oof WHERE abs(p - 0.5) >= 0.005) AS x GROUP BY dt
""")(lambda t: cards.event_accuracy(t.oof))

query("tracked_performance", "n accuracy:d brier:d log_loss:d value_bets value_pnl:d", """
SELECT count(*) AS n, avg(CASE WHEN (p > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, avg((p - label) * (p - label)) AS brier,
  avg(-CASE WHEN label = 1 THEN ln(greatest(least(p, 1 - 1E-6), 1E-6)) ELSE ln(1 - greatest(least(p, 1 - 1E-6), 1E-6)) END) AS log_loss,
  count(*) FILTER (p * d > 1) AS value_bets, sum(CASE WHEN label = 1 THEN d - 1 ELSE -1 END) FILTER (p * d > 1) AS value_pnl
FROM (SELECT *, CASE WHEN o >= 0 THEN o / 100 + 1 ELSE 100 / abs(o) + 1 END AS d FROM (SELECT *, CASE a_is_red WHEN 1 THEN odds_red ELSE odds_blue END AS o FROM oof) AS y) AS x
""")(lambda t: cards.tracked(t.oof))
query("backtest_since_year", "n accuracy:d brier:d log_loss:d", f"""
SELECT count(*) AS n, avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy, avg((p - label) * (p - label)) AS brier, {LOSS} AS log_loss FROM oof WHERE yr >= 1999
""")(lambda t: metrics.binary(t.oof.filter("yr >= 1999"), []))

query("drift_check", "n_recent recent:d n_before before:d delta:d alert", f"""
WITH x AS (SELECT dt, contest_id, -CASE WHEN label = 1 THEN ln(greatest(least(p, 1 - 1E-7), 1E-7)) ELSE ln(1 - greatest(least(p, 1 - 1E-7), 1E-7)) END AS loss FROM oof),
a AS (SELECT count(*) AS n_recent, avg(loss) AS recent FROM x WHERE dt >= DATE '2001-07-31' - 90),
b AS (SELECT count(*) AS n_before, avg(loss) AS before FROM (SELECT loss FROM x WHERE dt < DATE '2001-07-31' - 90 ORDER BY dt DESC, contest_id DESC LIMIT 200) AS y)
SELECT n_recent, recent, n_before, before, CASE WHEN n_recent >= 10 AND n_before >= 50 THEN recent - before END AS delta,
  coalesce(n_recent >= 10 AND n_before >= 50 AND recent - before > 0.05, false) AS alert FROM a, b
""")(lambda t: metrics.drift(t.oof, F.lit("2001-07-31").cast("date")))

# Quantile rows: five estimates around a line quantity, the quantity itself as actual.
TOTALS = """SELECT l_orderkey AS contest_id, l_linenumber, CAST(l_shipdate AS DATE) AS dt, l_quantity AS actual, 5.0E0 + l_partkey % 10 AS q10, 12.0E0 + l_partkey % 13 AS q25,
  20.0E0 + l_suppkey % 12 AS q50, 30.0E0 + l_partkey % 9 AS q75, 38.0E0 + l_suppkey % 10 AS q90, 2.5E0 + l_partkey % 60 AS line FROM lineitem"""
LEVELS = {"q10": .10, "q25": .25, "q50": .50, "q75": .75, "q90": .90}
query("pinball_losses", "n monotone_share:d " + " ".join(f"loss_{q}:d" for q in LEVELS), f"""
SELECT count(*) AS n, avg(CASE WHEN q10 <= q25 AND q25 <= q50 AND q50 <= q75 AND q75 <= q90 THEN 1.0 ELSE 0.0 END) AS monotone_share,
  {", ".join(f"avg(greatest({l}E0 * (actual - {q}), ({l}E0 - 1) * (actual - {q}))) AS loss_{q}" for q, l in LEVELS.items())} FROM ({TOTALS}) AS x
""")(lambda t: metrics.pinball_table(t.sql(TOTALS), LEVELS))

query("event_cards", "dt:s n n_priced n_value first_contest last_contest", """
SELECT dt, count(*) AS n, count(odds_red) AS n_priced, count(*) FILTER (p > 0.6 AND odds_red IS NOT NULL) AS n_value, min(contest_id) AS first_contest, max(contest_id) AS last_contest FROM oof GROUP BY dt
""")(lambda t: cards.event_cards(t.oof, C("p") > 0.6))
query("bets_by_event_and_all", "event:s n total:d", """
SELECT coalesce(CAST(dt AS VARCHAR), 'all') AS event, count(*) AS n, sum(CAST(period_ended AS DOUBLE)) AS total FROM oof WHERE p > 0.6 GROUP BY GROUPING SETS ((dt), ())
""")(lambda t: cards.by_event_and_all(t.oof.filter("p > 0.6"), "dt", "period_ended"))
query("career_records", "entity_id record:s", """
SELECT entity_id, concat(CAST(count(*) FILTER (won) AS VARCHAR), '-', CAST(count(*) FILTER (NOT won) AS VARCHAR), '-0') AS record FROM (
  SELECT red_id AS entity_id, coalesce(winner_id = red_id, false) AS won FROM contest UNION ALL SELECT blue_id, coalesce(winner_id = blue_id, false) FROM contest) AS x GROUP BY 1
""")(lambda t: cards.records(t.contest))
query("stored_order_inversions", "n out_of_order", """
SELECT count(*) AS n, count(*) FILTER (dt < top) AS out_of_order FROM (SELECT dt, max(dt) OVER (ORDER BY contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM contest) AS x
""")(lambda t: metrics.out_of_order(t.contest.selectExpr("contest_id AS seq", "dt")))

query("walk_forward_folds", "fold n_train n_calib n_val", """
SELECT y AS fold, count(*) FILTER (yr < y - 1) AS n_train, count(*) FILTER (yr = y - 1) AS n_calib, count(*) FILTER (yr = y) AS n_val FROM oof, (SELECT DISTINCT yr AS y FROM oof) AS f GROUP BY y
""")(lambda t: folds.fold_sizes(t.oof, 0))
query("chronological_split", "contest_id part:s", """
SELECT contest_id, CASE WHEN k <= floor(n * 0.70) THEN 'train' WHEN k <= floor(n * 0.85) THEN 'calibrate' ELSE 'test' END AS part FROM (
  SELECT contest_id, row_number() OVER (ORDER BY dt, contest_id) AS k, count(*) OVER () AS n FROM oof) AS x
""")(lambda t: folds.chronological(t.oof, {"train": 0.70, "calibrate": 0.85}, "test"))
query("decay_weights", "contest_id weight:d", """
SELECT contest_id, pow(0.5, greatest(date_diff('day', dt, (SELECT max(dt) FROM oof)) / 365.25E0, 0) / 6.0E0) AS weight FROM oof
""")(lambda t: folds.decay_weights(t.oof))
query("global_position", "contest_id pos", "SELECT contest_id, row_number() OVER (ORDER BY dt, contest_id) - 1 AS pos FROM oof")(
    lambda t: order.position(t.oof.select("contest_id", "dt"), "contest_id"))
