"""Feature crossing, reshaping, newcomers' shrinkage, schedule strength and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.operators import asof, cross, history, ratings, schedule
from contestlake.plans import features as plan
from workload.registry import query
from workload.windows import feature_ctes, features

C = F.col
SIDED = """
SELECT contest_id, dt, pool, red_id, blue_id, winner_id, odds_red, odds_blue, red_short_notice, blue_short_notice,
  CASE WHEN left(md5(CAST(contest_id AS VARCHAR)), 1) IN ('0','1','2','3','4','5','6','7') THEN 1 ELSE 0 END AS a_is_red FROM contest
WHERE method IS NOT NULL AND method <> 'NC' AND winner_id IS NOT NULL
"""
AB = f""" sided AS (SELECT *, CASE a_is_red WHEN 1 THEN red_id ELSE blue_id END AS a_id, CASE a_is_red WHEN 1 THEN blue_id ELSE red_id END AS b_id FROM ({SIDED}) AS z)"""


def sided(t):
    return cross.assign_sides(history.eligible(t.contest, 1900))


def with_sides(t):
    return cross.attach_sides(sided(t), features(t))


query("side_assignment", "contest_id a_is_red label a_id b_id a_odds:d b_odds:d a_short_notice b_short_notice", f"""
WITH {AB.strip()}
SELECT contest_id, a_is_red, CASE WHEN winner_id = a_id THEN 1 ELSE 0 END AS label, a_id, b_id,
  CASE a_is_red WHEN 1 THEN odds_red ELSE odds_blue END AS a_odds, CASE a_is_red WHEN 1 THEN odds_blue ELSE odds_red END AS b_odds,
  CASE a_is_red WHEN 1 THEN red_short_notice ELSE blue_short_notice END AS a_short_notice,
  CASE a_is_red WHEN 1 THEN blue_short_notice ELSE red_short_notice END AS b_short_notice FROM sided
""")(sided)

JOINED = "FROM sided s JOIN feat a ON a.entity_id = s.a_id AND a.dt = s.dt JOIN feat b ON b.entity_id = s.b_id AND b.dt = s.dt"
BASE = feature_ctes().rstrip() + "," + AB

query("side_differences", "contest_id " + " ".join(f"diff_{c}:d" for c in cross.DIFFS),
      BASE + "\nSELECT contest_id, " + ", ".join(f"a.{c} - b.{c} AS diff_{c}" for c in cross.DIFFS) + " " + JOINED)(
    lambda t: with_sides(t).select("contest_id", *[cross.difference(c) for c in cross.DIFFS]))

query("side_absolute_rates", "contest_id " + " ".join(f"{s}_{c}:d" for c in cross.ABSOLUTE for s in "ab"),
      BASE + "\nSELECT contest_id, " + ", ".join(f"{s}.{c} AS {s}_{c}" for c in cross.ABSOLUTE for s in "ab") + " " + JOINED)(
    lambda t: with_sides(t).select("contest_id", *[C(f"f{s}.{c}").alias(f"{s}_{c}") for c in cross.ABSOLUTE for s in "ab"]))

PRODUCTS = {"finish_threat": ("{s}.finish_rate * {o}.finish_loss_rate", "{s}_finish_threat"),
            "keep_standing": ("{s}.slpm * {s}.td_def", "{s}_keep_standing"),
            "expected_ko_threat": ("{s}.ko_rate * {o}.ko_loss_rate", "expected_{s}_ko_threat"),
            "expected_sub_threat": ("{s}.sub_rate * {o}.sub_loss_rate", "expected_{s}_sub_threat")}
GATED = {"wrestled_pressure": ("{o}.td_per_min * (1 - {s}.td_def)", "{s}_wrestled_pressure"),
         "expected_strikes_landed": ("{s}.slpm * (1 - {o}.sig_str_def)", "expected_{s}_strikes_landed"),
         "expected_sig_acc": ("{s}.sig_acc * (1 - {o}.sig_str_def)", "expected_{s}_sig_acc"),
         "expected_td_landed": ("{s}.td_per_min * (1 - {o}.td_def)", "expected_{s}_td_landed"),
         "expected_strikes_taken": ("{o}.slpm * (1 - {s}.sig_str_def)", "expected_{s}_strikes_taken")}


def _crosses(name, group):
    cols, sql = ["contest_id"], ["contest_id"]
    for k, (expr, out) in group.items():
        ea, eb = expr.format(s="a", o="b"), expr.format(s="b", o="a")
        cols += [out.format(s="a") + ":d", out.format(s="b") + ":d", f"diff_{k}:d"]
        sql += [f"{ea} AS {out.format(s='a')}", f"{eb} AS {out.format(s='b')}", f"{ea} - {eb} AS diff_{k}"]
    query(name, " ".join(cols), BASE + "\nSELECT " + ", ".join(sql) + " " + JOINED)(
        lambda t: with_sides(t).select("contest_id", *cross.cross_features()))


_crosses("style_products", PRODUCTS)
_crosses("gated_crosses", GATED)

PEAK = """peak AS (SELECT pool, CAST(min_by(age, (-rate, age)) AS BIGINT) AS peak_age FROM (
  SELECT pool, age, avg(won) AS rate FROM (
    SELECT c.pool, floor(date_diff('day', e.dob, c.dt) / 365.25E0) AS age, CASE WHEN c.winner_id = t.entity_id THEN 1 ELSE 0 END AS won
    FROM contest c JOIN totals t ON t.contest_id = c.contest_id JOIN entity e ON e.entity_id = t.entity_id
    WHERE c.method IS NOT NULL AND c.method <> 'NC' AND e.dob IS NOT NULL) AS x GROUP BY pool, age HAVING count(*) >= 10) AS y GROUP BY pool)"""

query("physical_differences", "contest_id a_age:d b_age:d diff_age:d diff_reach_cm:d diff_height_cm:d a_post_peak:d b_post_peak:d diff_post_peak:d "
      "a_southpaw_vs_b_orthodox a_orthodox_vs_b_southpaw both_southpaw", f"""
WITH {AB.strip()}, {PEAK},
w AS (SELECT s.contest_id, date_diff('day', a.dob, s.dt) / 365.25E0 AS a_age, date_diff('day', b.dob, s.dt) / 365.25E0 AS b_age, p.peak_age,
  a.reach_cm - b.reach_cm AS diff_reach_cm, a.height_cm - b.height_cm AS diff_height_cm,
  coalesce(lower(a.stance), '') AS sa, coalesce(lower(b.stance), '') AS sb
  FROM sided s JOIN entity a ON a.entity_id = s.a_id JOIN entity b ON b.entity_id = s.b_id LEFT JOIN peak p ON p.pool = s.pool),
v AS (SELECT *, coalesce(greatest(a_age - peak_age, 0), 0) AS a_post_peak, coalesce(greatest(b_age - peak_age, 0), 0) AS b_post_peak FROM w)
SELECT contest_id, a_age, b_age, a_age - b_age AS diff_age, diff_reach_cm, diff_height_cm,
  CASE WHEN a_age IS NULL THEN 0 ELSE a_post_peak END AS a_post_peak, CASE WHEN b_age IS NULL THEN 0 ELSE b_post_peak END AS b_post_peak,
  CASE WHEN a_age IS NULL THEN 0 ELSE a_post_peak END - CASE WHEN b_age IS NULL THEN 0 ELSE b_post_peak END AS diff_post_peak,
  sa = 'southpaw' AND sb IN ('orthodox', 'switch', '') AS a_southpaw_vs_b_orthodox,
  sb = 'southpaw' AND sa IN ('orthodox', 'switch', '') AS a_orthodox_vs_b_southpaw, sa = 'southpaw' AND sb = 'southpaw' AS both_southpaw FROM v
""")(lambda t: cross.physicals(sided(t), t.entity, cross.peak_ages(cross.age_curve(
    history.entity_history(t.contest, t.totals), t.entity), 10)))

query("mirrored_rows", "contest_id dt:s label a_is_red a_id b_id diff_win_rate:d a_slpm:d b_slpm:d", BASE + f"""
, base AS (SELECT contest_id, s.dt, CASE WHEN winner_id = a_id THEN 1 ELSE 0 END AS label, a_is_red, a_id, b_id, a.win_rate - b.win_rate AS d, a.slpm AS sa, b.slpm AS sb {JOINED})
SELECT contest_id, dt, label, a_is_red, a_id, b_id, d AS diff_win_rate, sa AS a_slpm, sb AS b_slpm FROM base
UNION ALL SELECT contest_id, dt, 1 - label, 1 - a_is_red, b_id, a_id, -d, sb, sa FROM base
""")(lambda t: cross.mirror(with_sides(t).select("contest_id", "dt", "label", "a_is_red", "a_id", "b_id", cross.difference("win_rate"),
                                                 C("fa.slpm").alias("a_slpm"), C("fb.slpm").alias("b_slpm"))))

query("contest_side_rows", "contest_id entity_id opponent_id is_red won", """
SELECT contest_id, red_id AS entity_id, blue_id AS opponent_id, 1 AS is_red, coalesce(winner_id = red_id, false) AS won FROM contest
UNION ALL SELECT contest_id, blue_id, red_id, 0, coalesce(winner_id = blue_id, false) FROM contest
""")(lambda t: history.sides(t.contest, "contest_id", "winner_id").withColumn("won", F.coalesce(C("winner_id") == C("entity_id"), F.lit(False))))

MEANS = """
SELECT pool, avg(CASE WHEN winner_id = t.entity_id THEN 1.0 ELSE 0.0 END) AS win_rate, avg(CASE WHEN regexp_matches(method, 'KO|SUB') THEN 1.0 ELSE 0.0 END) AS finish_rate,
  avg(CASE WHEN method LIKE '%KO%' THEN 1.0 ELSE 0.0 END) AS ko_rate, avg(CASE WHEN method LIKE '%SUB%' AND winner_id = t.entity_id THEN 1.0 ELSE 0.0 END) AS sub_rate,
  sum(sig_l) / (sum(time_ended_sec) / 60.0E0) AS slpm, sum(sig_a) / (sum(time_ended_sec) / 60.0E0) AS sapm, sum(sig_l) / sum(sig_a) AS sig_acc,
  sum(td_l) / (sum(time_ended_sec) / 60.0E0) AS td_per_min, sum(td_l) / sum(td_a) AS td_acc, sum(sub_att) / (sum(time_ended_sec) / 60.0E0) AS sub_per_min,
  sum(ctrl) / sum(time_ended_sec) AS ctrl_ratio
FROM contest c JOIN totals t ON t.contest_id = c.contest_id WHERE method IS NOT NULL GROUP BY pool"""
RATES = " ".join(f"{c}:d" for c in cross.SHRUNK)
query("pool_means", "pool:s " + RATES, MEANS)(lambda t: cross.pool_means(t.contest, t.totals))
query("pool_means_exact_method", "pool:s ko_rate:d finish_rate:d", """
SELECT pool, avg(CASE WHEN method IN ('KO', 'TKO') THEN 1.0 ELSE 0.0 END) AS ko_rate, avg(CASE WHEN method IN ('KO', 'TKO', 'SUB') THEN 1.0 ELSE 0.0 END) AS finish_rate
FROM contest c JOIN totals t ON t.contest_id = c.contest_id WHERE method IS NOT NULL GROUP BY pool
""")(lambda t: cross.pool_means(t.contest, t.totals, finish_by_text=False))

DAY_MEANS = """
SELECT d.pool, d.dt, coalesce(sum(CASE WHEN winner_id = t.entity_id THEN 1.0E0 ELSE 0 END) / nullif(count(t.entity_id), 0), 0) AS win_rate,
  coalesce(sum(sig_l) / nullif(sum(CASE WHEN t.entity_id IS NOT NULL THEN c.time_ended_sec END) / 60.0E0, 0), 0) AS slpm,
  coalesce(sum(td_l) / nullif(sum(td_a), 0), 0) AS td_acc
FROM (SELECT DISTINCT pool, dt FROM contest WHERE method IS NOT NULL) AS d
LEFT JOIN contest c ON c.pool = d.pool AND c.dt < d.dt AND c.method IS NOT NULL LEFT JOIN totals t ON t.contest_id = c.contest_id GROUP BY d.pool, d.dt"""
query("pool_means_prior_days", "pool:s dt:s win_rate:d slpm:d td_acc:d", DAY_MEANS)(lambda t: cross.pool_means_asof(t.contest, t.totals))


def _pulled(c):
    return (f"CASE WHEN n_contests BETWEEN 1 AND 4 THEN coalesce((1 - w) * f.{c} + w * m.{c}, m.{c}) ELSE f.{c} END AS {c}")


query("shrunk_newcomers", "entity_id dt:s pool:s n_contests " + RATES, feature_ctes().rstrip() + f""", means AS ({MEANS}),
wanted AS (SELECT DISTINCT entity_id, dt, pool FROM (SELECT red_id AS entity_id, dt, pool FROM contest UNION ALL SELECT blue_id, dt, pool FROM contest) AS u),
f AS (SELECT wanted.pool, feat.*, 0.3E0 * (1 - n_contests / 5.0E0) AS w FROM wanted JOIN feat ON feat.entity_id = wanted.entity_id AND feat.dt = wanted.dt)
SELECT entity_id, dt, f.pool, n_contests, {", ".join(_pulled(c) for c in cross.SHRUNK)} FROM f LEFT JOIN means m ON m.pool = f.pool
""")(lambda t: cross.shrink(history.sides(t.contest, "dt", "pool").select("entity_id", "dt", "pool").distinct()
                            .join(features(t), ["entity_id", "dt"]), cross.pool_means(t.contest, t.totals)))

# Opponent strength from a table column keeps the rolling part checkable in SQL.
SCORED = """SELECT x.*, 1500.0E0 + s_acctbal / 25.0E0 AS opp_score FROM (
  SELECT contest_id, dt, red_id AS entity_id, blue_id AS opp, CASE WHEN winner_id = red_id THEN 1 ELSE 0 END AS won FROM contest
  UNION ALL SELECT contest_id, dt, blue_id, red_id, CASE WHEN winner_id = blue_id THEN 1 ELSE 0 END FROM contest) AS x JOIN supplier ON s_suppkey = opp"""
query("schedule_strength", "entity_id contest_id sos_opponent:d sos_quality_wins:d sos_quality_losses:d", f"""
WITH r AS ({SCORED}) SELECT entity_id, contest_id, avg(opp_score) OVER w AS sos_opponent, avg(won * (opp_score - 1500) / 200) OVER w AS sos_quality_wins,
  avg((1 - won) * (opp_score - 1500) / 200) OVER w AS sos_quality_losses FROM r
WINDOW w AS (PARTITION BY entity_id ORDER BY dt, contest_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
""")(lambda t: schedule.rolling(t.sql(SCORED)))
LATEST = f"""SELECT entity_id, avg(opp_score) AS sos_opponent, avg(won * (opp_score - 1500) / 200) AS sos_quality_wins, avg((1 - won) * (opp_score - 1500) / 200) AS sos_quality_losses
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY dt DESC, contest_id DESC) AS k FROM ({SCORED}) AS r) AS q WHERE k <= 5 GROUP BY entity_id"""
query("schedule_strength_latest", "entity_id sos_opponent:d sos_quality_wins:d sos_quality_losses:d", LATEST)(lambda t: schedule.latest(t.sql(SCORED)))
query("schedule_strength_lookup", "c_custkey sos_opponent:d sos_quality_wins:d", f"""
SELECT c_custkey, coalesce(nullif(sos_opponent, 0), 1500) AS sos_opponent, coalesce(sos_quality_wins, 0) AS sos_quality_wins
FROM customer LEFT JOIN ({LATEST}) AS l ON l.entity_id = c_custkey * 3
""")(lambda t: schedule.lookup(t.customer.selectExpr("c_custkey", "c_custkey * 3 AS entity_id"), schedule.latest(t.sql(SCORED))))
query("schedule_strength_sides", "contest_id a_sos_opponent:d b_sos_opponent:d diff_sos_quality_wins:d", f"""
WITH r AS (SELECT entity_id, contest_id, avg(opp_score) OVER w AS o, avg(won * (opp_score - 1500) / 200) OVER w AS q FROM ({SCORED}) AS s
  WINDOW w AS (PARTITION BY entity_id ORDER BY dt, contest_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), {AB}
SELECT s.contest_id, a.o AS a_sos_opponent, b.o AS b_sos_opponent, a.q - b.q AS diff_sos_quality_wins
FROM sided s JOIN r a ON a.contest_id = s.contest_id AND a.entity_id = s.a_id JOIN r b ON b.contest_id = s.contest_id AND b.entity_id = s.b_id
""")(lambda t: schedule.attach(schedule.rolling(t.sql(SCORED)), sided(t)))

RATED = "SELECT entity_id, 'SMALL' AS pool, 1400.0E0 + entity_id % 300 AS elo, 1450.0E0 + entity_id % 200 AS glicko, 60.0E0 + entity_id % 250 AS glicko_rd, entity_id % 30 AS n_contests, DATE '1999-06-30' AS last_dt FROM entity WHERE entity_id % 3 <> 0"
query("rating_lookup", "entity_id pool:s dt:s elo:d glicko:d glicko_rd:d n_contests", f"""
SELECT w.entity_id, w.pool, w.dt, coalesce(elo, 1500) AS elo, coalesce(glicko, 1500) AS glicko, coalesce(n_contests, 0) AS n_contests,
  CASE WHEN elo IS NULL THEN 350 WHEN date_diff('day', last_dt, w.dt) > 0 THEN least(350, sqrt(pow(glicko_rd / 173.7177E0, 2) + pow(34.6E0 / 173.7177E0, 2) * (date_diff('day', last_dt, w.dt) / 365.0E0)) * 173.7177E0) ELSE glicko_rd END AS glicko_rd
FROM (SELECT DISTINCT red_id AS entity_id, pool, dt FROM contest) AS w LEFT JOIN ({RATED}) AS r ON r.entity_id = w.entity_id AND r.pool = w.pool
""")(lambda t: ratings.lookup(t.contest.selectExpr("red_id AS entity_id", "pool", "dt").distinct(), t.sql(RATED)))

# Scheduled contests: features as of the day after the last result of the year.
ASKED = """SELECT DISTINCT entity_id, CAST(dt + INTERVAL 1 DAY AS DATE) AS dt FROM (SELECT red_id AS entity_id, dt FROM contest
  UNION ALL SELECT blue_id, dt FROM contest) AS u"""
query("scheduled_features", "contest_id as_of:s a_n_contests b_n_contests diff_win_rate:d diff_l3_win_rate:d diff_l5_slpm:d diff_ewma_win_rate:d diff_td_def:d diff_win_streak",
      feature_ctes(ASKED) + """SELECT c.contest_id, a.dt AS as_of, a.n_contests AS a_n_contests, b.n_contests AS b_n_contests, a.win_rate - b.win_rate AS diff_win_rate,
  a.l3_win_rate - b.l3_win_rate AS diff_l3_win_rate, a.l5_slpm - b.l5_slpm AS diff_l5_slpm, a.ewma_win_rate - b.ewma_win_rate AS diff_ewma_win_rate,
  a.td_def - b.td_def AS diff_td_def, a.win_streak - b.win_streak AS diff_win_streak
FROM contest c JOIN feat a ON a.entity_id = c.red_id AND a.dt = c.dt + INTERVAL 1 DAY JOIN feat b ON b.entity_id = c.blue_id AND b.dt = c.dt + INTERVAL 1 DAY
""")(lambda t: plan.scheduled_features(t.contest.selectExpr("contest_id", "date_add(dt, 1) AS dt", "pool", "red_id AS a_id", "blue_id AS b_id"),
                                       t.contest, t.totals).select(
    "contest_id", C("dt").alias("as_of"), C("fa.n_contests").alias("a_n_contests"), C("fb.n_contests").alias("b_n_contests"),
    *[cross.difference(c) for c in ("win_rate", "l3_win_rate", "l5_slpm", "ewma_win_rate", "td_def", "win_streak")]))

query("age_curve", "pool:s age win_rate:d n", """
SELECT c.pool, floor(date_diff('day', e.dob, c.dt) / 365.25E0) AS age, avg(CASE WHEN c.winner_id = t.entity_id THEN 1.0 ELSE 0.0 END) AS win_rate, count(*) AS n
FROM contest c JOIN totals t ON t.contest_id = c.contest_id JOIN entity e ON e.entity_id = t.entity_id
WHERE c.method IS NOT NULL AND c.method <> 'NC' AND e.dob IS NOT NULL GROUP BY 1, 2
""")(lambda t: cross.age_curve(history.entity_history(t.contest, t.totals), t.entity))
query("peak_ages", "pool:s peak_age", f"WITH {PEAK} SELECT * FROM peak")(
    lambda t: cross.peak_ages(cross.age_curve(history.entity_history(t.contest, t.totals), t.entity), 10))
