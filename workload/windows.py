"""As-of windows: strictly-prior features of each entity and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.operators import asof, history
from contestlake.operators.history import sides
from workload.registry import query

# History of each (entity, day) by a plain self join: slow, but independent of the windows.
HIST = """
WITH h AS (
  SELECT t.contest_id, t.entity_id, c.dt, c.pool, t.kd, t.sig_l, t.sig_a, t.td_l, t.td_a, t.sub_att, t.ctrl,
    o.td_l AS opp_td_l, o.td_a AS opp_td_a, o.sig_l AS opp_sig_l, o.sig_a AS opp_sig_a,
    CASE WHEN c.winner_id = t.entity_id THEN 1 ELSE 0 END AS won,
    CASE WHEN c.method LIKE '%KO%' THEN 1 ELSE 0 END AS ko,
    CASE WHEN c.method LIKE '%SUB%' THEN 1 ELSE 0 END AS sub,
    greatest(c.time_ended_sec, 30) AS sec
  FROM contest c JOIN totals t ON t.contest_id = c.contest_id
  LEFT JOIN totals o ON o.contest_id = t.contest_id AND o.entity_id <> t.entity_id
  WHERE c.method IS NOT NULL AND c.method <> 'NC'),
ask AS (ASKED),
j AS (
  SELECT a.entity_id, a.dt, h.* EXCLUDE (entity_id, dt), h.dt AS hdt,
    row_number() OVER (PARTITION BY a.entity_id, a.dt ORDER BY h.dt DESC, h.contest_id DESC) AS k
  FROM ask a LEFT JOIN h ON h.entity_id = a.entity_id AND h.dt < a.dt)
"""


BOTH_SIDES = """SELECT DISTINCT entity_id, dt FROM (SELECT red_id AS entity_id, dt FROM contest
        UNION ALL SELECT blue_id, dt FROM contest) AS u"""
PARTS = []


def feature_ctes(asked: str = BOTH_SIDES) -> str:
    """All as-of features of the asked (entity, day) pairs, as CTEs ending in ``feat``."""
    return (HIST.replace("ASKED", asked).rstrip() + ",\nfeat AS (SELECT entity_id, dt, " + ", ".join(PARTS)
            + " FROM j GROUP BY entity_id, dt)\n")


def features(t):
    hist = history.entity_history(t.contest, t.totals)
    ask = sides(t.contest, "dt").select("entity_id", "dt").distinct()
    return asof.entity_asof(hist, ask)


def _asof(name, cols, select):
    PARTS.append(select)
    query(name, "entity_id dt:s " + cols, HIST.replace("ASKED", BOTH_SIDES) + f"SELECT entity_id, dt, {select} FROM j GROUP BY entity_id, dt")(features)


_asof("asof_career_rates", "n_contests wins losses win_rate:d finish_rate:d ko_rate:d sub_rate:d", """
  count(contest_id) AS n_contests, coalesce(sum(won), 0) AS wins, count(contest_id) - coalesce(sum(won), 0) AS losses,
  avg(won) AS win_rate, avg(greatest(ko, sub)) AS finish_rate, avg(ko) AS ko_rate, avg(sub * won) AS sub_rate""")

_asof("asof_minute_rates", "slpm:d sapm:d sig_acc:d td_per_min:d td_acc:d sub_per_min:d ctrl_ratio:d", """
  sum(sig_l) / (sum(sec) / 60.0E0) AS slpm, sum(sig_a) / (sum(sec) / 60.0E0) AS sapm,
  CASE WHEN count(contest_id) > 0 THEN coalesce(sum(sig_l) / nullif(sum(sig_a), 0), 0) END AS sig_acc,
  sum(td_l) / (sum(sec) / 60.0E0) AS td_per_min,
  CASE WHEN count(contest_id) > 0 THEN coalesce(sum(td_l) / nullif(sum(td_a), 0), 0) END AS td_acc,
  sum(sub_att) / (sum(sec) / 60.0E0) AS sub_per_min, sum(ctrl) / sum(sec) AS ctrl_ratio""")

_asof("asof_defence", "td_def:d sig_str_def:d sig_abs_per_min:d", """
  1 - sum(opp_td_l) / nullif(sum(opp_td_a), 0) AS td_def, 1 - sum(opp_sig_l) / nullif(sum(opp_sig_a), 0) AS sig_str_def,
  CASE WHEN count(contest_id) > 0 THEN coalesce(sum(opp_sig_l), 0) / (sum(sec) / 60.0E0) END AS sig_abs_per_min""")

_asof("asof_durability", "ko_loss_rate:d sub_loss_rate:d finish_loss_rate:d never_finished", """
  avg(ko * (1 - won)) AS ko_loss_rate, avg(sub * (1 - won)) AS sub_loss_rate,
  avg(greatest(ko, sub) * (1 - won)) AS finish_loss_rate,
  CASE WHEN count(contest_id) > 0 AND sum(greatest(ko, sub) * (1 - won)) = 0 THEN 1 ELSE 0 END AS never_finished""")

_asof("asof_recent_form", "l3_win_rate:d l5_win_rate:d l3_finish_rate:d l3_kd l3_td_rate:d l3_slpm:d l5_slpm:d", """
  avg(won) FILTER (k <= 3) AS l3_win_rate, avg(won) FILTER (k <= 5) AS l5_win_rate,
  avg(greatest(ko, sub)) FILTER (k <= 3) AS l3_finish_rate, coalesce(sum(kd) FILTER (k <= 3), 0) AS l3_kd,
  CASE WHEN count(contest_id) > 0 THEN coalesce(sum(td_l) FILTER (k <= 3) / nullif(sum(td_a) FILTER (k <= 3), 0), 0) END AS l3_td_rate,
  sum(sig_l) FILTER (k <= 3) / (sum(sec) FILTER (k <= 3) / 60.0E0) AS l3_slpm,
  sum(sig_l) FILTER (k <= 5) / (sum(sec) FILTER (k <= 5) / 60.0E0) AS l5_slpm""")

_asof("asof_decayed_form", "ewma_win_rate:d ewma_finish_rate:d ewma_slpm:d ewma_kd_per_contest:d", """
  sum(won * pow(0.5E0, (k - 1) / 3.0E0)) / sum(CASE WHEN won IS NOT NULL THEN pow(0.5E0, (k - 1) / 3.0E0) END) AS ewma_win_rate,
  sum(greatest(ko, sub) * pow(0.5E0, (k - 1) / 3.0E0)) / sum(CASE WHEN ko IS NOT NULL THEN pow(0.5E0, (k - 1) / 3.0E0) END) AS ewma_finish_rate,
  sum(sig_l / (sec / 60.0E0) * pow(0.5E0, (k - 1) / 3.0E0)) / sum(CASE WHEN sig_l IS NOT NULL THEN pow(0.5E0, (k - 1) / 3.0E0) END) AS ewma_slpm,
  sum(kd * pow(0.5E0, (k - 1) / 3.0E0)) / sum(CASE WHEN kd IS NOT NULL THEN pow(0.5E0, (k - 1) / 3.0E0) END) AS ewma_kd_per_contest""")

_asof("asof_streaks", "win_streak loss_streak", """
  coalesce(min(k) FILTER (won = 0) - 1, count(contest_id)) AS win_streak,
  coalesce(min(k) FILTER (won = 1) - 1, count(contest_id)) AS loss_streak""")

_asof("asof_activity", "days_since_last freq_24m:d", """
  date_diff('day', max(hdt), dt) AS days_since_last,
  count(CASE WHEN hdt >= dt - INTERVAL 24 MONTH THEN 1 END) / 2.0E0 AS freq_24m""")

query("asof_debuts", "entity_id dt:s n_contests l3_kd win_streak loss_streak freq_24m:d never_finished rate_is_null", """
SELECT entity_id, min(dt) AS dt, 0 AS n_contests, 0 AS l3_kd, 0 AS win_streak, 0 AS loss_streak, 0 AS freq_24m,
  0 AS never_finished, 1 AS rate_is_null
FROM (SELECT red_id AS entity_id, dt FROM contest UNION ALL SELECT blue_id, dt FROM contest) AS u
GROUP BY entity_id
UNION ALL
SELECT u.entity_id, u.dt, 0, 0, 0, 0, 0, 0, 1
FROM (SELECT DISTINCT entity_id, dt FROM (SELECT red_id AS entity_id, dt FROM contest UNION ALL SELECT blue_id, dt FROM contest) AS x) AS u
JOIN (SELECT entity_id, min(dt) AS d0 FROM (SELECT red_id AS entity_id, dt FROM contest UNION ALL SELECT blue_id, dt FROM contest) AS x GROUP BY entity_id) AS f
  ON f.entity_id = u.entity_id AND u.dt > f.d0
WHERE NOT EXISTS (SELECT 1 FROM totals t JOIN contest c ON c.contest_id = t.contest_id
  WHERE t.entity_id = u.entity_id AND c.dt < u.dt AND c.method IS NOT NULL AND c.method <> 'NC')
""")(lambda t: features(t).filter("n_contests = 0").withColumn("rate_is_null", F.col("win_rate").isNull().cast("int")))
