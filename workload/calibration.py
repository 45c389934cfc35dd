"""Conformal intervals and reconciled probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.operators import calibrate, reconcile, totals
from workload.aggregates import CLASS_P, TOTALS
from workload.registry import query

C = F.col


def _rank(source, score, g=""):
    """Interpolated order statistic at ceil((n + 1) * 0.9) / n, spelled out by rank."""
    part = f"PARTITION BY {g}" if g else ""
    keep = f"{g}, " if g else ""
    return f"""(SELECT {keep} max(n) AS n, max(CASE WHEN r = lo THEN s END) + (max(CASE WHEN r = least(lo + 1, n - 1) THEN s END) - max(CASE WHEN r = lo THEN s END)) * max(spot - lo) AS q
  FROM (SELECT *, floor(spot) AS lo FROM (SELECT *, (n - 1) * least(ceil((n + 1) * (1 - 0.1E0)) / n, 1) AS spot FROM (
    SELECT {keep} {score} AS s, row_number() OVER ({part} ORDER BY {score}) - 1 AS r, count(*) OVER ({part}) AS n FROM {source}) AS a) AS b) AS c {f"GROUP BY {g}" if g else ""})"""


RES = "abs(label - p)"
SD = "sqrt(greatest(p * (1 - p), 0.01E0))"
query("conformal_halfwidth", "n halfwidth:d", f"SELECT n, q AS halfwidth FROM {_rank('oof', RES)} AS x")(lambda t: calibrate.halfwidth(t.oof))
# pools of the year 1995 are small enough that some fall back
query("conformal_by_pool", "pool:s n halfwidth:d fallback", f"""
WITH x AS (SELECT *, CASE WHEN contest_id % 97 = 0 THEN 'rare' ELSE pool END AS grp FROM oof)
SELECT g.grp AS pool, g.n, CASE WHEN g.n < 50 THEN w.q ELSE g.q END AS halfwidth, g.n < 50 AS fallback FROM {_rank('x', RES, 'grp')} AS g, {_rank('oof', RES)} AS w
""")(lambda t: calibrate.halfwidth_by_group(t.sql("SELECT *, CASE WHEN contest_id % 97 = 0 THEN 'rare' ELSE pool END AS grp FROM oof"), "grp")
     .withColumnRenamed("grp", "pool"))
query("conformal_scaled", "n scaled:d", f"SELECT n, q AS scaled FROM {_rank('oof', f'{RES} / {SD}')} AS x")(lambda t: calibrate.scaled(t.oof))
query("conformal_intervals", "contest_id lo:d hi:d", f"""
SELECT contest_id, greatest(p - x.q * {SD}, 0) AS lo, least(p + x.q * {SD}, 1) AS hi FROM oof, {_rank('oof', f'{RES} / {SD}')} AS x
""")(lambda t: calibrate.intervals(t.oof, "pool", calibrate.scaled(t.oof), calibrate.halfwidth_by_group(t.oof, "pool"), calibrate.halfwidth(t.oof)))
query("conformal_group_intervals", "contest_id lo:d hi:d", f"""
SELECT contest_id, greatest(p - CASE WHEN g.n < 50 THEN w.q ELSE g.q END, 0) AS lo, least(p + CASE WHEN g.n < 50 THEN w.q ELSE g.q END, 1) AS hi
FROM oof JOIN {_rank('oof', RES, 'pool')} AS g ON g.pool = oof.pool, {_rank('oof', RES)} AS w
""")(lambda t: calibrate.intervals(t.oof, "pool", None, calibrate.halfwidth_by_group(t.oof, "pool"), calibrate.halfwidth(t.oof)))

query("reconciled_classes", "contest_id pa_ko:d4 pa_sub:d4 pa_dec:d4 pb_ko:d4 pb_sub:d4 pb_dec:d4 p_finish:d4 p_decision:d4 p_r1:d4", f"""
WITH cp AS ({CLASS_P}), k AS (SELECT contest_id, r1 / (r1 + r2 + r3 + r4 + r5) AS c1, 0.9E0 * p AS pw, p * pa_ko / (pa_ko + pa_sub + pa_dec) * 0.9E0 AS a1, p * pa_sub / (pa_ko + pa_sub + pa_dec) * 0.9E0 AS a2, p * pa_dec / (pa_ko + pa_sub + pa_dec) * 0.9E0 AS a3,
  (1 - 0.9E0 * p) * pb_ko / (pb_ko + pb_sub + pb_dec) AS b1, (1 - 0.9E0 * p) * pb_sub / (pb_ko + pb_sub + pb_dec) AS b2, (1 - 0.9E0 * p) * pb_dec / (pb_ko + pb_sub + pb_dec) AS b3 FROM cp)
SELECT contest_id, a1 AS pa_ko, a2 AS pa_sub, a3 AS pa_dec, b1 AS pb_ko, b2 AS pb_sub, b3 AS pb_dec, a1 + a2 + b1 + b2 AS p_finish, a3 + b3 AS p_decision, c1 * (a1 + a2 + b1 + b2) AS p_r1 FROM k
""")(lambda t: reconcile.scale_to_winner(t.sql(CLASS_P).withColumn("p", C("p") * 0.9)))

query("heuristic_classes", "contest_id pa_ko:d4 pa_sub:d4 pa_dec:d4 pb_dec:d4 p_finish:d4 p_decision:d4 p_r1:d4 p_r5:d4", """
SELECT contest_id, k / t * p AS pa_ko, s / t * p AS pa_sub, d / t * p AS pa_dec, d / t * (1 - p) AS pb_dec, (k + s) / t AS p_finish, d / t AS p_decision,
  CASE is_long WHEN 1 THEN 0.26E0 ELSE 0.38E0 END * (k + s) / t AS p_r1, CASE is_long WHEN 1 THEN 0.16E0 ELSE 0 END * (k + s) / t AS p_r5 FROM (
  SELECT *, greatest(0.01, 1 - k - s) AS d, k + s + greatest(0.01, 1 - k - s) AS t FROM (
    SELECT contest_id, p, is_long, CASE WHEN contest_id % 4 = 0 THEN 0.28E0 + least(greatest((p - 0.5) * 0.5, -0.12), 0.12) ELSE ((contest_id % 10) / 20.0E0 + (contest_id % 6) / 12.0E0) / 2 END AS k,
      CASE WHEN contest_id % 4 = 0 THEN 0.12E0 + least(greatest((0.5 - p) * 0.5, -0.06), 0.06) ELSE 0.12E0 END AS s FROM oof) AS x) AS y
""")(lambda t: reconcile.from_rates(t.sql("""SELECT contest_id, p, is_long, CASE WHEN contest_id % 4 <> 0 THEN (contest_id % 10) / 20.0E0 END AS a_ko_rate, CASE WHEN contest_id % 4 <> 0 THEN (contest_id % 6) / 12.0E0 END AS b_ko_rate,
   CAST(NULL AS DOUBLE) AS a_sub_rate, CAST(NULL AS DOUBLE) AS b_sub_rate, p - 0.5 AS diff_ko_rate, 0.5 - p AS diff_sub_rate FROM oof""")))

MONO = f"""SELECT contest_id, l_linenumber, actual, line, q10, greatest(q10, q25) AS q25, greatest(q10, q25, q50) AS q50, greatest(q10, q25, q50, q75) AS q75, greatest(q10, q25, q50, q75, q90) AS q90 FROM ({TOTALS}) AS x"""
query("monotone_quantiles", "contest_id q10:d q25:d q50:d q75:d q90:d estimate:d", f"""
SELECT *, (q10 + q25 + q50 + q75 + q90) / 5 AS estimate FROM ({MONO}) AS m
""")(lambda t: totals.monotone(t.sql(TOTALS)))
OVER = """CASE WHEN line <= q10 THEN greatest(0, 0.10 - (q10 - line) / greatest(CASE WHEN q25 > q10 THEN q25 - q10 ELSE 1.0 END, 1E-6) * 0.15)
  WHEN line >= q90 THEN least(1, 0.90 + (line - q90) / greatest(CASE WHEN q90 > q75 THEN q90 - q75 ELSE 1.0 END, 1E-6) * 0.15)
  WHEN line >= q75 THEN CASE WHEN q90 - q75 < 1E-9 THEN 0.9 ELSE 0.75 + (line - q75) / (q90 - q75) * 0.15 END
  WHEN line >= q50 THEN CASE WHEN q75 - q50 < 1E-9 THEN 0.75 ELSE 0.5 + (line - q50) / (q75 - q50) * 0.25 END
  WHEN line >= q25 THEN CASE WHEN q50 - q25 < 1E-9 THEN 0.5 ELSE 0.25 + (line - q25) / (q50 - q25) * 0.25 END
  ELSE CASE WHEN q25 - q10 < 1E-9 THEN 0.25 ELSE 0.10 + (line - q10) / (q25 - q10) * 0.15 END END"""
query("over_probability", "contest_id line:d p_over:d", f"SELECT contest_id, line, greatest(0.005, least(0.995, 1 - ({OVER}))) AS p_over FROM ({MONO}) AS m")(
    lambda t: totals.monotone(t.sql(TOTALS)).select("contest_id", "line", totals.over_probability(C("line")).alias("p_over")))
