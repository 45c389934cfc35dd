"""Bet tables, portfolios, grading and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.operators import backtest, grade, insights, portfolio, pricing, totals
from workload.aggregates import CLASS_P
from workload.market import BETS, BUCKETS, PAIRS, TM, TQ, CDF
from workload.registry import query

C = F.col
PRED = f"""SELECT *, p_finish * r1 / s AS p_r1, p_finish * r2 / s AS p_r2, p_finish * r3 / s AS p_r3, p_finish * r4 / s AS p_r4, p_finish * r5 / s AS p_r5 FROM (
  SELECT x.*, o.a_id, o.b_id, concat('Ann Lee', lpad(CAST(a_id AS STRING), 6, '0')) AS a_name, concat('Bo Roe', lpad(CAST(b_id AS STRING), 6, '0')) AS b_name,
    pa_ko + pa_sub + pb_ko + pb_sub AS p_finish, pa_dec + pb_dec AS p_decision, r1 + r2 + r3 + r4 + r5 AS s FROM ({CLASS_P}) AS x JOIN oof o ON o.contest_id = x.contest_id) AS y"""

FIN = "(p_r1 + p_r2 + p_r3 + p_r4 + p_r5)"
C1 = "CASE WHEN is_long = 1 THEN {r} / (p_r1 + p_r2 + p_r3 + p_r4 + p_r5) ELSE {r} / (p_r1 + p_r2 + p_r3) END"
KS = ["KO", "SUB"]


def keys(sides, fins, rounds, dec):
    out = [f"{s}|{m}|{r}" for s in sides for m in fins for r in rounds] + ([f"{s}|DEC|DEC" for s in sides] if dec else [])
    return ",".join(sorted(out))


ALL = range(1, 6)
# market, selection, side, method, rounds, outcome keys, probability; keys None = no bet
SEL = [
    ("moneyline", "'A'", "A", None, None, keys("A", KS, ALL, True), "p"), ("moneyline", "'B'", "B", None, None, keys("B", KS, ALL, True), "1 - p"),
    ("method", "concat(a_name, ' by KO/TKO')", None, None, None, keys("A", ["KO"], ALL, False), "pa_ko"),
    ("method", "concat(b_name, ' by Submission')", None, None, None, keys("B", ["SUB"], ALL, False), "pb_sub"),
    ("method", "concat(a_name, ' by Decision')", None, None, None, keys("A", [], [], True), "pa_dec"), ("method", "'Draw'", None, None, None, None, "0"),
    ("method_neutral", "'KO/TKO'", None, None, None, keys("AB", ["KO"], ALL, False), "pa_ko + pb_ko"),
    ("method_neutral", "'Submission'", None, None, None, keys("AB", ["SUB"], ALL, False), "pa_sub + pb_sub"),
    ("method_neutral", "'Points'", None, None, None, keys("AB", [], [], True), "pa_dec + pb_dec"),
    ("method_combo", "concat(a_name, ' KO/TKO or Submission')", None, None, None, keys("A", KS, ALL, False), "pa_ko + pa_sub"),
    ("method_combo", "concat(b_name, ' Submission or Points')", None, None, None, keys("B", ["SUB"], ALL, True), "pb_sub + pb_dec"),
    ("distance", "'Yes'", None, None, None, keys("AB", [], [], True), "p_decision"), ("distance", "'No'", None, None, None, keys("AB", KS, ALL, False), "p_finish"),
    ("total_rounds", "'Over 2.5 Rounds'", None, None, None, keys("AB", KS, (4, 5), True), "greatest(0, 1 - (p_r1 + p_r2 + p_r3))"),
    ("total_rounds", "'Under 1.5'", None, None, None, keys("AB", KS, (1, 2), False), "p_r1 + p_r2"),
    ("round_survival", "'Start R2 Yes'", None, None, None, keys("AB", KS, (2, 3, 4, 5), True), "1 - p_r1"),
    ("round_survival", "'Start R3 No'", None, None, None, keys("AB", KS, (1, 2), False), "p_r1 + p_r2"),
    ("alt_finish_timing", "'Round 1 or 2'", None, None, None, keys("AB", KS, (1, 2), False), "p_r1 + p_r2"),
    ("alt_finish_timing", "'Round 3 or Decision'", None, None, None, keys("AB", KS, (3, 4, 5), True), "p_r3 + p_r4 + p_r5 + p_decision"),
    ("alt_round", "concat(a_name, ' Round 1 or 2')", None, None, None, keys("A", KS, (1, 2), False), "p * (p_r1 + p_r2)"),
    ("alt_round", "concat(b_name, ' Round 3 or Decision')", None, None, None, keys("B", KS, (3, 4, 5), True), "(1 - p) * (p_r3 + p_r4 + p_r5)"),
    ("winning_round", "concat(a_name, ' to Win in Round 2')", None, None, None, keys("A", KS, (2,), False), "p * p_r2 / p_finish"),
    ("winning_round", "'Round 1'", None, None, None, keys("AB", KS, (1,), False), "p_r1"),
    ("winning_round", "concat(b_name, ' to Win by Decision')", None, None, None, keys("B", [], [], True), "pb_dec"),
    ("winning_round", "concat(a_name, ' Round 2 or by Decision')", None, None, None, keys("A", KS, (2, 3, 4, 5), True), "p * (p_r2 + p_r3 + p_r4 + p_r5) + p * p_decision"),
    ("winning_round", "'2nd Minute of Round 1'", None, None, None, None, "0"),
    ("method_round", "'x'", "A", "KO", [2], keys("A", ["KO"], (2,), False), "pa_ko * " + C1.format(r="p_r2")),
    ("method_round_neutral", "'y'", None, "SUB", [1], keys("AB", ["SUB"], (1,), False), "(pa_sub + pb_sub) * " + C1.format(r="p_r1")),
    ("method_round_range", "'z'", "B", "KO", [1, 2], keys("B", ["KO"], (1, 2), False), "pb_ko * " + C1.format(r="(p_r1 + p_r2)")),
]
PRICE = "1.2E0 + ((contest_id * seq) % 97) / 20.0E0"


def case(col, values):
    return f"CASE {col} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values, 1) if v is not None) + " END"


SHAPE = (f"contest_id, p.period AS seq, {case('p.period', [repr(s[0]) for s in SEL])} AS market, {case('p.period', [s[1] for s in SEL])} AS selection, "
         f"{case('p.period', [repr(s[2]) if s[2] else None for s in SEL])} AS side, {case('p.period', [repr(s[3]) if s[3] else None for s in SEL])} AS method")
QUOTES = f"SELECT contest_id, market, selection, side, method, {case('seq', ['array(' + ', '.join(map(str, s[4])) + ')' if s[4] else None for s in SEL])} AS rounds, {PRICE} AS price FROM (SELECT {SHAPE} FROM ({PRED}) AS d EACH_PERIOD({len(SEL)})) AS u"
BETROWS = f"""pred AS ({PRED}), raw AS (SELECT d.*, seq, {case('seq', [repr(s[0]) for s in SEL])} AS market, {case('seq', [s[1] for s in SEL])} AS selection, {case('seq', [repr(s[5]) if s[5] else None for s in SEL])} AS keys,
  {case('seq', [s[6] for s in SEL])} AS our_prob, {PRICE} AS price FROM pred d, (SELECT unnest(range(1, {len(SEL) + 1})) AS seq) AS s),
valued AS (SELECT contest_id, market, selection, keys, prob AS our_prob, price, 1 / price AS implied, prob - 1 / price AS edge, 100 * (prob * price - 1) AS ev_pct, 100 * greatest(0, ((price - 1) * prob - (1 - prob)) / (price - 1) * 0.25) AS kelly_pct
  FROM (SELECT *, least(our_prob, 0.995) AS prob FROM raw WHERE keys IS NOT NULL AND our_prob > 0 AND price >= 1.05) AS v)"""


def bets(t):
    return pricing.value(pricing.price(t.sql(QUOTES), t.sql(PRED)))


def joined_keys(df):
    return df.withColumn("keys", F.array_join(F.array_sort("outcome_keys"), ","))


query("joint_probabilities", "contest_id side:s method:s round p:d", f"""
WITH pred AS ({PRED}), u AS (SELECT d.*, i, CASE i WHEN 1 THEN p_r1 WHEN 2 THEN p_r2 WHEN 3 THEN p_r3 WHEN 4 THEN p_r4 ELSE p_r5 END AS r FROM pred d, (SELECT unnest(range(1, 6)) AS i) AS z WHERE i <= 3 OR is_long = 1)
SELECT contest_id, side, method, i AS round, w * r / sum(r) OVER (PARTITION BY contest_id, side, method) AS p FROM (
  SELECT contest_id, i, r, 'A' AS side, 'KO' AS method, pa_ko AS w FROM u UNION ALL SELECT contest_id, i, r, 'A', 'SUB', pa_sub FROM u
  UNION ALL SELECT contest_id, i, r, 'B', 'KO', pb_ko FROM u UNION ALL SELECT contest_id, i, r, 'B', 'SUB', pb_sub FROM u) AS q
""")(lambda t: pricing.joint(t.sql(PRED)))
query("outcome_key_sets", "contest_id market:s selection:s keys:s", f"WITH {BETROWS} SELECT contest_id, market, selection, keys FROM valued")(lambda t: joined_keys(bets(t)))
query("priced_selections", "contest_id market:s selection:s our_prob:d price:d", f"WITH {BETROWS} SELECT * FROM raw WHERE keys IS NOT NULL")(
    lambda t: pricing.price(t.sql(QUOTES), t.sql(PRED)))
query("bet_values", "contest_id market:s selection:s our_prob:d implied:d edge:d ev_pct:d kelly_pct:d", f"WITH {BETROWS} SELECT * FROM valued")(bets)

TABLE = "bk AS (SELECT CASE side WHEN 'A' THEN 'method' ELSE 'moneyline' END AS market_class, edge_lo, edge_hi, 100 * sum(pnl) / count(*) AS roi_pct, count(*) AS n FROM bets JOIN " + BUCKETS + " ON edge >= edge_lo AND edge < edge_hi GROUP BY ALL)"
GATED = f"""{BETROWS}, {BETS}, {TABLE}, b1 AS (SELECT *, {"CASE market " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pricing.BACKED_BY.items()) + " END"} AS mc FROM valued),
gated AS (SELECT b1.*, roi_pct AS hist_roi, coalesce(n, 0) AS hist_n, mc = 'moneyline' OR mc IN (SELECT market_class FROM bk) AS backtested,
  ev_pct > 0 AND edge >= 0.03 AND (NOT (mc = 'moneyline' OR mc IN (SELECT market_class FROM bk)) OR coalesce(roi_pct > 5 AND n >= 30, false)) AS is_value
  FROM b1 LEFT JOIN bk ON bk.market_class = mc AND edge >= edge_lo AND edge < edge_hi)"""


def gated(t):
    history = backtest.bets(t.oof).withColumn("market_class", F.when(C("side") == "A", "method").otherwise("moneyline"))
    return pricing.gate(bets(t), backtest.bucket_stats(history, ["market_class"], keep_empty=False))


query("value_gate", "contest_id market:s selection:s backtested is_value hist_roi:d hist_n", f"WITH {GATED} SELECT * FROM gated")(gated)
DEDUP = f"""{GATED}, d1 AS (SELECT *, row_number() OVER (PARTITION BY contest_id, keys ORDER BY ev_pct DESC, market DESC, selection DESC) AS k, max(CASE WHEN is_value THEN 1 ELSE 0 END) OVER (PARTITION BY contest_id, keys) AS any_value,
  count(*) OVER (PARTITION BY contest_id, keys) AS n_merged FROM gated), dedup AS (SELECT * EXCLUDE (is_value), any_value AS is_value FROM d1 WHERE k = 1)"""
query("distinct_outcome_bets", "contest_id market:s selection:s keys:s ev_pct:d is_value n_merged", f"WITH {DEDUP} SELECT * FROM dedup")(lambda t: joined_keys(pricing.dedup(gated(t))))
query("top_value_bets", "contest_id market:s selection:s ev_pct:d", f"WITH {DEDUP} SELECT * FROM dedup WHERE is_value = 1 ORDER BY ev_pct DESC, contest_id, market, selection LIMIT 20")(
    lambda t: pricing.top_value(pricing.dedup(gated(t))))
query("contest_value_display", "contest_id rank market:s payout:d expected:d n_value", f"""
WITH {DEDUP} SELECT * FROM (SELECT contest_id, row_number() OVER (PARTITION BY contest_id ORDER BY ev_pct DESC, market, selection) AS rank, market, (price - 1) * 100 AS payout, (our_prob * price - 1) * 100 AS expected,
  count(*) OVER (PARTITION BY contest_id) AS n_value FROM dedup WHERE is_value = 1) AS x WHERE rank <= 10
""")(lambda t: pricing.display(pricing.dedup(gated(t))))
ROWS = {"a_ko": "pa_ko", "a_sub": "pa_sub", "a_dec": "pa_dec", "b_ko": "pb_ko", "b_sub": "pb_sub", "b_dec": "pb_dec", "decision": "p_decision", **{f"round_{i}": f"p_r{i}" for i in ALL}}
query("probability_rows", "contest_id outcome:s prob:d", f"WITH pred AS ({PRED}) SELECT * FROM (" + " UNION ALL ".join(f"SELECT contest_id, '{k}' AS outcome, {v} AS prob FROM pred" for k, v in ROWS.items()) + ") AS x WHERE prob > 0.005")(
    lambda t: pricing.probability_rows(t.sql(PRED)))
query("priced_totals", "contest_id market:s selection:s our_prob:d price:d target_key:s", f"""
WITH {PAIRS}, m AS ({TM}), r AS (SELECT pairs.*, greatest(0.005, least(0.995, 1 - ({CDF}))) AS po FROM pairs JOIN m ON m.contest_id = pairs.contest_id AND m.market = pairs.market)
SELECT contest_id, market, 'over' AS selection, po AS our_prob, over_price AS price, concat('TOTAL|', market, '|over|', CAST(line AS VARCHAR)) AS target_key FROM r WHERE over_price IS NOT NULL
UNION ALL SELECT contest_id, market, 'under', 1 - po, under_price, concat('TOTAL|', market, '|under|', CAST(line AS VARCHAR)) FROM r WHERE under_price IS NOT NULL
""")(lambda t: pricing.price_totals(totals.pair_quotes(t.sql(TQ)), t.sql(TM)).withColumn("target_key", C("outcome_keys")[0]))

# Legs of a portfolio: four per contest, two of them at odds with each other.
LEGK = [["A|KO|1", "A|KO|2", "A|SUB|1"], ["A|KO|2", "B|KO|1"], ["A|DEC|DEC", "B|DEC|DEC"], ["A|KO|2", "A|DEC|DEC", "B|SUB|1"]]
LEG = "contest_id * 10 + {k} AS bet_id, contest_id AS contest, CAST(dt AS STRING) AS event, 0.3E0 + ((contest_id + {k}) % 40) / 100.0E0 AS our_prob, 1.5E0 + ((contest_id * {k}) % 30) / 10.0E0 AS price, CAST((contest_id * {k}) % 13 AS DOUBLE) * 0.7E0 AS kelly_pct"
LEGS_SPARK = f"SELECT {LEG.format(k='p.period')}, {case('p.period', ['array(' + ', '.join(map(repr, ks)) + ')' for ks in LEGK])} AS outcome_keys FROM oof EACH_PERIOD(4)"
LEGS_TWIN = f"legs AS (SELECT {LEG.format(k='i')}, i, {case('i', ['[' + ', '.join(map(repr, ks)) + ']' for ks in LEGK])} AS outcome_keys FROM oof, (SELECT unnest(range(1, 5)) AS i) AS z)"


def legs(t):
    return t.sql(LEGS_SPARK).withColumn("scope", C("event"))


START = {"kelly": "kelly_pct", "flat": "50.0E0 / count(*) OVER (PARTITION BY event)",
         "concentrated": "CASE WHEN row_number() OVER (PARTITION BY event ORDER BY kelly_pct DESC, bet_id) <= 8 THEN kelly_pct ELSE 0 END"}


def built(strategy):
    """Greedy compatible legs unrolled over the four possible legs, then the caps."""
    kept = ["k0 AS (SELECT event, contest, max(CASE WHEN r = 1 THEN outcome_keys END) AS o1, max(CASE WHEN r = 2 THEN outcome_keys END) AS q2, max(CASE WHEN r = 3 THEN outcome_keys END) AS q3, max(CASE WHEN r = 4 THEN outcome_keys END) AS q4 FROM ranked GROUP BY 1, 2)"]
    for i in (2, 3, 4):
        kept.append(f"k{i - 1} AS (SELECT *, len(list_intersect(o{i - 1}, q{i})) > 0 AS y{i}, CASE WHEN len(list_intersect(o{i - 1}, q{i})) > 0 THEN list_intersect(o{i - 1}, q{i}) ELSE o{i - 1} END AS o{i} FROM k{i - 2})")
    return f"""{LEGS_TWIN}, s0 AS (SELECT *, least({START[strategy]}, 5.0) AS st FROM legs), ranked AS (SELECT *, row_number() OVER (PARTITION BY event, contest ORDER BY st DESC, bet_id) AS r FROM s0 WHERE st > 0),
{", ".join(kept)}, keep AS (SELECT ranked.* FROM ranked JOIN k3 ON k3.event = ranked.event AND k3.contest = ranked.contest WHERE r = 1 OR (r = 2 AND y2) OR (r = 3 AND y3) OR (r = 4 AND y4)),
c1 AS (SELECT *, st * least(1, 15 / sum(st) OVER (PARTITION BY event, contest)) AS st2 FROM keep), c2 AS (SELECT *, round(st2 * least(1, 50 / sum(st2) OVER (PARTITION BY event)), 8) AS st3 FROM c1),
final AS (SELECT event AS scope, contest, bet_id, outcome_keys, floor(st3 * 100 + 0.50001E0) / 100 AS stake_pct, our_prob * price - 1 AS ev_per_unit, price - 1 AS payout FROM c2 WHERE st3 >= 1)"""


query("initial_stakes", "bet_id kelly:d flat:d concentrated:d", f"WITH {LEGS_TWIN} SELECT bet_id, " + ", ".join(f"{v} AS {k}" for k, v in START.items()) + " FROM legs")(
    lambda t: portfolio.initial(legs(t), "kelly").select("bet_id", C("stake").alias("kelly"))
    .join(portfolio.initial(legs(t), "flat").select("bet_id", C("stake").alias("flat")), "bet_id")
    .join(portfolio.initial(legs(t), "concentrated").select("bet_id", C("stake").alias("concentrated")), "bet_id"))
query("compatible_legs", "bet_id", f"WITH {built('kelly')} SELECT bet_id FROM keep")(
    lambda t: portfolio.compatible(portfolio.initial(legs(t), "kelly").withColumn("stake", F.least("stake", F.lit(5.0)))))
query("portfolio_stakes", "scope:s bet_id stake_pct:d2 ev_per_unit:d", f"WITH {built('kelly')} SELECT * FROM final")(lambda t: portfolio.build(legs(t), "kelly"))
SUMMARY = """summary AS (SELECT scope, sum(staked) AS total_stake_pct, sum(expected) AS expected_pnl_pct, sum(best) AS best_case_pct, -sum(staked) AS worst_case_pct, sum(n) AS n_bets, count(*) AS n_contests FROM (
  SELECT f.scope, f.contest, f.staked, f.expected, f.n, b.best FROM (SELECT scope, contest, sum(stake_pct) AS staked, sum(stake_pct * ev_per_unit) AS expected, count(*) AS n FROM final GROUP BY 1, 2) AS f
  JOIN (SELECT scope, contest, max(net) AS best FROM (SELECT u.scope, u.contest, u.key, sum(CASE WHEN list_contains(l.outcome_keys, u.key) THEN stake_pct * payout ELSE -stake_pct END) AS net
    FROM (SELECT DISTINCT scope, contest, unnest(outcome_keys) AS key FROM final) AS u JOIN final l ON l.scope = u.scope AND l.contest = u.contest GROUP BY 1, 2, 3) AS w GROUP BY 1, 2) AS b ON b.scope = f.scope AND b.contest = f.contest) AS g GROUP BY scope)"""
COLS = "scope:s total_stake_pct:d4 expected_pnl_pct:d4 best_case_pct:d4 worst_case_pct:d4 n_bets n_contests"
query("portfolio_summary", COLS, f"WITH {built('kelly')}, {SUMMARY} SELECT * FROM summary")(lambda t: portfolio.summary(portfolio.build(legs(t), "kelly")))
query("portfolio_by_strategy", "strategy:s " + COLS, " UNION ALL ".join(f"SELECT '{s}' AS strategy, * FROM (WITH {built(s)}, {SUMMARY} SELECT * FROM summary) AS q_{s}" for s in START))(
    lambda t: portfolio.by_strategy(legs(t)))
query("bets_in_scopes", "scope:s n kelly:d", f"WITH {LEGS_TWIN} SELECT event AS scope, count(*) AS n, sum(kelly_pct) AS kelly FROM legs GROUP BY 1 UNION ALL SELECT 'all', count(*), sum(kelly_pct) FROM legs")(
    lambda t: portfolio.with_scopes(t.sql(LEGS_SPARK), "event").groupBy("scope").agg(F.count("*").alias("n"), F.sum("kelly_pct").alias("kelly")))

RESULT = """SELECT contest_id, CASE WHEN contest_id % 9 = 0 THEN NULL WHEN label = 1 THEN 'A' ELSE 'B' END AS actual_side, CASE WHEN contest_id % 4 = 0 THEN 'Final' WHEN contest_id % 13 = 0 THEN 'Points' ELSE method END AS m, period_ended FROM oof"""
KEY = "CASE WHEN upper(m) = 'FINAL' OR actual_side IS NULL THEN NULL WHEN m LIKE '%KO%' THEN concat(actual_side, '|KO|', CAST(period_ended AS VARCHAR)) WHEN m LIKE '%SUB%' THEN concat(actual_side, '|SUB|', CAST(period_ended AS VARCHAR)) ELSE concat(actual_side, '|DEC|DEC') END"


def results(t):
    return t.sql(RESULT).withColumn("actual_key", grade.actual_key(C("actual_side"), C("m"), C("period_ended")))


query("actual_outcomes", "contest_id actual_side:s actual_key:s", f"SELECT contest_id, actual_side, {KEY} AS actual_key FROM ({RESULT}) AS r")(results)
STATS = "SELECT contest_id, max(CASE WHEN side = 1 THEN sig_l END) AS a_sig, max(CASE WHEN side = 2 THEN sig_l END) AS b_sig, max(CASE WHEN side = 1 THEN td_l END) AS a_td, max(CASE WHEN side = 2 THEN td_l END) AS b_td, max(CASE WHEN side = 1 THEN kd END) AS a_kd, max(CASE WHEN side = 2 THEN kd END) AS b_kd FROM (SELECT t.*, CASE WHEN t.entity_id = o.a_id THEN 1 ELSE 2 END AS side FROM totals t JOIN oof o ON o.contest_id = t.contest_id) AS x GROUP BY contest_id"
query("actual_totals", "contest_id market:s actual:d", f"""WITH s AS ({STATS}) SELECT contest_id, 'total_sig_strikes_a' AS market, coalesce(a_sig, 0) AS actual FROM s UNION ALL SELECT contest_id, 'total_sig_strikes_b', coalesce(b_sig, 0) FROM s
UNION ALL SELECT contest_id, 'total_sig_strikes_combined', coalesce(a_sig, 0) + coalesce(b_sig, 0) FROM s UNION ALL SELECT contest_id, 'total_takedowns_a', coalesce(a_td, 0) FROM s UNION ALL SELECT contest_id, 'total_takedowns_b', coalesce(b_td, 0) FROM s
UNION ALL SELECT contest_id, 'total_takedowns_combined', coalesce(a_td, 0) + coalesce(b_td, 0) FROM s UNION ALL SELECT contest_id, 'total_knockdowns_combined', coalesce(a_kd, 0) + coalesce(b_kd, 0) FROM s
""")(lambda t: grade.actual_totals(t.sql(STATS)))
GRADED = f"""{GATED}, res AS (SELECT contest_id, actual_side, {KEY} AS actual_key FROM ({RESULT}) AS r),
graded AS (SELECT g.*, CASE WHEN actual_key IS NOT NULL THEN CASE WHEN list_contains(string_split(keys, ','), actual_key) THEN 'won' ELSE 'lost' END
  WHEN actual_side IS NOT NULL THEN CASE WHEN NOT regexp_matches(keys, CASE actual_side WHEN 'A' THEN '(^|,)B' ELSE '(^|,)A' END) THEN 'won' WHEN NOT regexp_matches(keys, concat('(^|,)', actual_side)) THEN 'lost' END END AS result
  FROM gated g LEFT JOIN res ON res.contest_id = g.contest_id)"""


def graded(t):
    return grade.grade(gated(t), results(t), grade.actual_totals(t.sql(STATS)))


query("graded_bets", "contest_id market:s selection:s result:s", f"WITH {GRADED} SELECT * FROM graded")(graded)
query("graded_top_picks", "contest_id pick market:s selection:s result:s", f"WITH {GRADED} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY is_value DESC, ev_pct DESC, market, selection) AS pick FROM graded) AS x WHERE pick <= 5")(
    lambda t: grade.top_picks(graded(t)))
TOTBETS = "SELECT contest_id, 'total_sig_strikes_combined' AS market, CASE WHEN contest_id % 2 = 0 THEN 'over' ELSE 'under' END AS selection, array(concat('TOTAL|total_sig_strikes_combined|', CASE WHEN contest_id % 2 = 0 THEN 'over' ELSE 'under' END, '|', CAST(CAST(20 + contest_id % 40 AS INT) AS STRING))) AS outcome_keys FROM oof"
query("graded_totals", "contest_id result:s", f"""
WITH s AS ({STATS}) SELECT contest_id, CASE WHEN contest_id % 2 = 0 THEN CASE WHEN v > line THEN 'won' ELSE 'lost' END ELSE CASE WHEN v < line THEN 'won' ELSE 'lost' END END AS result FROM (SELECT contest_id, coalesce(a_sig, 0) + coalesce(b_sig, 0) AS v, 20 + contest_id % 40 AS line FROM s) AS y
""")(lambda t: grade.grade(t.sql(TOTBETS), results(t), grade.actual_totals(t.sql(STATS))))
WINNERS = "SELECT contest_id, p, concat('Ann Lee', CAST(a_id AS STRING)) AS a_name, concat('Bo Roe', CAST(b_id AS STRING)) AS b_name, CASE contest_id % 4 WHEN 0 THEN concat('Ann LEE', CAST(a_id AS STRING)) WHEN 1 THEN concat('Roe', CAST(b_id AS STRING)) WHEN 2 THEN 'Nobody Known' ELSE concat('B. Roe', CAST(b_id AS STRING)) END AS winner FROM oof"
query("prediction_correct", "contest_id correct", f"SELECT contest_id, CASE WHEN abs(p - 0.5) < 0.005 OR contest_id % 4 = 2 THEN NULL WHEN contest_id % 4 = 0 THEN p >= 0.5 ELSE NOT p >= 0.5 END AS correct FROM ({WINNERS}) AS w")(
    lambda t: t.sql(WINNERS).select("contest_id", grade.prediction_correct(C("winner"), C("a_name"), C("b_name"), C("p")).alias("correct")))
query("completed_and_open", "dt:s n_done n_open", "SELECT dt, count(*) FILTER (dt < DATE '2000-01-01' OR winner_id IS NOT NULL) AS n_done, count(*) FILTER (NOT (dt < DATE '2000-01-01' OR winner_id IS NOT NULL)) AS n_open FROM contest GROUP BY dt")(
    lambda t: (lambda pair: pair[0].groupBy("dt").agg(F.count("*").alias("n_done")).join(pair[1].groupBy("dt").agg(F.count("*").alias("n_open")), "dt", "full")
               .na.fill(0))(grade.split_events(t.contest, F.lit("2000-01-01").cast("date"))))

FACTS = """SELECT contest_id, CAST(a_id % 40 - b_id % 33 AS DOUBLE) AS diff_elo, CASE WHEN contest_id % 3 = 0 THEN NULL ELSE CAST(a_id % 17 - b_id % 13 AS DOUBLE) END AS diff_slpm, (a_id % 50) / 8.0E0 AS a_slpm, (b_id % 50) / 8.0E0 AS b_slpm,
  (a_id % 10) / 10.0E0 AS a_sig_acc, (b_id % 9) / 10.0E0 AS b_sig_acc, (a_id % 7) / 7.0E0 AS a_sig_str_def, CASE WHEN contest_id % 5 = 0 THEN NULL ELSE (b_id % 7) / 7.0E0 END AS b_sig_str_def, (a_id % 5) / 2.0E0 AS a_td_per_min, (b_id % 5) / 2.0E0 AS b_td_per_min,
  (a_id % 6) / 6.0E0 AS a_td_def, (b_id % 6) / 6.0E0 AS b_td_def, (a_id % 4) / 4.0E0 AS a_finish_rate, (b_id % 4) / 4.0E0 AS b_finish_rate, (a_id % 3) / 3.0E0 AS a_finish_loss_rate, (b_id % 3) / 3.0E0 AS b_finish_loss_rate,
  a_id % 22 AS a_n_contests, b_id % 9 AS b_n_contests, a_id % 2 AS a_never_finished, b_id % 2 AS b_never_finished, (a_id % 8) / 10.0E0 AS a_ko_rate, (b_id % 8) / 10.0E0 AS b_ko_rate, (a_id % 4) / 10.0E0 AS a_ko_loss_rate, (b_id % 4) / 10.0E0 AS b_ko_loss_rate,
  (a_id % 6) / 10.0E0 AS a_sub_rate, (b_id % 6) / 10.0E0 AS b_sub_rate, (a_id % 3) / 10.0E0 AS a_sub_loss_rate, (b_id % 3) / 10.0E0 AS b_sub_loss_rate, 170.0E0 + a_id % 20 AS a_reach_cm, 170.0E0 + b_id % 20 AS b_reach_cm,
  a_id % 6 AS a_win_streak, b_id % 5 AS b_win_streak, 25.0E0 + a_id % 12 AS a_age, 25.0E0 + b_id % 12 AS b_age, (contest_id % 20) / 100.0E0 AS uncertainty, CASE WHEN contest_id % 30 = 0 THEN 1 ELSE 0 END AS a_short_notice, 0 AS b_short_notice FROM oof"""
WEIGHTS = {"elo": 3.1, "slpm": 7.7, "sig_acc": 41.3, "td_def": 23.9, "finish_loss_rate": 19.1, "age": 1.3}
DIFFS = {"elo": "diff_elo", "slpm": "coalesce(diff_slpm, a_slpm - b_slpm)", **{k: f"a_{k} - b_{k}" for k in ("sig_acc", "td_def", "finish_loss_rate", "age")}}
query("top_matchup_factors", "contest_id rank factor:s magnitude:d side:s", f"""
WITH f AS ({FACTS}), l AS ({" UNION ALL ".join(f"SELECT contest_id, '{k}' AS factor, {DIFFS[k]} AS diff, {w}E0 AS w, {'true' if k in insights.LOWER_IS_BETTER else 'false'} AS low FROM f" for k, w in WEIGHTS.items())}),
r AS (SELECT *, abs(diff) * w AS score, row_number() OVER (PARTITION BY contest_id ORDER BY abs(diff) * w DESC, factor) AS rank, max(abs(diff) * w) OVER (PARTITION BY contest_id) AS top FROM l WHERE diff <> 0)
SELECT contest_id, rank, factor, score / top AS magnitude, CASE WHEN (diff > 0) <> low THEN 'a' ELSE 'b' END AS side FROM r WHERE rank <= 3
""")(lambda t: insights.top_factors(t.sql(FACTS), WEIGHTS))
query("stat_gaps", "contest_id stat:s gap_pct:d side:s", f"""
WITH f AS ({FACTS}), l AS ({" UNION ALL ".join(f"SELECT contest_id, {i} AS pos, '{k}' AS stat, a_{k} AS a, b_{k} AS b, {str(h).lower()} AS high FROM f WHERE a_{k} IS NOT NULL AND b_{k} IS NOT NULL" for i, (k, h) in enumerate(insights.BARS.items()))})
SELECT contest_id, stat, least(99, abs(a - b) / greatest(abs(a), abs(b), 1E-6) * 100) AS gap_pct, CASE WHEN CASE WHEN high THEN a >= b ELSE a <= b END THEN 'a' ELSE 'b' END AS side
FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY pos) AS k FROM l) AS x WHERE k <= 6
""")(lambda t: insights.stat_gaps(t.sql(FACTS)))
SCORE = {
    "a_never_finished": "a_never_finished + CASE WHEN a_n_contests >= 5 THEN a_n_contests / 25.0E0 ELSE 0 END", "b_never_finished": "b_never_finished + CASE WHEN b_n_contests >= 5 THEN b_n_contests / 25.0E0 ELSE 0 END",
    "wrestling": "CASE WHEN a_td_per_min > 1.5 AND b_td_def < 0.6 THEN a_td_per_min - 1.0 + (0.6E0 - b_td_def) WHEN b_td_per_min > 1.5 AND a_td_def < 0.6 THEN b_td_per_min - 1.0 + (0.6E0 - a_td_def) ELSE 0 END",
    "striking_volume": "CASE WHEN greatest(a_slpm, b_slpm) >= 4 THEN abs(a_slpm - b_slpm) ELSE 0 END",
    "knockout_threat": "CASE WHEN a_ko_rate >= 0.4 AND b_ko_loss_rate >= 0.2 THEN a_ko_rate + b_ko_loss_rate WHEN b_ko_rate >= 0.4 AND a_ko_loss_rate >= 0.2 THEN b_ko_rate + a_ko_loss_rate ELSE 0 END",
    "experience": "CASE WHEN abs(a_n_contests - b_n_contests) >= 5 AND least(a_n_contests, b_n_contests) <= 5 THEN abs(a_n_contests - b_n_contests) / 10.0E0 ELSE 0 END",
    "reach": "greatest(0, abs(a_reach_cm - b_reach_cm) - 5)", "striking_defence": "CASE WHEN b_sig_str_def IS NOT NULL AND greatest(a_sig_str_def, b_sig_str_def) >= 0.6 THEN abs(a_sig_str_def - b_sig_str_def) ELSE 0 END",
    "streak": "CASE WHEN greatest(a_win_streak, b_win_streak) >= 3 THEN abs(a_win_streak - b_win_streak) ELSE 0 END", "age": "greatest(0, abs(a_age - b_age) - 4)",
    "submission_threat": "greatest(CASE WHEN a_sub_rate > 0.3 AND b_sub_loss_rate > 0.15 THEN a_sub_rate - 0.3E0 + (b_sub_loss_rate - 0.15E0) ELSE 0 END, CASE WHEN b_sub_rate > 0.3 AND a_sub_loss_rate > 0.15 THEN b_sub_rate - 0.3E0 + (a_sub_loss_rate - 0.15E0) ELSE 0 END)",
    "uncertainty": "CASE WHEN uncertainty >= 0.12 THEN uncertainty ELSE 0 END", "short_notice": "a_short_notice"}
query("top_rules", "contest_id rank rule:s score:d", f"""
WITH f AS ({FACTS}), l AS ({" UNION ALL ".join(f"SELECT contest_id, '{k}' AS rule, CAST({v} AS DOUBLE) AS score FROM f" for k, v in SCORE.items())})
SELECT * FROM (SELECT contest_id, row_number() OVER (PARTITION BY contest_id ORDER BY score DESC, rule) AS rank, rule, score FROM l WHERE score > 0) AS x WHERE rank <= 3
""")(lambda t: insights.top_rules(t.sql(FACTS)))
