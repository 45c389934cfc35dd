"""Backtests against closing prices and side-market quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.functions import names, odds
from contestlake.operators import backtest, sidemarkets, totals
from contestlake.plans import report
from workload.aggregates import AUC, CLASS_P, LOSS
from workload.registry import query

C = F.col


def imp(o):
    return f"CASE WHEN {o} >= 0 THEN 100 / ({o} + 100) ELSE -{o} / (100 - {o}) END"


def dec(o):
    return f"CASE WHEN {o} >= 0 THEN {o} / 100 + 1 ELSE 100 / abs({o}) + 1 END"


def kelly(p, d):
    return f"greatest(0, (({d} - 1) * {p} - (1 - {p})) / ({d} - 1) * 0.25)"


AB = "ab AS (SELECT *, CASE a_is_red WHEN 1 THEN odds_red ELSE odds_blue END AS oa, CASE a_is_red WHEN 1 THEN odds_blue ELSE odds_red END AS ob FROM oof)"
BETS = f"""{AB}, f AS (SELECT *, ({imp('oa')}) / (({imp('oa')}) + ({imp('ob')})) AS fa, ({imp('ob')}) / (({imp('ob')}) + ({imp('oa')})) AS fb FROM ab WHERE oa IS NOT NULL AND ob IS NOT NULL),
bets AS (SELECT contest_id, dt, side, our_prob, fair, our_prob - fair AS edge, price, won, CASE WHEN won = 1 THEN price - 1 ELSE -1 END AS pnl FROM (
  SELECT contest_id, dt, CASE WHEN p - fa >= (1 - p) - fb THEN 'A' ELSE 'B' END AS side, CASE WHEN p - fa >= (1 - p) - fb THEN p ELSE 1 - p END AS our_prob,
    CASE WHEN p - fa >= (1 - p) - fb THEN fa ELSE fb END AS fair, CASE WHEN p - fa >= (1 - p) - fb THEN {dec('oa')} ELSE {dec('ob')} END AS price,
    CASE WHEN p - fa >= (1 - p) - fb THEN label ELSE 1 - label END AS won FROM f) AS x)"""
BUCKETS = "(VALUES (-1.0E0, 0.0E0), (0.0E0, 0.02E0), (0.02E0, 0.05E0), (0.05E0, 0.10E0), (0.10E0, 0.20E0), (0.20E0, 1.0E0)) AS k(edge_lo, edge_hi)"

query("oriented_prices", "contest_id odds_a:d odds_b:d", f"WITH {AB} SELECT contest_id, oa AS odds_a, ob AS odds_b FROM ab")(lambda t: backtest.orient(t.oof))
query("closing_line", "n n_priced model_log_loss:d model_log_loss_priced:d line_log_loss:d delta:d beats_line", f"""
WITH {AB}, x AS (SELECT -CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END AS mine, CASE WHEN oa IS NOT NULL AND ob IS NOT NULL THEN 1 END AS priced,
  -CASE WHEN label = 1 THEN ln(({imp('oa')}) / (({imp('oa')}) + ({imp('ob')}))) ELSE ln(1 - ({imp('oa')}) / (({imp('oa')}) + ({imp('ob')}))) END AS line FROM ab)
SELECT count(*) AS n, count(priced) AS n_priced, avg(mine) AS model_log_loss, avg(CASE WHEN priced = 1 THEN mine END) AS model_log_loss_priced, avg(CASE WHEN priced = 1 THEN line END) AS line_log_loss,
  avg(CASE WHEN priced = 1 THEN line END) - avg(mine) AS delta, avg(mine) < avg(CASE WHEN priced = 1 THEN line END) AS beats_line FROM x
""")(lambda t: backtest.closing_line(t.oof))
query("edge_bets", "contest_id side:s our_prob:d fair:d edge:d price:d won pnl:d", f"WITH {BETS} SELECT * FROM bets")(lambda t: backtest.bets(t.oof))
query("edge_buckets", "edge_lo:d edge_hi:d n roi_pct:d win_rate:d avg_price:d avg_edge:d", f"""
WITH {BETS} SELECT edge_lo, edge_hi, count(contest_id) AS n, 100 * sum(pnl) / count(contest_id) AS roi_pct, avg(won) AS win_rate, avg(price) AS avg_price, avg(edge) AS avg_edge
FROM {BUCKETS} LEFT JOIN bets ON edge >= edge_lo AND edge < edge_hi GROUP BY edge_lo, edge_hi
""")(lambda t: backtest.bucket_stats(backtest.bets(t.oof), [], keep_empty=True))
query("kelly_stakes", "contest_id stake:d ev:d", f"WITH {BETS} SELECT contest_id, {kelly('our_prob', 'price')} AS stake, our_prob * price - 1 AS ev FROM bets")(
    lambda t: backtest.bets(t.oof).select("contest_id", odds.kelly_stake(C("our_prob"), C("price")).alias("stake"), odds.expected_value(C("our_prob"), C("price")).alias("ev")))
query("kelly_growth_by_edge", "min_edge:d n_bets log_growth:d win_rate:d", f"""
WITH {BETS} SELECT min_edge, count(*) AS n_bets, sum(ln(1 + {kelly('our_prob', 'price')} * pnl)) AS log_growth, avg(won) AS win_rate
FROM bets JOIN (VALUES (0.0E0), (0.02E0), (0.03E0), (0.05E0), (0.07E0), (0.10E0), (0.15E0)) AS e(min_edge) ON edge >= min_edge GROUP BY min_edge
""")(lambda t: backtest.kelly_curve(backtest.bets(t.oof), []))
query("bankroll_history", "contest_id side:s our_prob:d implied:d edge:d share:d log_growth:d won", f"""
WITH {AB}, y AS (SELECT contest_id, dt, p, label, {dec('oa')} AS d FROM ab WHERE oa IS NOT NULL),
x AS (SELECT contest_id, dt, CASE WHEN p > 1 / d THEN 'A' ELSE 'B' END AS side, CASE WHEN p > 1 / d THEN p ELSE 1 - p END AS our_prob, CASE WHEN p > 1 / d THEN 1 / d ELSE 1 - 1 / d END AS implied,
  CASE WHEN p > 1 / d THEN d ELSE d / (d - 1) END AS price, CASE WHEN p > 1 / d THEN label ELSE 1 - label END AS won FROM y),
z AS (SELECT *, {kelly('our_prob', 'price')} AS share FROM x)
SELECT contest_id, side, our_prob, implied, our_prob - implied AS edge, share, sum(ln(1 + share * CASE WHEN won = 1 THEN price - 1 ELSE -1 END)) OVER (ORDER BY dt, contest_id) AS log_growth, won FROM z
""")(lambda t: backtest.bankroll_history(t.oof))

AMERICAN = "CASE WHEN (contest_id + seq) % 2 = 0 THEN 100 + (contest_id * seq) % 250 ELSE -(110 + (contest_id * seq) % 250) END"
LABELS = ["'Fight goes to decision'", "'Any other result'", "'Over 2½ rounds'", "'Under 2½ rounds'", "concat(red_name, ' wins by TKO/KO')", "'Any other result'",
          "concat(blue_name, ' wins by submission')", "'Fight starts round 3'", "'Fight won''t start round 3'", "concat('Not ', red_name, ' inside distance')",
          "concat(blue_name, ' wins inside distance')", "concat(blue_name, ' wins in round 2')", "'Fight ends in round 1'", "'Fight doesn''t end in round 1'",
          "concat(red_name, ' wins by unanimous decision')", "'Draw'", "'Any other result'"]
NAMED = "SELECT contest_id, a_is_red, concat('Ann Lee', lpad(CAST(CASE a_is_red WHEN 1 THEN a_id ELSE b_id END AS STRING), 6, '0')) AS red_name, concat('Bo Roe', lpad(CAST(CASE a_is_red WHEN 1 THEN b_id ELSE a_id END AS STRING), 6, '0')) AS blue_name FROM oof"
QUOTES = (f"WITH n AS ({NAMED}) SELECT *, CAST({AMERICAN} AS DOUBLE) AS american FROM (SELECT contest_id, p.period AS seq, red_name, blue_name, CASE p.period "
          + " ".join(f"WHEN {i} THEN {label}" for i, label in enumerate(LABELS, start=1)) + f" END AS label FROM n EACH_PERIOD({len(LABELS)})) AS u")
MARKET = ["'distance'", "'distance'", "'total_rounds_2.5'", "'total_rounds_2.5'", "'r_method_KO_TKO'", "'r_method_KO_TKO'", "'b_method_SUB'", "'starts_round_3'", "'starts_round_3'", "'r_inside_distance'",
          "'b_inside_distance'", "'b_wins_round_2'", "'ends_round_1'", "'ends_round_1'", "'r_method_UD'", "NULL", "'r_method_UD'"]
SIDE = ["yes", "no", "over", "under", "yes", "no", "yes", "yes", "no", "no", "yes", "yes", "yes", "no", "yes", None, "no"]
KNOWN = (f"known AS (SELECT *, CAST({AMERICAN} AS DOUBLE) AS american FROM (SELECT contest_id, seq, " + "CASE seq " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(MARKET, 1)) + " END AS market, CASE seq "
         + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SIDE, 1) if s) + f" END AS side FROM oof, (SELECT unnest(range(1, {len(LABELS) + 1})) AS seq) AS s) AS z)")


def classified(t):
    return sidemarkets.classify(t.sql(QUOTES))


def priced(t):
    return sidemarkets.price(classified(t).filter("market IS NOT NULL"), t.sql(CLASS_P))


query("quote_labels", "contest_id seq market:s side:s", f"WITH {KNOWN} SELECT contest_id, seq, market, side FROM known")(classified)
query("market_classes", "market:s market_class:s n", f"""
WITH {KNOWN} SELECT market, CASE WHEN market = 'distance' THEN 'distance' WHEN market LIKE '%inside_distance' THEN 'inside_distance' WHEN contains(market, '_method_') THEN 'method' WHEN contains(market, '_wins_') THEN 'wins_round'
  ELSE regexp_extract(market, '^[a-z]+_rounds?') END AS market_class, count(*) AS n FROM known WHERE market IS NOT NULL GROUP BY ALL
""")(lambda t: classified(t).filter("market IS NOT NULL").groupBy("market", sidemarkets.market_class(C("market")).alias("market_class")).agg(F.count("*").alias("n")))
# r/b letters resolve through the side of red; probabilities and outcomes listed per quote number
PRICED = f"""cp AS ({CLASS_P}), {KNOWN}, q AS (SELECT k.*, CASE a_is_red WHEN 1 THEN pa_ko ELSE pb_ko END AS rko, CASE a_is_red WHEN 1 THEN pa_ko + pa_sub ELSE pb_ko + pb_sub END AS rfin,
  CASE a_is_red WHEN 1 THEN pb_sub ELSE pa_sub END AS bsub, CASE a_is_red WHEN 1 THEN pb_ko + pb_sub ELSE pa_ko + pa_sub END AS bfin, pa_dec + pb_dec AS pdec, r1, r2, r3, method_true LIKE '%DEC' AS was_dec,
  CASE WHEN method_true LIKE '%DEC' THEN 99 ELSE CAST(right(round_true, 1) AS INT) END AS rn, (left(method_true, 1) = 'A') = (a_is_red = 1) AS red_won, substr(method_true, 3) AS how
  FROM known k JOIN cp ON cp.contest_id = k.contest_id WHERE market IS NOT NULL),
priced AS (SELECT *, CASE seq WHEN 1 THEN pdec WHEN 2 THEN 1 - pdec WHEN 3 THEN greatest(0, 1 - (r1 + r2 + r3)) WHEN 4 THEN r1 + r2 + r3 WHEN 5 THEN rko WHEN 6 THEN 1 - rko WHEN 7 THEN bsub
    WHEN 8 THEN 1 - (r1 + r2) WHEN 9 THEN 1 - (1 - (r1 + r2)) WHEN 10 THEN 1 - rfin WHEN 11 THEN bfin WHEN 12 THEN bfin * r2 WHEN 13 THEN r1 WHEN 14 THEN 1 - r1 END AS our_prob,
  CASE seq WHEN 1 THEN was_dec WHEN 2 THEN NOT was_dec WHEN 3 THEN rn > 3 WHEN 4 THEN rn <= 3 WHEN 5 THEN red_won AND how = 'KO_TKO' WHEN 6 THEN NOT (red_won AND how = 'KO_TKO') WHEN 7 THEN NOT red_won AND how = 'SUB'
    WHEN 8 THEN rn >= 3 WHEN 9 THEN rn < 3 WHEN 10 THEN NOT (red_won AND NOT was_dec) WHEN 11 THEN NOT red_won AND NOT was_dec WHEN 12 THEN NOT red_won AND rn = 2 WHEN 13 THEN rn = 1 WHEN 14 THEN rn <> 1 END AS won FROM q)"""
query("side_market_prices", "contest_id seq market:s side:s our_prob:d won", f"WITH {PRICED} SELECT * FROM priced")(priced)
EDGES = f"""{PRICED}, e AS (SELECT *, {dec('american')} AS price, CASE WHEN n2 >= 2 THEN i / s END AS fair, our_prob - CASE WHEN n2 >= 2 THEN i / s ELSE i END AS edge, n2 < 2 AS single FROM (
  SELECT *, {imp('american')} AS i, count(*) OVER w AS n2, sum({imp('american')}) OVER w AS s FROM priced WINDOW w AS (PARTITION BY contest_id, market)) AS x WHERE our_prob IS NOT NULL),
side_bets AS (SELECT *, CASE WHEN won THEN price - 1 ELSE -1 END AS pnl, CASE WHEN market = 'distance' THEN 'distance' WHEN market LIKE '%inside_distance' THEN 'inside_distance' WHEN contains(market, '_method_') THEN 'method'
  WHEN contains(market, '_wins_') THEN 'wins_round' ELSE regexp_extract(market, '^[a-z]+_rounds?') END AS market_class FROM e)"""
query("side_market_edges", "contest_id seq fair:d edge:d single price:d pnl:d", f"WITH {EDGES} SELECT * FROM side_bets")(lambda t: sidemarkets.edges(priced(t)))
query("side_market_buckets", "market_class:s edge_lo:d edge_hi:d n roi_pct:d win_rate:d avg_price:d", f"""
WITH {EDGES} SELECT market_class, edge_lo, edge_hi, count(*) AS n, 100 * sum(pnl) / count(*) AS roi_pct, avg(CASE WHEN won THEN 1.0 ELSE 0.0 END) AS win_rate, avg(price) AS avg_price
FROM side_bets JOIN {BUCKETS} ON edge >= edge_lo AND edge < edge_hi GROUP BY ALL
""")(lambda t: backtest.bucket_stats(sidemarkets.edges(priced(t)), ["market_class"], keep_empty=False))
query("side_market_growth", "market_class:s min_edge:d n_bets log_growth:d", f"""
WITH {EDGES} SELECT market_class, min_edge, count(*) AS n_bets, sum(ln(1 + least({kelly('our_prob', 'price')}, 0.05) * pnl)) AS log_growth
FROM side_bets JOIN (VALUES (0.0E0), (0.02E0), (0.05E0), (0.10E0)) AS m(min_edge) ON edge >= min_edge GROUP BY ALL
""")(lambda t: backtest.kelly_curve(sidemarkets.edges(priced(t)), ["market_class"], backtest.SIDE_MIN_EDGES, cap=backtest.STAKE_CAP))

# Totals quotes: lines around each side's count; some lines are quoted in one direction only.
SIDES = """SELECT contest_id, 'total_sig_strikes_a' AS market, a_quantity AS actual, a_partkey AS k FROM contest UNION ALL SELECT contest_id, 'total_sig_strikes_b', b_quantity, b_partkey FROM contest"""
TQ = f"""SELECT contest_id, market, 10.5E0 + k % 30 AS line, 'over' AS direction, 1.7E0 + (k % 5) / 10.0E0 AS price FROM ({SIDES}) AS s
UNION ALL SELECT contest_id, market, 10.5E0 + k % 30, 'under', 2.3E0 - (k % 5) / 10.0E0 FROM ({SIDES}) AS s WHERE k % 6 <> 0
UNION ALL SELECT contest_id, market, 14.5E0 + k % 30, 'over', 2.2E0 FROM ({SIDES}) AS s WHERE k % 3 = 0"""
TM = f"SELECT contest_id, market, actual, 8.0E0 + k % 5 AS q10, 15.0E0 + k % 6 AS q25, 22.0E0 + k % 7 AS q50, 30.0E0 + k % 8 AS q75, 40.0E0 + k % 9 AS q90 FROM ({SIDES}) AS s"
PAIRS = f"""p0 AS (SELECT contest_id, market, line, max(price) FILTER (direction = 'over') AS over_price, max(price) FILTER (direction = 'under') AS under_price FROM ({TQ}) AS x GROUP BY 1, 2, 3),
pairs AS (SELECT * FROM (SELECT *, max(CASE WHEN over_price IS NOT NULL AND under_price IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY contest_id, market) AS anyfull FROM p0) AS y WHERE anyfull = 0 OR (over_price IS NOT NULL AND under_price IS NOT NULL))"""
query("paired_total_lines", "contest_id market:s line:d over_price:d under_price:d", f"WITH {PAIRS} SELECT * FROM pairs")(lambda t: totals.pair_quotes(t.sql(TQ)))
CDF = """CASE WHEN line <= q10 THEN greatest(0, 0.10 - (q10 - line) / (q25 - q10) * 0.15) WHEN line >= q90 THEN least(1, 0.90 + (line - q90) / (q90 - q75) * 0.15) WHEN line >= q75 THEN 0.75 + (line - q75) / (q90 - q75) * 0.15
  WHEN line >= q50 THEN 0.5 + (line - q50) / (q75 - q50) * 0.25 WHEN line >= q25 THEN 0.25 + (line - q25) / (q50 - q25) * 0.25 ELSE 0.10 + (line - q10) / (q25 - q10) * 0.15 END"""
LEGS = f"""{PAIRS}, m AS ({TM}), r AS (SELECT pairs.*, actual, greatest(0.005, least(0.995, 1 - ({CDF}))) AS po FROM pairs JOIN m ON m.contest_id = pairs.contest_id AND m.market = pairs.market),
l AS (SELECT contest_id, market, line, 'over' AS direction, over_price AS price, po AS our_prob, CASE WHEN under_price IS NULL THEN 1 / over_price ELSE (1 / over_price) / (1 / over_price + 1 / under_price) END AS fair, CASE WHEN actual >= line THEN 1 ELSE 0 END AS won FROM r WHERE over_price IS NOT NULL
  UNION ALL SELECT contest_id, market, line, 'under', under_price, 1 - po, CASE WHEN over_price IS NULL THEN 1 / under_price ELSE (1 / under_price) / (1 / under_price + 1 / over_price) END, CASE WHEN actual < line THEN 1 ELSE 0 END FROM r WHERE under_price IS NOT NULL)"""


def total_bets(t):
    return totals.backtest(totals.pair_quotes(t.sql(TQ)), t.sql(TM))


query("totals_bets", "contest_id market:s line:d direction:s our_prob:d fair:d won edge:d pnl:d", f"WITH {LEGS} SELECT *, our_prob - fair AS edge, CASE WHEN won = 1 THEN price - 1 ELSE -1 END AS pnl FROM l")(total_bets)
query("totals_buckets", "market:s edge_lo:d edge_hi:d n roi_pct:d win_rate:d", f"""
WITH {LEGS} SELECT market, edge_lo, edge_hi, count(*) AS n, 100 * sum(CASE WHEN won = 1 THEN price - 1 ELSE -1 END) / count(*) AS roi_pct, avg(won) AS win_rate
FROM l JOIN {BUCKETS} ON our_prob - fair >= edge_lo AND our_prob - fair < edge_hi GROUP BY ALL
""")(lambda t: backtest.bucket_stats(total_bets(t), ["market"], keep_empty=False))
query("totals_market_coverage", "market:s n", f"""
SELECT m.market, count(x.price) AS n FROM (VALUES ('total_sig_strikes_a'), ('total_sig_strikes_b'), ('total_takedowns_combined')) AS m(market) LEFT JOIN ({TQ}) AS x ON x.market = m.market GROUP BY 1
""")(lambda t: totals.market_coverage(t.sql(TQ), ["total_sig_strikes_a", "total_sig_strikes_b", "total_takedowns_combined"]))

query("kelly_by_name", "entity_id implied:d stake:d", f"""
SELECT s.s_suppkey AS entity_id, 1 / q.price AS implied, {kelly('q.prob', 'q.price')} AS stake FROM supplier s JOIN (
  SELECT lower(replace(s_name, '#', ' ')) AS k, 1.5E0 + s_suppkey % 20 / 10.0E0 AS price, 0.4E0 + s_suppkey % 5 / 10.0E0 AS prob FROM supplier WHERE s_suppkey % 4 <> 1) AS q ON q.k = lower(replace(s.s_name, '#', ' '))
""")(lambda t: report.attach_quotes(t.supplier.selectExpr("s_suppkey AS entity_id", "s_name AS name"), t.sql(
    "SELECT concat('  ', upper(replace(s_name, '#', ' - '))) AS name, 1.5E0 + s_suppkey % 20 / 10.0E0 AS price, 0.4E0 + s_suppkey % 5 / 10.0E0 AS prob FROM supplier WHERE s_suppkey % 4 <> 1")))

query("evaluation_report", "section:s key:s value:d", f"""
WITH {AB}, b AS (SELECT least(floor(p * 10), 9) AS slot, avg(label) AS observed FROM oof GROUP BY 1), auc AS {AUC.format(g="", w="", by="")}
SELECT 'metrics' AS section, 'n' AS key, CAST(count(*) AS DOUBLE) AS value FROM oof UNION ALL SELECT 'metrics', 'log_loss', {LOSS} FROM oof
UNION ALL SELECT 'metrics', 'brier', avg((p - label) * (p - label)) FROM oof UNION ALL SELECT 'metrics', 'accuracy', avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0E0 ELSE 0 END) FROM oof
UNION ALL SELECT 'metrics', 'auc', auc FROM auc UNION ALL SELECT 'reliability', CAST(CAST(slot AS BIGINT) AS VARCHAR), observed FROM b
UNION ALL SELECT 'yearly_log_loss', CAST(yr AS VARCHAR), {LOSS} FROM oof GROUP BY yr
UNION ALL SELECT 'closing_line', 'line_log_loss', avg(-CASE WHEN label = 1 THEN ln(({imp('oa')}) / (({imp('oa')}) + ({imp('ob')}))) ELSE ln(1 - ({imp('oa')}) / (({imp('oa')}) + ({imp('ob')}))) END) FROM ab WHERE oa IS NOT NULL
""")(lambda t: report.evaluation(t.oof))
