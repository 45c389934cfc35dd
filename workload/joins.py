"""Joins and exact entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.functions import names
from contestlake.operators import history, resolve
from workload.registry import query
from workload.windows import HIST

C = F.col

query("own_and_opposing_totals", "contest_id entity_id kd sig_l opp_sig_l opp_td_a won finish sec", HIST.replace("ASKED", "SELECT 1 AS entity_id, DATE '1990-01-01' AS dt").split("ask AS")[0].rstrip().rstrip(",")
      + " SELECT *, greatest(ko, sub) AS finish FROM h")(lambda t: history.entity_history(t.contest, t.totals))

BOUTS = "SELECT contest_id, concat(upper(r.s_name), ' ') AS red, replace(b.s_name, '#', '  ') AS blue FROM contest JOIN supplier r ON r.s_suppkey = red_id LEFT JOIN supplier b ON b.s_suppkey = blue_id AND contest_id % 8 <> 0"
query("sides_by_name", "contest_id red_id blue_id", "SELECT contest_id, red_id, CASE WHEN contest_id % 8 <> 0 THEN blue_id END AS blue_id FROM contest")(
    lambda t: resolve.by_name(t.sql(BOUTS), t.entity, "red", "blue"))
query("new_orders_only", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")(
    lambda t: resolve.missing(t.orders, t.lineitem.filter("l_quantity > 30").selectExpr("l_orderkey AS o_orderkey"), "o_orderkey"))
query("idempotent_load", "kind:s n digest", """
SELECT 'entities' AS kind, count(*) AS n, sum(s_suppkey) AS digest FROM supplier UNION ALL SELECT 'contests', count(*), sum(contest_id) FROM contest
UNION ALL SELECT 'totals', count(*), sum(contest_id) FROM totals
""")(lambda t: _load(t))


def _load(t):
    ent, con, tot = t.entity, t.contest, t.totals.drop("dt", "period_ended")
    out = resolve.load_steps([ent, con, tot], [ent.filter("entity_id % 2 = 0"), con.filter("yr < 1999"), tot.filter("contest_id % 3 = 0")],
                             [["entity_id"], ["contest_id"], ["contest_id", "entity_id"]])
    sums = [d.agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.sum(c).alias("digest"))
            for d, k, c in zip(out, ("entities", "contests", "totals"), ("entity_id", "contest_id", "contest_id"))]
    return sums[0].unionByName(sums[1]).unionByName(sums[2])


query("enriched_entities", "s_suppkey nation:s region:s", """
SELECT s_suppkey, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 5 <> 0 LEFT JOIN region ON r_regionkey = n_regionkey
""")(lambda t: t.supplier.join(t.nation.filter("n_nationkey % 5 <> 0"), C("s_nationkey") == C("n_nationkey"), "left")
     .join(t.region, C("n_regionkey") == C("r_regionkey"), "left").select("s_suppkey", C("n_name").alias("nation"), C("r_name").alias("region")))
query("stats_to_contest_by_event_and_bout", "contest_id entity_id sig_l", """
SELECT c.contest_id, t.entity_id, t.sig_l FROM totals t JOIN contest c ON CAST(c.dt AS VARCHAR) = CAST(t.dt AS VARCHAR) AND c.contest_id = t.contest_id
""")(lambda t: t.totals.selectExpr("string(dt) AS event", "string(contest_id) AS bout", "entity_id", "sig_l")
     .join(t.contest.selectExpr("contest_id", "string(dt) AS event", "string(contest_id) AS bout"), ["event", "bout"]))

QUOTED = """SELECT c.contest_id AS quote_id, CAST(c.dt AS DATE) + CAST(c.contest_id % 6 - 2 AS INT) AS dt, CASE WHEN c.contest_id % 2 = 0 THEN r.s_name ELSE lower(b.s_name) END AS name1, CASE WHEN c.contest_id % 2 = 0 THEN b.s_name ELSE upper(r.s_name) END AS name2,
  CASE WHEN c.contest_id % 2 = 0 THEN c.odds_red ELSE c.odds_blue END AS price1, CASE WHEN c.contest_id % 2 = 0 THEN c.odds_blue ELSE c.odds_red END AS price2 FROM contest c JOIN supplier r ON r.s_suppkey = red_id JOIN supplier b ON b.s_suppkey = blue_id"""
NAMED = "SELECT contest_id, dt, red_id, blue_id, winner_id, r.s_name AS red_name, b.s_name AS blue_name FROM contest JOIN supplier r ON r.s_suppkey = red_id JOIN supplier b ON b.s_suppkey = blue_id"
HITS = f"""q AS (SELECT *, concat(least(lower(name1), lower(name2)), '|', greatest(lower(name1), lower(name2))) AS pk FROM ({QUOTED}) AS x), n AS (SELECT *, concat(least(lower(red_name), lower(blue_name)), '|', greatest(lower(red_name), lower(blue_name))) AS pk FROM ({NAMED}) AS y),
hit AS (SELECT * FROM (SELECT quote_id, contest_id, name1, red_name, price1, price2, abs(date_diff('day', q.dt, n.dt)) AS gap, row_number() OVER (PARTITION BY quote_id ORDER BY abs(date_diff('day', q.dt, n.dt)), contest_id) AS k
  FROM q JOIN n ON n.pk = q.pk AND abs(date_diff('day', q.dt, n.dt)) <= 3) AS z WHERE k = 1)"""
query("prices_by_pair_and_window", "quote_id contest_id gap flipped price_red:d price_blue:d", f"""
WITH {HITS} SELECT quote_id, contest_id, gap, lower(name1) <> lower(red_name) AS flipped, CASE WHEN lower(name1) = lower(red_name) THEN price1 ELSE price2 END AS price_red, CASE WHEN lower(name1) = lower(red_name) THEN price2 ELSE price1 END AS price_blue FROM hit
""")(lambda t: resolve.attach_prices(t.sql(QUOTED), t.sql(NAMED)))
query("canonical_quote_markets", "contest_id market:s n", f"""
WITH {HITS} SELECT contest_id, CASE WHEN i = 3 THEN 'distance' ELSE concat(CASE WHEN (lower(name1) = lower(red_name)) = (i = 1) THEN 'r' ELSE 'b' END, '_method_SUB') END AS market, count(*) AS n FROM hit, (SELECT unnest([1, 2, 3]) AS i) AS s GROUP BY ALL
""")(lambda t: resolve.attach_prices(t.sql(QUOTED), t.sql(NAMED)).withColumn("m", F.explode(F.array(*[F.lit(m) for m in ("f1_method_SUB", "f2_method_SUB", "distance")])))
     .groupBy("contest_id", resolve.canonical_market(C("m"), C("flipped")).alias("market")).agg(F.count("*").alias("n")))
query("nearest_order_of_customer", "o_orderkey near_key gap", """
SELECT * FROM (SELECT a.o_orderkey, b.o_orderkey AS near_key, abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) AS gap,
  row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))), b.o_orderkey) AS k
  FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderstatus = 'F' AND a.o_orderstatus = 'O' AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 30) AS x WHERE k = 1
""")(lambda t: resolve.nearest(resolve.near_days(
    t.orders.filter("o_orderstatus = 'O'").selectExpr("o_orderkey", "o_custkey", "date(o_orderdate) AS dt"),
    t.orders.filter("o_orderstatus = 'F'").selectExpr("o_orderkey", "o_custkey", "date(o_orderdate) AS dt"), ["o_custkey"], 30), "o_orderkey", "r_o_orderkey")
    .selectExpr("o_orderkey", "r_o_orderkey AS near_key", "gap"))

RECORDS = """SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey AS STRING) END AS source_id, CASE s_suppkey % 4 WHEN 1 THEN upper(s_name) WHEN 2 THEN concat('S. ', substr(s_name, 10)) WHEN 3 THEN 'Nobody X' ELSE 'zz' END AS name,
  DATE '1970-01-01' + CAST(s_suppkey % 50 AS INT) AS dob FROM supplier"""
KNOWN = "SELECT s_suppkey AS entity_id, CAST(s_suppkey AS STRING) AS source_id, s_name AS full_name, DATE '1970-01-01' + CAST(s_suppkey % 50 AS INT) AS dob FROM supplier"
query("priority_matches", "record_id entity_id rule", f"""
SELECT record_id, record_id AS entity_id, CASE record_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rule FROM ({RECORDS}) AS r WHERE record_id % 4 <> 3
""")(lambda t: resolve.by_priority(t.sql(RECORDS), t.sql(KNOWN))[0])
query("priority_review", "record_id name:s", f"SELECT record_id, name FROM ({RECORDS}) AS r WHERE record_id % 4 = 3")(lambda t: resolve.by_priority(t.sql(RECORDS), t.sql(KNOWN))[1])

query("labelled_matrix", "contest_id label period_ended method:s", "SELECT o.contest_id, label, c.period_ended, c.method FROM oof o JOIN contest c ON c.contest_id = o.contest_id")(
    lambda t: t.oof.select("contest_id", "label").join(t.contest.select("contest_id", "period_ended", "method"), "contest_id"))
query("totals_by_side", "contest_id a_sig_l b_sig_l both_sig_l both_td_l both_kd", """
SELECT o.contest_id, a.sig_l AS a_sig_l, b.sig_l AS b_sig_l, a.sig_l + b.sig_l AS both_sig_l, a.td_l + b.td_l AS both_td_l, a.kd + b.kd AS both_kd
FROM oof o JOIN totals a ON a.contest_id = o.contest_id AND a.entity_id = o.a_id JOIN totals b ON b.contest_id = o.contest_id AND b.entity_id = o.b_id
""")(lambda t: resolve.side_totals(t.oof, t.totals, ["sig_l", "td_l", "kd"]))
TWICE = "SELECT contest_id, a_is_red, p FROM oof UNION ALL SELECT contest_id, 1 - a_is_red, 1 - p FROM oof"
query("red_half_of_oof", "contest_id a_is_red p:d method:s", "SELECT contest_id, 1 AS a_is_red, CASE a_is_red WHEN 1 THEN p ELSE 1 - p END AS p, method FROM oof")(
    lambda t: resolve.one_per_contest(t.sql(TWICE), red_only=True).join(t.oof.select("contest_id", "method"), "contest_id"))

FIXES = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat('  ', c_mktsegment, '2 ') ELSE ' ' END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0"
query("reviewed_corrections", "c_custkey c_mktsegment:s", "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN concat(c_mktsegment, '2') ELSE c_mktsegment END AS c_mktsegment FROM customer")(
    lambda t: resolve.overlay(t.customer, t.sql(FIXES), "c_custkey", "c_mktsegment"))
OTHER = "SELECT entity_id, 170.0E0 + entity_id % 7 AS height_cm, CASE WHEN entity_id % 2 = 0 THEN 180.0E0 END AS reach_cm FROM entity"
query("filled_attributes", "entity_id height_cm:d reach_cm:d forced_height:d", """
SELECT entity_id, coalesce(height_cm, 170.0E0 + entity_id % 7) AS height_cm, coalesce(reach_cm, CASE WHEN entity_id % 2 = 0 THEN 180.0E0 END) AS reach_cm, 170.0E0 + entity_id % 7 AS forced_height FROM entity
""")(lambda t: resolve.fill_missing(t.entity, t.sql(OTHER), "entity_id", ["height_cm", "reach_cm"]).join(
    resolve.fill_missing(t.entity, t.sql(OTHER), "entity_id", ["height_cm"], force=True).select("entity_id", C("height_cm").alias("forced_height")), "entity_id"))
DUPS = """SELECT c_custkey, concat(CASE WHEN c_custkey % 2 = 0 THEN 'Zoë ' ELSE 'ZOE ' END, CAST(c_custkey % 40 AS STRING)) AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 < 2 THEN NULL ELSE CAST(c_nationkey AS STRING) END AS nation FROM customer"""
query("merged_duplicates", "key:s n segment:s nation:s", f"""
WITH d AS (SELECT concat('zoe ', split_part(name, ' ', 2)) AS key, c_custkey, nullif(segment, '') AS segment, nation, CASE WHEN nullif(segment, '') IS NULL THEN 0 ELSE 1 END + CASE WHEN nation IS NULL THEN 0 ELSE 1 END AS f FROM ({DUPS}) AS x)
SELECT key, count(*) AS n, first(segment ORDER BY f DESC, c_custkey) FILTER (segment IS NOT NULL) AS segment, first(nation ORDER BY f DESC, c_custkey) FILTER (nation IS NOT NULL) AS nation FROM d GROUP BY key
""")(lambda t: resolve.merge_duplicates(t.sql(DUPS), names.name_key(C("name")), ["segment", "nation"], "c_custkey"))
PAIRED = "SELECT contest_id, concat(CAST(least(red_id, blue_id) AS STRING), '|', CAST(greatest(red_id, blue_id) AS STRING), '|', CAST(dt AS STRING)) AS pair, CASE WHEN contest_id % 2 = 0 THEN '' ELSE pool END AS pool, CASE WHEN contest_id % 5 = 0 THEN NULL ELSE method END AS method FROM contest"
SCHED = "SELECT concat(CAST(least(red_id, blue_id) AS STRING), '|', CAST(greatest(red_id, blue_id) AS STRING), '|', CAST(dt AS STRING)) AS pair, min(pool) AS pool, 'tbd' AS method FROM contest GROUP BY 1"
query("schedule_fallback", "contest_id pool:s method:s", f"SELECT contest_id, coalesce(nullif(p.pool, ''), s.pool) AS pool, coalesce(p.method, s.method) AS method FROM ({PAIRED}) AS p JOIN ({SCHED}) AS s ON s.pair = p.pair")(
    lambda t: resolve.fallback(t.sql(PAIRED), t.sql(SCHED), ["pool", "method"]))
VALUES = "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE '' END AS value FROM customer"
OVER = "SELECT c_name AS name, concat('over ', c_mktsegment) AS value FROM customer WHERE c_custkey % 4 = 1"
ALIAS = "SELECT a.c_name AS name, b.c_name AS alias FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey - 1 WHERE a.c_custkey % 4 = 2"
query("overrides_and_aliases", "c_custkey value:s", f"""
SELECT v.c_custkey, coalesce(nullif(v.value, ''), o.value, o2.value) AS value FROM ({VALUES}) AS v LEFT JOIN ({OVER}) AS o ON o.name = v.name LEFT JOIN ({ALIAS}) AS a ON a.name = v.name LEFT JOIN ({OVER}) AS o2 ON o2.name = a.alias
""")(lambda t: resolve.with_override(t.sql(VALUES), t.sql(OVER), t.sql(ALIAS)))
query("preview_rows", "contest_id red_country:s blue_country:s red_stance:s status:s", f"""
SELECT n.contest_id, r.country AS red_country, b.country AS blue_country, r.stance AS red_stance, CASE WHEN n.contest_id % 13 = 0 THEN 'cancelled' WHEN winner_id IS NOT NULL THEN 'final' ELSE 'scheduled' END AS status
FROM ({NAMED}) AS n JOIN entity r ON r.entity_id = n.red_id JOIN entity b ON b.entity_id = n.blue_id
""")(lambda t: resolve.preview(t.sql(NAMED).withColumn("is_cancelled", C("contest_id") % 13 == 0), t.entity, "country", "stance"))

# Approximate matching: names with a dropped, doubled or swapped part.
from contestlake.operators import fuzzy  # noqa: E402
from contestlake.functions import similarity  # noqa: E402
from workload import similar_sql as like  # noqa: E402

NOISY = """SELECT c_custkey AS stub_id, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, 'stomer', 'somer') WHEN 2 THEN concat(c_name, 'x') WHEN 3 THEN upper(replace(c_name, '#', ' ')) ELSE concat('zz ', substr(c_name, 12)) END AS name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE DATE '1970-01-01' + CAST(c_custkey % 900 AS INT) END AS dob FROM customer"""
PEOPLE = "SELECT c_custkey AS entity_id, c_name AS full_name, DATE '1970-01-01' + CAST(c_custkey % 900 AS INT) AS dob, c_mktsegment AS pool FROM customer"
query("stub_matches", "stub_id entity_id score:d", f"""
WITH s AS (SELECT stub_id, dob AS s_dob, lower(name) AS low, {like.in_order(like.key('name'))} AS l FROM ({NOISY}) AS n), e AS (SELECT *, {like.in_order(like.key('full_name'))} AS r FROM ({PEOPLE}) AS p),
rest AS (SELECT DISTINCT r FROM e WHERE r NOT IN (SELECT l FROM s)), near AS (SELECT DISTINCT l AS a, r AS b FROM s, rest WHERE 200.0E0 * least(length(l), length(r)) / (length(l) + length(r)) >= 90),
found AS (SELECT a AS l, b AS r, score FROM ({like.base('near')}) AS x WHERE score >= 90 UNION ALL SELECT DISTINCT r, r, 100.0E0 FROM e WHERE r IN (SELECT l FROM s)),
top AS (SELECT r, low, score FROM (SELECT r, low, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, low) AS k FROM found JOIN (SELECT DISTINCT l, low FROM s) AS d USING (l)) AS q WHERE k = 1)
SELECT min(stub_id) AS stub_id, entity_id, max(score) AS score FROM e JOIN top USING (r) JOIN s USING (low) WHERE dob IS NULL OR abs(date_diff('day', dob, s_dob)) <= 1 GROUP BY entity_id HAVING count(*) = 1
""")(lambda t: fuzzy.match_stubs(t.sql(NOISY), t.sql(PEOPLE))[0])
ASKED = f"SELECT n.stub_id AS row_id, n.name, c_mktsegment AS pool FROM ({NOISY}) AS n JOIN customer ON c_custkey = stub_id"
query("resolved_names", "row_id entity_id stage score:d", f"""
WITH e AS (SELECT entity_id, pool, lower(full_name) AS low, {like.key('full_name')} AS k FROM ({PEOPLE}) AS p), r AS (SELECT row_id, pool, lower(name) AS low, {like.key('name')} AS k FROM ({ASKED}) AS q),
exact AS (SELECT row_id, pool, k, (SELECT min(entity_id) FROM e WHERE e.low = r.low) AS one, (SELECT min(entity_id) FROM e WHERE e.k = r.k) AS two FROM r),
pairs AS (SELECT DISTINCT exact.k AS x, e.k AS y FROM exact JOIN e USING (pool) WHERE one IS NULL AND two IS NULL), {like.scores('pairs', ('token_set',))},
best AS (SELECT row_id, entity_id, token_set, row_number() OVER (PARTITION BY row_id ORDER BY token_set DESC, entity_id) AS n FROM exact JOIN e USING (pool) JOIN scored ON x = exact.k AND y = e.k
  WHERE one IS NULL AND two IS NULL AND token_set >= 88)
SELECT row_id, coalesce(one, two) AS entity_id, CASE WHEN one IS NOT NULL THEN 1 ELSE 2 END AS stage, 100.0E0 AS score FROM exact WHERE coalesce(one, two) IS NOT NULL
UNION ALL SELECT row_id, entity_id, 3, token_set FROM best WHERE n = 1
""")(lambda t: fuzzy.resolve_names(t.sql(ASKED), t.sql(PEOPLE)))
LEFT = "SELECT contest_id AS left_id, dt, red_name AS a_name, blue_name AS b_name FROM ({n}) AS x"
RIGHT = "SELECT contest_id AS right_id, CAST(dt AS DATE) + 1 AS dt, CASE WHEN contest_id % 2 = 0 THEN replace(red_name, 'Supp', 'Sup') ELSE blue_name END AS x_name, CASE WHEN contest_id % 2 = 0 THEN blue_name ELSE replace(red_name, 'Supp', 'Sup') END AS y_name FROM ({n}) AS x"
SPACED = f"SELECT contest_id, dt, winner_id, replace(red_name, '#', ' ') AS red_name, replace(blue_name, '#', ' ') AS blue_name FROM ({NAMED}) AS z"
query("fuzzy_pairs_in_window", "left_id right_id flipped score:d", f"""
WITH l AS (SELECT left_id, CAST(dt AS DATE) AS dt, {like.key('a_name')} AS a, {like.key('b_name')} AS b FROM ({LEFT.format(n=SPACED)}) AS q),
r AS (SELECT right_id, CAST(dt AS DATE) AS dt, {like.key('x_name')} AS c, {like.key('y_name')} AS d FROM ({RIGHT.format(n=SPACED)}) AS q),
named AS (SELECT u.k AS p, v.k AS q FROM (SELECT a AS k FROM l UNION SELECT b FROM l) AS u, (SELECT c AS k FROM r UNION SELECT d FROM r) AS v),
pairs AS (SELECT p AS x, q AS y FROM named UNION SELECT {like.last('p')}, q FROM named UNION SELECT p, {like.last('q')} FROM named), {like.scores('pairs', ('partial', 'token_set'))},
names AS (SELECT p, q, greatest(w.token_set, f.partial, g.partial) AS score FROM named JOIN scored w ON w.x = p AND w.y = q JOIN scored f ON f.x = {like.last('p')} AND f.y = q JOIN scored g ON g.x = p AND g.y = {like.last('q')}),
near AS (SELECT left_id, right_id, 0 AS flipped, a, b, c, d FROM l JOIN r ON abs(date_diff('day', l.dt, r.dt)) <= 3 UNION ALL SELECT left_id, right_id, 1, a, b, d, c FROM l JOIN r ON abs(date_diff('day', l.dt, r.dt)) <= 3),
best AS (SELECT left_id, right_id, flipped, least(one.score, two.score) AS score, row_number() OVER (PARTITION BY left_id ORDER BY least(one.score, two.score) DESC, right_id, flipped) AS n
  FROM near JOIN names one ON one.p = a AND one.q = c JOIN names two ON two.p = b AND two.q = d WHERE one.score >= 72 AND two.score >= 72)
SELECT left_id, right_id, flipped, score FROM best WHERE n = 1
""")(lambda t: fuzzy.match_pairs(t.sql(LEFT.format(n=SPACED)), t.sql(RIGHT.format(n=SPACED)), 72.0, days=3))
PRICED = "SELECT s_suppkey AS row_id, s_name AS target, map(concat('the ', lower(s_name)), 1.5D, 'Nobody', 2.0D, concat(s_name, ' jr'), 3.0D) AS prices FROM supplier"
query("best_price_key", "row_id key:s price:d score:d", f"""
WITH long AS (SELECT s_suppkey AS row_id, {like.key('s_name')} AS a, v.key, v.price, {like.key('v.key')} AS b FROM (SELECT s_suppkey, s_name, unnest([{{'key': concat('the ', lower(s_name)), 'price': 1.5E0}}, {{'key': 'Nobody', 'price': 2.0E0}}, {{'key': concat(s_name, ' jr'), 'price': 3.0E0}}]) AS v FROM supplier) AS q),
pairs AS (SELECT a AS x, b AS y FROM long UNION SELECT {like.last('a')}, b FROM long UNION SELECT a, {like.last('b')} FROM long), {like.scores('pairs', ('partial', 'token_set'))},
best AS (SELECT row_id, key, price, greatest(w.token_set, f.partial, g.partial) AS score FROM long JOIN scored w ON w.x = a AND w.y = b JOIN scored f ON f.x = {like.last('a')} AND f.y = b JOIN scored g ON g.x = a AND g.y = {like.last('b')})
SELECT row_id, key, price, score FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, key) AS n FROM best WHERE score >= 60) AS z WHERE n = 1
""")(lambda t: fuzzy.best_key(t.sql(PRICED)))
query("label_sides", "contest_id side:s", f"""
WITH q AS (SELECT contest_id, {like.key("CASE WHEN contest_id % 2 = 0 THEN concat(red_name, ' by KO') ELSE concat(blue_name, ' wins') END")} AS t, {like.key('red_name')} AS a, {like.key('blue_name')} AS b FROM ({SPACED}) AS s),
pairs AS (SELECT a AS x, t AS y FROM q UNION SELECT b, t FROM q UNION SELECT {like.last('a')}, t FROM q UNION SELECT {like.last('b')}, t FROM q), {like.scores('pairs', ('partial', 'token_set'))},
sides AS (SELECT contest_id, greatest(aw.token_set, al.partial) AS sa, greatest(bw.token_set, bl.partial) AS sb FROM q JOIN scored aw ON aw.x = a AND aw.y = t JOIN scored bw ON bw.x = b AND bw.y = t
  JOIN scored al ON al.x = {like.last('a')} AND al.y = t JOIN scored bl ON bl.x = {like.last('b')} AND bl.y = t)
SELECT contest_id, CASE WHEN sa >= 65 AND sa > sb THEN 'A' WHEN sb >= 65 AND sb > sa THEN 'B' END AS side FROM sides
""")(lambda t: t.sql(SPACED).select("contest_id", fuzzy.side_of(
    F.when(C("contest_id") % 2 == 0, F.concat(C("red_name"), F.lit(" by KO"))).otherwise(F.concat(C("blue_name"), F.lit(" wins"))), C("red_name"), C("blue_name")).alias("side")))
query("schedule_with_predictions", "contest_id scheduled_id a_name:s b_name:s", f"""
WITH p AS (SELECT contest_id, red_name, blue_name, {like.key('red_name')} AS a, {like.key('blue_name')} AS b FROM ({SPACED}) AS s)
SELECT contest_id, NULL AS scheduled_id, red_name AS a_name, blue_name AS b_name FROM p
UNION ALL SELECT NULL, contest_id, blue_name, red_name FROM p WHERE NOT EXISTS (SELECT 1 FROM p AS q WHERE least(p.a, p.b) = least(q.a, q.b) AND greatest(p.a, p.b) = greatest(q.a, q.b))
""")(lambda t: fuzzy.merge_schedule(
    t.sql(f"SELECT contest_id AS scheduled_id, blue_name AS a_name, red_name AS b_name FROM ({SPACED}) AS q"),
    t.sql(f"SELECT contest_id, red_name AS a_name, blue_name AS b_name FROM ({SPACED}) AS q")))
query("name_scores", "s_suppkey ratio:d partial:d token_sort:d token_set:d", f"""
WITH pairs AS (SELECT s_suppkey, s_name AS x, n_name AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey), {like.scores('pairs')}
SELECT s_suppkey, ratio, partial, token_sort, token_set FROM pairs JOIN scored USING (x, y)
""")(lambda t: t.supplier.join(t.nation, C("s_nationkey") == C("n_nationkey")).select(
    "s_suppkey", similarity.ratio("s_name", "n_name").alias("ratio"), similarity.partial_ratio("s_name", "n_name").alias("partial"),
    similarity.token_sort_ratio("s_name", "n_name").alias("token_sort"), similarity.token_set_ratio("s_name", "n_name").alias("token_set")))
