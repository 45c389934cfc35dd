"""Sorts, limits, set operations and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.operators import cards, rulebook, upsert
from contestlake.operators.history import sides
from contestlake.sources import documents
from workload.registry import query

C = F.col

query("ordered_predictions", "contest_id dt:s is_title", "SELECT contest_id, dt, is_title FROM contest")(lambda t: t.contest.orderBy("dt", C("is_title").desc(), "contest_id"))
query("top_prices_and_per_pool", "scope:s contest_id odds_red:d", """
SELECT 'all' AS scope, contest_id, odds_red FROM (SELECT * FROM contest WHERE odds_red IS NOT NULL ORDER BY odds_red DESC, contest_id LIMIT 10) AS a
UNION ALL SELECT pool, contest_id, odds_red FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY odds_red DESC, contest_id) AS k FROM contest WHERE odds_red IS NOT NULL) AS b WHERE k <= 5
""")(lambda t: t.contest.filter("odds_red IS NOT NULL").transform(lambda c: c.orderBy(C("odds_red").desc(), "contest_id").limit(10).select(F.lit("all").alias("scope"), "contest_id", "odds_red")
     .unionByName(c.selectExpr("pool AS scope", "contest_id", "odds_red", "row_number() OVER (PARTITION BY pool ORDER BY odds_red DESC, contest_id) AS k").filter("k <= 5").drop("k"))))
query("latest_outcomes", "contest_id dt:s winner_id", "SELECT contest_id, dt, winner_id FROM contest WHERE winner_id IS NOT NULL ORDER BY dt DESC, contest_id DESC LIMIT 500")(
    lambda t: t.contest.filter("winner_id IS NOT NULL").orderBy(C("dt").desc(), C("contest_id").desc()).limit(500))
query("active_entities", "entity_id", "SELECT red_id AS entity_id FROM contest WHERE dt >= DATE '2000-06-01' UNION SELECT blue_id FROM contest WHERE dt >= DATE '2000-06-01'")(
    lambda t: t.contest.filter("dt >= DATE '2000-06-01'").transform(lambda c: c.selectExpr("red_id AS entity_id").union(c.select("blue_id")).distinct()))
query("all_sources", "contest_id source:s", "SELECT contest_id, 'a' AS source FROM contest UNION ALL SELECT contest_id, 'b' FROM oof")(
    lambda t: t.contest.select("contest_id", F.lit("a").alias("source")).unionByName(t.oof.select("contest_id", F.lit("b").alias("source")), allowMissingColumns=True))
OLD = "SELECT user_id, event_type, event_id AS stamp, value FROM events WHERE event_id % 3 <> 0"
NEW = "SELECT user_id, event_type, event_id AS stamp, value * 2 AS value FROM events WHERE event_id % 3 = 0"
query("replaced_quotes", "user_id event_type:s stamp value:d", f"""
SELECT user_id, event_type, stamp, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY fresh DESC, stamp DESC) AS k FROM (SELECT *, 0 AS fresh FROM ({OLD}) AS o UNION ALL SELECT *, 1 FROM ({NEW}) AS n) AS u) AS x WHERE k = 1
""")(lambda t: upsert.replace(t.sql(OLD), t.sql(NEW), ["user_id", "event_type"], "stamp"))
STORED = "SELECT contest_id AS scheduled_id, CAST(dt AS STRING) AS event_name, is_title = 1 AS is_title, false AS is_long, contest_id % 4 = 0 AS is_cancelled, yr AS first_seen, yr AS last_updated FROM contest WHERE contest_id % 3 <> 0"
FRESH = "SELECT contest_id AS scheduled_id, CAST(dt AS STRING) AS event_name, contest_id % 5 = 0 AS is_title, is_long = 1 AS is_long FROM contest WHERE contest_id % 2 = 0 UNION ALL SELECT contest_id, CAST(dt AS STRING), true, false FROM contest WHERE contest_id % 10 = 0"
query("upserted_schedule", "scheduled_id event_name:s is_title is_long is_cancelled first_seen last_updated is_new", f"""
WITH s AS ({STORED}), f AS (SELECT scheduled_id, min(event_name) AS event_name, bool_or(is_title) AS is_title, bool_or(is_long) AS is_long FROM ({FRESH}) AS x GROUP BY 1)
SELECT coalesce(s.scheduled_id, f.scheduled_id) AS scheduled_id, coalesce(s.event_name, f.event_name) AS event_name, coalesce(s.is_title, false) OR coalesce(f.is_title, false) AS is_title, coalesce(s.is_long, false) OR coalesce(f.is_long, false) AS is_long,
  CASE WHEN f.scheduled_id IS NOT NULL THEN false ELSE is_cancelled END AS is_cancelled, coalesce(first_seen, 2002) AS first_seen, CASE WHEN f.scheduled_id IS NOT NULL THEN 2002 ELSE last_updated END AS last_updated, s.scheduled_id IS NULL AS is_new
FROM s FULL JOIN f ON f.scheduled_id = s.scheduled_id
""")(lambda t: upsert.upsert_schedule(t.sql(STORED), t.sql(FRESH), F.lit(2002)))
query("first_of_duplicates", "l_orderkey l_linenumber l_partkey l_quantity:d", """
SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_suppkey) AS k FROM lineitem) AS x WHERE k = 1
""")(lambda t: upsert.newest(t.lineitem, ["l_orderkey", "l_linenumber"], [C("l_partkey"), C("l_quantity"), C("l_suppkey")]))
query("accumulated_predictions", "contest_id dt:s p:d", "SELECT contest_id, dt, CASE WHEN contest_id % 2 = 0 THEN p / 2 ELSE p END AS p FROM oof WHERE dt < DATE '2001-01-01'")(
    lambda t: upsert.accumulate(t.oof.select("contest_id", "dt", "p"), t.oof.filter("contest_id % 2 = 0").selectExpr("contest_id", "dt", "p / 2 AS p"), "contest_id", F.lit("2001-01-01").cast("date")))
query("merged_live_results", "contest_id method:s period_ended", """
SELECT contest_id, CASE WHEN contest_id % 3 = 0 THEN 'live' ELSE method END AS method, CASE WHEN contest_id % 3 = 0 AND contest_id % 2 = 0 THEN 9 ELSE CASE WHEN contest_id % 6 = 3 AND contest_id % 7 = 0 THEN NULL ELSE period_ended END END AS period_ended FROM contest
""")(lambda t: upsert.merge_results(t.contest.filter("NOT (contest_id % 6 = 3 AND contest_id % 7 = 0)").select("contest_id", "method", "period_ended"),
                                    t.contest.filter("contest_id % 3 = 0").selectExpr("contest_id", "'live' AS method", "CASE WHEN contest_id % 2 = 0 THEN 9L END AS period_ended"),
                                    ["contest_id"], ["method", "period_ended"]))
query("preferred_source", "dt:s source:s n", """
SELECT dt, CASE WHEN day(dt) <= 10 THEN 'first' ELSE 'second' END AS source, count(*) AS n FROM contest WHERE day(dt) <= 20 GROUP BY ALL
""")(lambda t: upsert.prefer(t.contest.filter("day(dt) <= 10").select("contest_id", "dt", F.lit("first").alias("source")),
                             t.contest.filter("day(dt) <= 20").select("contest_id", "dt", F.lit("second").alias("source")), "dt").groupBy("dt", "source").agg(F.count("*").alias("n")))
query("name_set_operations", "op:s n", """
SELECT 'both' AS op, count(*) AS n FROM (SELECT red_id FROM contest INTERSECT SELECT blue_id FROM contest) AS a
UNION ALL SELECT 'only', count(*) FROM (SELECT contest_id FROM contest EXCEPT SELECT contest_id FROM oof) AS b
""")(lambda t: t.contest.select("red_id").intersect(t.contest.select("blue_id")).agg(F.lit("both").alias("op"), F.count("*").alias("n"))
     .unionByName(t.contest.select("contest_id").exceptAll(t.oof.select("contest_id")).agg(F.lit("only").alias("op"), F.count("*").alias("n"))))
query("main_contest_of_event", "dt:s contest_id", "SELECT dt, contest_id FROM (SELECT dt, contest_id, row_number() OVER (PARTITION BY dt ORDER BY time_ended_sec DESC, contest_id DESC) AS k FROM contest) AS x WHERE k = 1")(
    lambda t: upsert.newest(t.contest, ["dt"], [C("time_ended_sec").desc(), C("contest_id").desc()]))
query("nested_schedule", "dt:s page n first_contest sum_red", """
SELECT dt, floor(pos / 500) AS page, count(*) AS n, min(contest_id) AS first_contest, sum(red_id) AS sum_red FROM (SELECT dt, contest_id, red_id, row_number() OVER (PARTITION BY dt ORDER BY contest_id) - 1 AS pos FROM contest) AS x GROUP BY 1, 2
""")(lambda t: cards.nested(t.contest, "dt", ["red_id", "blue_id"]).selectExpr("dt", "page", "n", "contests[0].contest_id AS first_contest", "aggregate(contests, 0L, (a, x) -> a + x.red_id) AS sum_red"))
query("prediction_documents", "contest_id doc:s", """
SELECT contest_id, concat('{"contest_id":', CAST(contest_id AS VARCHAR), ',"sides":{"a":', CAST(a_id AS VARCHAR), ',"b":', CAST(b_id AS VARCHAR), '},"label":', CAST(label AS VARCHAR), CASE WHEN odds_red IS NULL THEN '' ELSE concat(',"odds":{"red":', CAST(CAST(odds_red AS INT) AS VARCHAR), ',"blue":', CAST(CAST(odds_blue AS INT) AS VARCHAR), '}') END, '}') AS doc FROM oof
""")(lambda t: documents.assemble(t.oof.select("contest_id", F.struct(C("a_id").alias("a"), C("b_id").alias("b")).alias("sides"), "label"),
                                  {"odds": t.oof.filter("odds_red IS NOT NULL").select("contest_id", F.struct(C("odds_red").cast("int").alias("red"), C("odds_blue").cast("int").alias("blue")).alias("odds"))}))
query("event_property_rows", "event_id key:s value", "SELECT event_id, 'k' AS key, CAST(regexp_extract(props, '\"k\": *(-?\\d+)', 1) AS BIGINT) AS value FROM events WHERE props IS NOT NULL".replace("\\\\", "\\"))(
    lambda t: documents.flat_properties(t.events, "event_id", "props"))

# Market documents with the shapes that appear in the wild: nested and flat prices, repeated selections, unknown markets.
DOC = """SELECT contest_id, 'Ann Lee' AS a_name, 'Bo Roe' AS b_name, concat('{"markets":[{"name":"Match Betting","selections":[{"name":"Ann Lee","price":{"winPrice":', CAST(1 + contest_id % 7 AS STRING), '.5}},{"selectionName":"Bo Roe","odds":2.25}]},',
  '{"name":"Total Rounds","selections":[{"name":"Over 2.5","price":{"winPrice":1.9}},{"name":"Over 2.5","price":{"winPrice":', CAST(2 + contest_id % 3 AS STRING), '.0}},{"name":"Under 2.5","price":0.5}]},',
  '{"name":"Fight To Start Round 3","selections":[{"name":"Yes","win":1.5}]},{"name":"Significant Strikes Over/Under','","selections":[{"name":"Over 80.5","price":{"decimal":1.8}},{"name":"Under 80.5","price":{"win":2.0}},{"name":"Over 90.5","price":{"win":2.5}}]},',
  '{"name":"Bo Roe Takedowns Over/Under","selections":[{"name":"Over 1.5","price":{"win":', CAST(2 + contest_id % 4 AS STRING), '.5}}]},{"name":"Method & Round Combo","selections":[{"name":"Ann Lee KO/TKO & Round 2","price":{"win":9.0}},{"name":"Submission & Round 1","price":{"win":12.0}},{"name":"Bo Roe to win by KO/TKO in Rounds 1,2 or 3","price":{"win":4.0}}]}]}') AS doc FROM contest"""
query("document_selections", "contest_id market:s selection:s price:d", """
SELECT contest_id, 'moneyline' AS market, 'Ann Lee' AS selection, 1.5E0 + contest_id % 7 AS price FROM contest UNION ALL SELECT contest_id, 'moneyline', 'Bo Roe', 2.25 FROM contest
UNION ALL SELECT contest_id, 'total_rounds', 'Over 2.5', 2.0E0 + contest_id % 3 FROM contest UNION ALL SELECT contest_id, 'round_survival', 'Start R3 Yes', 1.5 FROM contest
UNION ALL SELECT contest_id, 'other', s, p FROM contest, (VALUES ('Over 80.5', 1.8E0), ('Under 80.5', 2.0E0), ('Over 90.5', 2.5E0), ('Ann Lee KO/TKO & Round 2', 9.0E0), ('Submission & Round 1', 12.0E0), ('Bo Roe to win by KO/TKO in Rounds 1,2 or 3', 4.0E0)) AS v(s, p)
UNION ALL SELECT contest_id, 'other', 'Over 1.5', 2.5E0 + contest_id % 4 FROM contest
""")(lambda t: documents.selections(t.sql(DOC)))
query("document_totals", "contest_id market:s line:d over_price:d under_price:d", """
SELECT contest_id, 'total_sig_strikes_combined' AS market, 80.5 AS line, 1.8 AS over_price, 2.0 AS under_price FROM contest UNION ALL SELECT contest_id, 'total_takedowns_b', 1.5, 2.5E0 + contest_id % 4, NULL FROM contest
""")(lambda t: documents.totals(t.sql(DOC)))
query("document_method_rounds", "contest_id market:s side:s method:s rounds:s price:d", """
SELECT contest_id, 'method_round' AS market, 'A' AS side, 'KO' AS method, '2' AS rounds, 9.0 AS price FROM contest UNION ALL SELECT contest_id, 'method_round_neutral', NULL, 'SUB', '1', 12.0 FROM contest
UNION ALL SELECT contest_id, 'method_round_range', 'B', 'KO', '1,2,3', 4.0 FROM contest
""")(lambda t: documents.method_rounds(t.sql(DOC)).withColumn("rounds", F.array_join("rounds", ",")))

RULES = "SELECT n_nationkey % 7 AS priority, lower(n_name) AS keyword, concat('region ', CAST(n_regionkey AS STRING)) AS label FROM nation UNION ALL SELECT 3, substr(lower(n_name), 2, 3), concat('part ', n_name) FROM nation UNION ALL SELECT 0, '', 'never' FROM nation"
TEXTS = "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE lower(concat(c_name, ' from ', n_name, ' ', substr(n_name, 1 + CAST(c_custkey % 3 AS INT), 4), 'ia')) END AS words FROM customer JOIN nation ON n_nationkey = c_nationkey"
query("keyword_rules", "c_custkey inline:s joined:s", f"""
WITH r AS ({RULES}), t AS ({TEXTS}), hit AS (SELECT c_custkey, label, row_number() OVER (PARTITION BY c_custkey ORDER BY priority, label) AS n FROM t JOIN r ON keyword <> '' AND contains(words, keyword))
SELECT c_custkey, coalesce(label, 'none') AS inline, coalesce(label, 'none') AS joined FROM t LEFT JOIN (SELECT * FROM hit WHERE n = 1) AS h USING (c_custkey)
""")(lambda t: rulebook.label(rulebook.label(t.sql(TEXTS), C("words"), t.sql(RULES), "inline", "none"), C("words"), t.sql(RULES), "joined", "none", inline=0))
