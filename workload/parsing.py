"""Cleaning, parsing and filter operators over cells derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.functions import names, odds, parse, probability as prob
from contestlake.operators import history, worklists
from contestlake.sources import pages as page_source
from workload.registry import query

C = F.col

# Text cells in the raw spellings the parsers accept, built from every line item.
CELLS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_suppkey % 7 = 0 THEN '--' ELSE concat(CAST(l_linenumber AS STRING), ':', lpad(CAST(l_partkey % 60 AS STRING), 2, '0')) END AS clock,
  CASE WHEN l_suppkey % 9 = 0 THEN 'n/a' ELSE concat(CAST(l_linenumber AS STRING), ' of ', CAST(CAST(l_quantity AS INT) AS STRING)) END AS tally,
  CASE WHEN l_partkey % 5 = 0 THEN 'x' ELSE CAST(l_partkey AS STRING) END AS num,
  CASE WHEN l_suppkey % 6 = 0 THEN 'Final' ELSE concat('Round ', CAST(l_linenumber AS STRING)) END AS rnd,
  CASE WHEN l_suppkey % 8 = 0 THEN '--' ELSE concat(CAST(5 + l_partkey % 2 AS STRING), ''' ', CAST(l_partkey % 12 AS STRING), '"') END AS height,
  CASE WHEN l_suppkey % 8 = 1 THEN '--' ELSE concat(CAST(60 + l_partkey % 20 AS STRING), '"') END AS reach,
  CASE l_suppkey % 4 WHEN 0 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) WHEN 1 THEN concat('0', CAST(1 + l_partkey % 9 AS STRING), '/1', CAST(l_partkey % 9 AS STRING), '/1988')
       WHEN 2 THEN concat('July ', CAST(1 + l_partkey % 28 AS STRING), ', 1987') ELSE '--' END AS born,
  CASE l_partkey % 12 WHEN 0 THEN 'KO/TKO Punch' WHEN 1 THEN 'TKO - Doctor' WHEN 2 THEN 'Submission' WHEN 3 THEN 'U-DEC' WHEN 4 THEN 'S-DEC'
       WHEN 5 THEN 'M-DEC' WHEN 6 THEN 'Decision - Split' WHEN 7 THEN 'Decision - Unanimous' WHEN 8 THEN 'DQ' WHEN 9 THEN 'nc'
       WHEN 10 THEN ' Overturned ' ELSE NULL END AS method,
  concat('Ann Lee', CAST(l_partkey % 10 AS STRING), CASE WHEN l_suppkey % 2 = 0 THEN ' vs. ' ELSE ' vs ' END, 'Bo Roe', CAST(l_suppkey % 10 AS STRING)) AS bout,
  CASE l_partkey % 4 WHEN 0 THEN 'W/L' WHEN 1 THEN 'L/W' WHEN 2 THEN 'D/D' ELSE 'NC/NC' END AS outcome,
  concat(CASE WHEN l_partkey % 3 = 0 THEN 'UFC ' ELSE '' END, CASE l_suppkey % 3 WHEN 0 THEN 'Lightweight' WHEN 1 THEN 'Women''s  Flyweight' ELSE 'Heavyweight' END,
         CASE WHEN l_partkey % 5 = 0 THEN ' Title Bout' ELSE ' Bout' END) AS pool_text,
  CASE WHEN l_partkey % 2 = 0 THEN '5 Rnd (5-5-5-5-5)' ELSE '3 Rnd (5-5-5)' END AS fmt,
  CASE l_suppkey % 3 WHEN 0 THEN 'Las Vegas, Nevada, USA' WHEN 1 THEN 'Paris, France' ELSE 'Austin, TX' END AS place,
  CASE l_partkey % 5 WHEN 0 THEN concat('+', CAST(100 + l_partkey % 300 AS STRING)) WHEN 1 THEN concat('−', CAST(100 + l_partkey % 300 AS STRING))
       WHEN 2 THEN concat('-', CAST(100 + l_partkey % 300 AS STRING)) WHEN 3 THEN 'n/a' ELSE '' END AS price,
  CASE l_linenumber % 4 WHEN 0 THEN concat('Over ', CAST(l_partkey % 4 AS STRING), '.5 Rounds') WHEN 1 THEN 'under' WHEN 2 THEN concat('Under ', CAST(1 + l_partkey % 3 AS STRING)) ELSE 'Draw' END AS total_sel,
  CASE l_partkey % 3 WHEN 0 THEN '1 or 2' WHEN 1 THEN '1,2 or 3' ELSE '4, 5 or 9' END AS rounds_text,
  CASE l_partkey % 7 WHEN 0 THEN 'Ann Lee by KO/TKO' WHEN 1 THEN 'Draw' WHEN 2 THEN 'Bo Roe by Submission' WHEN 3 THEN 'Bo Roe TKO' WHEN 4 THEN 'Points' WHEN 5 THEN 'draw or NC' ELSE 'Sub' END AS sel,
  CASE l_suppkey % 4 WHEN 0 THEN concat('Series ', CAST(l_partkey AS STRING), ': Ann vs Bo') WHEN 1 THEN 'Fight Night:  Lee vs Roe' WHEN 2 THEN 'Showdown' ELSE concat('Arena ', CAST(l_partkey % 300 AS STRING)) END AS title
FROM lineitem"""
W = f"WITH cells AS ({CELLS})\n"


def cells(t):
    return t.sql(CELLS)


query("parse_page_ids", "page_id id:s", """
SELECT page_id, nullif(trim(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1)), '') AS id FROM pages
""")(lambda t: t.pages.select("page_id", parse.url_id(C("url")).alias("id")))

query("squeeze_document_text", "doc_id digest:s chars", r"""
SELECT doc_id, md5(s) AS digest, length(s) AS chars
FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS s FROM documents) AS d
""")(lambda t: t.documents.select("doc_id", parse.squeeze(C("text")).alias("s"))
     .selectExpr("doc_id", "md5(s) AS digest", "length(s) AS chars"))

query("parse_stat_cells", "l_orderkey seconds landed attempted number period", W + """
SELECT l_orderkey, coalesce(TRY_CAST(regexp_extract(clock, '^(\\d+):(\\d{2})$', 1) AS INT) * 60 + TRY_CAST(regexp_extract(clock, '^(\\d+):(\\d{2})$', 2) AS INT), 0) AS seconds,
  coalesce(TRY_CAST(regexp_extract(tally, '^(\\d+) of (\\d+)$', 1) AS INT), 0) AS landed,
  coalesce(TRY_CAST(regexp_extract(tally, '^(\\d+) of (\\d+)$', 2) AS INT), 0) AS attempted,
  coalesce(TRY_CAST(num AS INT), 0) AS number, CAST(regexp_extract(rnd, '\\d+') AS INT) AS period
FROM cells WHERE regexp_matches(rnd, '\\d')
""".replace("\\\\", "\\"))(lambda t: cells(t).select(
    "l_orderkey", parse.clock_seconds(C("clock")).alias("seconds"), parse.landed_of_attempted(C("tally")).alias("x"),
    parse.safe_int(C("num")).alias("number"), parse.first_int(C("rnd")).alias("period"))
    .filter("period IS NOT NULL").selectExpr("*", "x.landed", "x.attempted"))

query("parse_body_measures", "l_orderkey height:d reach:d", W + r"""
SELECT l_orderkey, round((TRY_CAST(regexp_extract(height, '^(\d+)''\s*(\d+)', 1) AS INT) * 12 + TRY_CAST(regexp_extract(height, '^(\d+)''\s*(\d+)', 2) AS INT)) * 2.54E0, 1) AS height,
  round(TRY_CAST(replace(reach, '"', '') AS DOUBLE) * 2.54E0, 1) AS reach FROM cells
""")(lambda t: cells(t).select("l_orderkey", parse.feet_inches_cm(C("height")).alias("height"),
                               parse.inches_cm(C("reach")).alias("reach")))

query("parse_dates", "l_orderkey day:s age:d", W + """
SELECT l_orderkey, day, date_diff('day', day, DATE '2001-12-31') / 365.25E0 AS age FROM (
  SELECT l_orderkey, CAST(coalesce(TRY_STRPTIME(born, '%Y-%m-%d'), TRY_STRPTIME(born, '%B %d, %Y'), TRY_STRPTIME(born, '%m/%d/%Y')) AS DATE) AS day FROM cells) AS d
""")(lambda t: cells(t).select("l_orderkey", parse.any_date(C("born")).alias("day"))
     .withColumn("age", parse.age_years(C("day"), F.lit("2001-12-31").cast("date"))))

query("normalise_methods", "method:s canonical:s three_way:s selection:s token:s n", W + """
SELECT method, CASE WHEN method IS NULL THEN NULL WHEN regexp_matches(upper(trim(method)), '^T?KO') THEN 'KO/TKO' WHEN upper(trim(method)) LIKE 'SUB%' THEN 'SUB'
    WHEN contains(upper(method), 'DEC') THEN CASE WHEN contains(upper(method), 'U') THEN 'Decision (U)' WHEN contains(upper(method), 'S') THEN 'Decision (S)'
         WHEN contains(upper(method), 'M') THEN 'Decision (M)' ELSE 'Decision' END
    WHEN upper(trim(method)) IN ('DQ', 'NC', 'CANCELLED', '--') THEN upper(trim(method)) ELSE trim(method) END AS canonical,
  CASE WHEN coalesce(upper(method), '') LIKE '%KO%' THEN 'KO' WHEN coalesce(upper(method), '') LIKE '%SUB%' THEN 'SUB' ELSE 'DEC' END AS three_way,
  CASE WHEN lower(sel) LIKE 'draw%' THEN NULL WHEN regexp_matches(lower(sel), 'tko| ko') THEN 'KO_TKO' WHEN lower(sel) LIKE '%sub%' THEN 'SUB' ELSE 'DEC' END AS selection,
  CASE WHEN upper(sel) LIKE '%KO%' THEN 'KO' WHEN upper(sel) LIKE '%SUB%' THEN 'SUB' ELSE '' END AS token,
  count(*) AS n FROM cells GROUP BY ALL
""")(lambda t: cells(t).groupBy("method", parse.outcome_method(C("method")).alias("canonical"),
                                parse.canonical_method(C("method")).alias("three_way"),
                                parse.method_selection(C("sel")).alias("selection"),
                                parse.method_token(C("sel")).alias("token")).agg(F.count("*").alias("n")))

query("split_bouts_and_winners", "l_orderkey a_name:s b_name:s winner:s", W + """
SELECT l_orderkey, regexp_extract(bout, '^(.*?) vs\\.? (.*)$', 1) AS a_name, regexp_extract(bout, '^(.*?) vs\\.? (.*)$', 2) AS b_name,
  CASE outcome WHEN 'W/L' THEN regexp_extract(bout, '^(.*?) vs\\.? (.*)$', 1) WHEN 'L/W' THEN regexp_extract(bout, '^(.*?) vs\\.? (.*)$', 2) END AS winner FROM cells
""")(lambda t: cells(t).withColumn("x", parse.split_pair(C("bout"))).select(
    "l_orderkey", C("x.left").alias("a_name"), C("x.right").alias("b_name"),
    parse.winner_of(C("outcome"), C("x.left"), C("x.right")).alias("winner")))

query("contest_text_flags", "l_orderkey title long_format country:s town_country:s pool:s", W + r"""
SELECT l_orderkey, contains(lower(pool_text), 'title') AS title, left(fmt, 1) = '5' AS long_format, trim(string_split(place, ',')[-1]) AS country,
  CASE WHEN regexp_matches(trim(string_split(place, ',')[-1]), '^[A-Z]{2}$') THEN 'United States' ELSE trim(string_split(place, ',')[-1]) END AS town_country,
  trim(regexp_replace(replace(replace(replace(lower(pool_text), 'ufc ', ''), 'title bout', ''), ' bout', ''), '\s+', ' ', 'g')) AS pool FROM cells
""")(lambda t: cells(t).select("l_orderkey", parse.is_title(C("pool_text")).alias("title"),
                               parse.is_long_format(C("fmt")).alias("long_format"),
                               parse.last_part(C("place")).alias("country"), parse.country_of(C("place")).alias("town_country"),
                               parse.pool_key(C("pool_text")).alias("pool")))

query("name_keys", "c_custkey key:s slug:s loose:s last:s", """
SELECT c_custkey, k AS key, replace(k, ' ', '-') AS slug, concat(string_split(k, ' ')[-1], '|', left(k, 1)) AS loose, string_split(k, ' ')[-1] AS last
FROM (SELECT c_custkey, trim(regexp_replace(translate(lower(c_name || '  É. ' || n_name || ' Ñandú'), 'éñú', 'enu'), '[^a-z0-9]+', ' ', 'g')) AS k
      FROM customer JOIN nation ON c_nationkey = n_nationkey) AS x
""")(lambda t: t.sql("SELECT c_custkey, concat(c_name, '  É. ', n_name, ' Ñandú') AS nm FROM customer JOIN nation ON c_nationkey = n_nationkey")
     .select("c_custkey", names.name_key(C("nm")).alias("key"), names.name_slug(C("nm")).alias("slug"),
             names.surname_initial(C("nm")).alias("loose"), names.last_token(C("nm")).alias("last")))

query("contest_keys", "contest_id key_bytes id:s", """
SELECT contest_id, 16 AS key_bytes, left(sha1(concat_ws('|', CAST(dt AS STRING), CAST(red_id AS STRING), CAST(blue_id AS STRING))), 16) AS id FROM contest
""")(lambda t: t.contest.select("contest_id", parse.contest_key(C("dt"), C("red_id"), C("blue_id")).alias("id"))
     .withColumn("key_bytes", F.length("id")))

query("price_conversions", "l_orderkey american:d implied:d decimal:d back:d", W + """
SELECT l_orderkey, american, CASE WHEN american >= 0 THEN 100 / (american + 100) ELSE -american / (100 - american) END AS implied,
  CASE WHEN american >= 0 THEN american / 100 + 1 ELSE 100 / abs(american) + 1 END AS decimal,
  1 / CASE WHEN american >= 0 THEN american / 100 + 1 ELSE 100 / abs(american) + 1 END AS back
FROM (SELECT l_orderkey, CASE WHEN regexp_matches(translate(price, '−', '-'), '^[+-]\\d+$') THEN CAST(translate(price, '−', '-') AS DOUBLE) END AS american FROM cells) AS x
""")(lambda t: cells(t).withColumn("american", odds.parse_american(C("price"))).select(
    "l_orderkey", "american", F.when(C("american").isNotNull(), odds.american_to_implied(C("american"))).alias("implied"),
    F.when(C("american").isNotNull(), odds.american_to_decimal(C("american"))).alias("decimal"))
    .withColumn("back", F.when(C("decimal").isNotNull(), odds.decimal_to_implied(C("decimal")))))

query("fair_probabilities", "contest_id fair_red:d fair_blue:d overround:d", """
SELECT contest_id, ir / (ir + ib) AS fair_red, ib / (ir + ib) AS fair_blue, ir + ib AS overround FROM (
  SELECT contest_id, CASE WHEN odds_red >= 0 THEN 100 / (odds_red + 100) ELSE -odds_red / (100 - odds_red) END AS ir,
    CASE WHEN odds_blue >= 0 THEN 100 / (odds_blue + 100) ELSE -odds_blue / (100 - odds_blue) END AS ib FROM contest WHERE odds_red IS NOT NULL) AS x
""")(lambda t: t.contest.filter("odds_red IS NOT NULL").select(
    "contest_id", odds.american_to_implied(C("odds_red")).alias("ir"), odds.american_to_implied(C("odds_blue")).alias("ib"))
    .select("contest_id", odds.fair_share(C("ir"), C("ib")).alias("fair_red"), odds.fair_share(C("ib"), C("ir")).alias("fair_blue"),
            (C("ir") + C("ib")).alias("overround")))

query("total_lines", "l_orderkey direction:s line:d suffix:d rounds:s half:s", W + """
SELECT l_orderkey, CASE WHEN regexp_matches(lower(total_sel), '(over|under)\\s+\\d') THEN regexp_extract(lower(total_sel), '(over|under)', 1) WHEN lower(total_sel) IN ('over', 'under') THEN lower(total_sel) END AS direction,
  CASE WHEN regexp_matches(lower(total_sel), '(over|under)\\s+\\d') THEN CAST(regexp_extract(lower(total_sel), '(\\d+\\.?\\d*)', 1) AS DOUBLE) WHEN lower(total_sel) IN ('over', 'under') THEN 2.5 END AS line,
  CAST(l_partkey % 5 AS DOUBLE) + 0.5 AS suffix,
  CASE l_partkey % 3 WHEN 0 THEN '1,2' WHEN 1 THEN '1,2,3' ELSE '4,5' END AS rounds, concat(CAST(l_linenumber AS STRING), '.5') AS half FROM cells
""".replace("\\\\", "\\"))(lambda t: cells(t).withColumn("x", parse.over_under(C("total_sel"))).select(
    "l_orderkey", "x.direction", "x.line", parse.suffix_number(F.concat(F.lit("total_rounds_"), (C("l_partkey") % 5).cast("string"), F.lit(".5"))).alias("suffix"),
    F.array_join(parse.round_range(C("rounds_text")), ",").alias("rounds"),
    parse.half_label(F.concat(C("l_linenumber").cast("string"), F.lit("½"))).alias("half")))

query("event_numbers", "title:s event:s n", W + r"""
SELECT title, CASE WHEN regexp_matches(title, '\d') THEN regexp_extract(title, '\d+') ELSE trim(regexp_replace(lower(regexp_extract(title, '([^:]*)$', 1)), '\s+', ' ', 'g')) END AS event, count(*) AS n FROM cells GROUP BY ALL
""")(lambda t: cells(t).groupBy("title", parse.event_key(C("title")).alias("event")).agg(F.count("*").alias("n")))

query("outcome_classes", "contest_id method_class:s round_class:s", """
SELECT contest_id, concat(CASE label WHEN 1 THEN 'A_' ELSE 'B_' END, CASE WHEN method LIKE '%KO%' THEN 'KO_TKO' WHEN method LIKE '%SUB%' THEN 'SUB' ELSE 'DEC' END) AS method_class,
  CASE WHEN method LIKE 'Dec%' THEN 'DEC' ELSE concat('R', CAST(period_ended AS STRING)) END AS round_class FROM oof
""")(lambda t: t.oof.select("contest_id", parse.method_class(C("label"), C("method")).alias("method_class"),
                            parse.round_class(C("period_ended"), C("method")).alias("round_class")))

query("display_classes", "contest_id tier:s quality:s favourite:s style:s streak:s better:s live", """
SELECT contest_id, CASE WHEN abs(p - 0.5) * 0.3 < 0.07 THEN 'High' WHEN abs(p - 0.5) * 0.3 < 0.12 THEN 'Medium' ELSE 'Low' END AS tier,
  CASE WHEN period_ended * 3 >= 10 THEN 'good' WHEN period_ended * 3 >= 5 THEN 'limited' ELSE 'poor' END AS quality,
  CASE WHEN abs(p - 0.5) < 0.03 THEN 'toss-up' WHEN p > 0.5 THEN 'A' ELSE 'B' END AS favourite,
  CASE WHEN p >= 0.55 AND period_ended < 3 THEN 'striker' WHEN p < 0.55 AND period_ended >= 3 THEN 'grappler' ELSE 'balanced' END AS style,
  CASE WHEN period_ended >= 3 THEN 'win-streak' WHEN period_ended = 2 THEN 'loss-streak' ELSE 'none' END AS streak,
  CASE WHEN p > 0.5 THEN 'better/worse' WHEN p < 0.5 THEN 'worse/better' ELSE 'even/even' END AS better,
  CASE WHEN method NOT IN ('KO/TKO', 'SUB') THEN 1 ELSE 0 END AS live FROM oof
""")(lambda t: worklists.display_classes(t.oof))

query("eligible_contests", "contest_id dt:s", """
SELECT contest_id, dt FROM contest WHERE method IS NOT NULL AND method NOT IN ('NC', 'DQ', 'CANCELLED') AND winner_id IS NOT NULL AND dt >= DATE '1997-01-01'
""")(lambda t: history.eligible(t.contest, 1997))

query("strictly_prior_pairs", "entity_id dt:s n_before", """
SELECT a.entity_id, a.dt, (SELECT count(*) FROM contest c WHERE c.dt < a.dt AND (c.red_id = a.entity_id OR c.blue_id = a.entity_id)) AS n_before
FROM (SELECT DISTINCT red_id AS entity_id, dt FROM contest) AS a
""")(lambda t: worklists.prior_counts(t.contest, t.contest.selectExpr("red_id AS entity_id", "dt").distinct()))

query("scorable_schedule", "contest_id red_id blue_id", """
SELECT contest_id, red_id, blue_id FROM contest WHERE dt >= DATE '2000-01-01' AND method IS DISTINCT FROM 'NC' AND contest_id % 11 <> 0
""")(lambda t: worklists.scorable(t.sql("""
    SELECT *, dt AS event_date, coalesce(method = 'NC', false) AS is_cancelled,
      CASE WHEN contest_id % 11 = 0 THEN NULL ELSE blue_id END AS b FROM contest""").drop("blue_id").withColumnRenamed("b", "blue_id"),
    F.lit("2000-01-01").cast("date")))

query("drop_placeholders", "c_custkey name:s", """
SELECT c_custkey, name FROM (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'TBA' WHEN 1 THEN ' tbd ' WHEN 2 THEN '' ELSE c_name END AS name FROM customer) AS x
WHERE lower(trim(name)) NOT IN ('tba', 'tbd', '')
""")(lambda t: t.sql("SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'TBA' WHEN 1 THEN ' tbd ' WHEN 2 THEN '' ELSE c_name END AS name FROM customer")
     .filter(worklists.known_name(C("name"))))

query("missing_attributes", "entity_id", "SELECT entity_id FROM entity WHERE dob IS NULL OR reach_cm IS NULL OR height_cm IS NULL")(
    lambda t: worklists.lacking(t.entity, "dob", "reach_cm", "height_cm"))

query("graded_probability", "contest_id graded:d", """
SELECT contest_id, CASE WHEN abs(p2 - 0.5) < 0.005 THEN NULL ELSE p2 END AS graded FROM (SELECT contest_id, CASE WHEN contest_id % 5 = 0 THEN 0.5 ELSE p END AS p2 FROM oof) AS x
""")(lambda t: t.sql("SELECT contest_id, CASE WHEN contest_id % 5 = 0 THEN 0.5 ELSE p END AS p2 FROM oof")
     .select("contest_id", worklists.informative(C("p2")).alias("graded")))

query("events_lacking_prices", "dt:s n n_missing", """
SELECT dt, count(*) AS n, count(*) FILTER (odds_red IS NULL) AS n_missing FROM contest WHERE dt BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY dt HAVING count(*) FILTER (odds_red IS NULL) > 0
""")(lambda t: worklists.events_lacking(t.contest, "1996-01-01", "2000-12-31"))

query("events_with_prices", "dt:s", "SELECT DISTINCT dt FROM contest WHERE odds_red IS NOT NULL AND dt BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")(
    lambda t: worklists.events_having(t.contest, "1996-01-01", "2000-12-31"))

query("refresh_worklist", "name:s", """
SELECT u.name FROM (SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer) AS u
LEFT JOIN (SELECT full_name, min(stance) AS stance FROM entity GROUP BY full_name) AS e ON e.full_name = u.name WHERE e.stance IS NULL
""")(lambda t: worklists.refresh([t.supplier.selectExpr("s_name AS name"), t.customer.selectExpr("c_name AS name")],
                                 t.entity.selectExpr("full_name AS name", "stance"), "stance"))

query("priced_contests", "contest_id n_markets", """
SELECT contest_id, 1 + CASE WHEN period_ended > 2 THEN 1 ELSE 0 END AS n_markets FROM contest WHERE odds_red IS NOT NULL
""")(lambda t: worklists.with_market(t.contest.selectExpr(
    "contest_id", "red_id", "blue_id",
    "map_filter(map('moneyline', odds_red, 'rounds', CASE WHEN period_ended > 2 THEN 1.5D END), (k, v) -> v IS NOT NULL) AS markets"),
    "moneyline", "red_id", "blue_id").selectExpr("contest_id", "size(markets) AS n_markets"))

query("cache_age", "event_id age_hours:d usable", """
SELECT event_id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 3.6E9 AS age_hours, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 3.6E9 < 36 AS usable FROM events
""")(lambda t: worklists.cache_age(t.events.withColumn("ts", C("ts").cast("timestamp")), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp")))

query("rating_expectation", "contest_id expected:d idle_rd:d weight:d", """
SELECT contest_id, 1 / (1 + pow(10, -(p - 0.5) * 400 / 400)) AS expected,
  least(350, sqrt(pow(80 / 173.7177E0, 2) + pow(34.6E0 / 173.7177E0, 2) * ((contest_id % 900 + 1) / 365.0E0)) * 173.7177E0) AS idle_rd,
  pow(0.5, greatest(date_diff('day', dt, DATE '2001-08-01') / 365.25E0, 0) / 6.0E0) AS weight FROM oof
""")(lambda t: t.oof.select("contest_id", prob.elo_expected((C("p") - 0.5) * 400).alias("expected"),
                            prob.inflate_deviation(F.lit(80.0), C("contest_id") % 900 + 1).alias("idle_rd"),
                            prob.decay_weight(F.date_diff(F.lit("2001-08-01").cast("date"), C("dt")) / 365.25).alias("weight")))

query("page_fields", "page_id title:s h1:s n_links lang:s", """
SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS h1,
  len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_links, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang FROM pages
""")(lambda t: page_source.fields(t.pages))

query("page_link_rows", "page_id pos target:s label:s", """
SELECT page_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS target, unnest(l) AS label FROM (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS t, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS l FROM pages) AS x
""")(lambda t: page_source.link_rows(t.pages))

query("page_label_pairs", "page_id label:s n first_target:s last_target:s", """
SELECT page_id, upper(left(label, 1)) AS label, count(*) AS n, min(target) AS first_target, max(target) AS last_target FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS target, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM pages) AS x
GROUP BY 1, 2 HAVING count(*) = 2
""")(lambda t: page_source.pairs(page_source.link_rows(t.pages).withColumn("label", F.upper(F.substring("label", 1, 1))), "label"))
