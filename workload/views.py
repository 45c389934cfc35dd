"""Views that give the driver tables the shape of contests, statistics and quotes.

The text is plain SQL that Spark and DuckDB both read, so a query and its twin
start from the same rows.  The operators under test are never written here.
"""

from __future__ import annotations

import re
from collections.abc import Container, Mapping

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    # First two lines of every order side by side (a top-2 per key, so it is limited map-side).
    "pairline": """
        SELECT l_orderkey, PICKS FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
                 l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
                 l_linestatus, l_shipdate) AS rn FROM lineitem) AS r
        WHERE rn <= 2 GROUP BY l_orderkey HAVING count(*) = 2""".replace("PICKS", ", ".join(
        f"max(CASE WHEN rn = {i} THEN l_{c} END) AS {s}_{c}" for i, s in ((1, "a"), (2, "b")) for c in
        ("suppkey", "partkey", "linenumber", "quantity", "extendedprice", "discount", "tax", "returnflag"))),
    "contest": """
        SELECT c.*, CAST(extract(year FROM dt) AS BIGINT) AS yr,
          CASE WHEN contest_id % 7 = 0 THEN NULL
               WHEN share_red * 1.04 >= 0.5 THEN -round(100 * (share_red * 1.04) / (1 - share_red * 1.04))
               ELSE round(100 * (1 - share_red * 1.04) / (share_red * 1.04)) END AS odds_red,
          CASE WHEN contest_id % 7 = 0 THEN NULL
               WHEN (1 - share_red) * 1.04 >= 0.5
               THEN -round(100 * ((1 - share_red) * 1.04) / (1 - (1 - share_red) * 1.04))
               ELSE round(100 * (1 - (1 - share_red) * 1.04) / ((1 - share_red) * 1.04)) END AS odds_blue
        FROM (
          SELECT x.l_orderkey AS contest_id, CAST(o.o_orderdate AS DATE) AS dt, p.p_type AS pool,
            a_suppkey AS red_id, b_suppkey AS blue_id,
            CASE WHEN a_quantity > b_quantity THEN a_suppkey
                 WHEN a_quantity < b_quantity THEN b_suppkey END AS winner_id,
            CASE WHEN a_tax >= 0.08 AND b_tax >= 0.06 THEN 'NC'
                 WHEN a_tax >= 0.08 AND b_tax <= 0.01 THEN NULL
                 WHEN a_returnflag = 'A' THEN 'KO/TKO'
                 WHEN a_returnflag = 'R' THEN 'SUB' ELSE 'Decision (U)' END AS method,
            CAST(1 + a_linenumber % 5 AS BIGINT) AS period_ended,
            CAST(a_quantity AS BIGINT) * 6 AS time_ended_sec,
            CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS is_title,
            CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS is_long,
            CASE WHEN a_discount >= 0.09 THEN 1 ELSE 0 END AS red_short_notice,
            CASE WHEN b_discount >= 0.09 THEN 1 ELSE 0 END AS blue_short_notice,
            CASE WHEN a_extendedprice / (a_extendedprice + b_extendedprice) > 0.9 THEN 0.9E0
                 WHEN a_extendedprice / (a_extendedprice + b_extendedprice) < 0.1 THEN 0.1E0
                 ELSE a_extendedprice / (a_extendedprice + b_extendedprice) END AS share_red,
            a_partkey, a_linenumber, a_quantity, a_discount, b_partkey, b_linenumber, b_quantity, b_discount
          FROM pairline x JOIN orders o ON o.o_orderkey = x.l_orderkey JOIN part p ON p.p_partkey = x.a_partkey
          WHERE a_suppkey <> b_suppkey) AS c""",
    # Statistics of a side over the whole contest; a few second sides are absent.
    "totals": """
        SELECT contest_id, entity_id, dt, period_ended, partkey % 3 AS kd,
          CAST(floor(quantity * (1 - discount)) AS BIGINT) AS sig_l, CAST(quantity AS BIGINT) AS sig_a,
          CAST(floor(quantity * (1 - discount)) AS BIGINT) + linenumber AS total_l,
          CAST(quantity AS BIGINT) + linenumber AS total_a,
          CASE WHEN entity_id % 4 < partkey % 7 THEN entity_id % 4 ELSE partkey % 7 END AS td_l,
          partkey % 7 AS td_a, partkey % 4 AS sub_att, entity_id % 2 AS rev, (partkey * 7) % 120 AS ctrl
        FROM (SELECT contest_id, dt, period_ended, 1 AS side, red_id AS entity_id, a_partkey AS partkey,
                a_linenumber AS linenumber, a_quantity AS quantity, a_discount AS discount FROM contest
              UNION ALL
              SELECT contest_id, dt, period_ended, 2, blue_id, b_partkey, b_linenumber, b_quantity, b_discount
              FROM contest) AS s
        WHERE NOT (side = 2 AND contest_id % 50 = 3)""",
    # The same statistics per period (periods sum to the total).
    "periods": """
        SELECT t.contest_id, t.entity_id, p.period,
          CAST((kd - kd % period_ended) / period_ended AS BIGINT) + CASE WHEN p.period <= kd % period_ended THEN 1 ELSE 0 END AS kd,
          CAST((sig_l - sig_l % period_ended) / period_ended AS BIGINT) + CASE WHEN p.period <= sig_l % period_ended THEN 1 ELSE 0 END AS sig_l,
          CAST((sig_a - sig_a % period_ended) / period_ended AS BIGINT) + CASE WHEN p.period <= sig_a % period_ended THEN 1 ELSE 0 END AS sig_a,
          CAST((td_l - td_l % period_ended) / period_ended AS BIGINT) + CASE WHEN p.period <= td_l % period_ended THEN 1 ELSE 0 END AS td_l,
          CAST((td_a - td_a % period_ended) / period_ended AS BIGINT) + CASE WHEN p.period <= td_a % period_ended THEN 1 ELSE 0 END AS td_a,
          CAST((ctrl - ctrl % period_ended) / period_ended AS BIGINT) + CASE WHEN p.period <= ctrl % period_ended THEN 1 ELSE 0 END AS ctrl
        FROM totals t EACH_PERIOD(t.period_ended)""",
    "entity": """
        SELECT s_suppkey AS entity_id, s_name AS full_name, n_name AS country,
          CASE WHEN s_suppkey % 13 = 5 THEN NULL
               ELSE DATE '1962-01-01' + CAST((s_suppkey * 977) % 9000 AS INT) END AS dob,
          CASE s_suppkey % 5 WHEN 0 THEN 'Southpaw' WHEN 1 THEN 'Switch' WHEN 2 THEN NULL
               WHEN 3 THEN 'Open' ELSE 'Orthodox' END AS stance,
          CASE WHEN s_suppkey % 11 = 4 THEN NULL ELSE 160.0E0 + s_suppkey % 40 END AS height_cm,
          CASE WHEN s_suppkey % 9 = 4 THEN NULL ELSE 150.0E0 + (s_suppkey * 3) % 50 END AS reach_cm
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    # Out-of-fold style predictions: side A by hash, probability from prices and a hash.
    "oof": """
        SELECT contest_id, dt, yr, pool, is_long, a_is_red, odds_red, odds_blue, method, period_ended,
          CASE WHEN a_is_red = 1 THEN red_id ELSE blue_id END AS a_id,
          CASE WHEN a_is_red = 1 THEN blue_id ELSE red_id END AS b_id,
          CASE WHEN (winner_id = red_id) = (a_is_red = 1) THEN 1 ELSE 0 END AS label,
          0.15E0 + 0.7E0 * (CASE WHEN a_is_red = 1 THEN share_red ELSE 1 - share_red END) * 0.6E0
            + 0.28E0 * ((contest_id * 37) % 101) / 100.0E0 AS p
        FROM (SELECT *, CASE WHEN substr(md5(CAST(contest_id AS STRING)), 1, 1) < '8' THEN 1 ELSE 0 END AS a_is_red
              FROM contest WHERE winner_id IS NOT NULL AND method IS NOT NULL AND method <> 'NC') AS c""",
}


def needed(text: str, stored: Container[str] = ()) -> list[str]:
    """Views mentioned in ``text``, dependencies first; those of ``stored`` views are not needed."""
    order: list[str] = []

    def visit(body: str):
        for v in VIEWS:
            if v not in order and re.search(rf"\b(FROM|JOIN)\s+{v}\b", body, re.I):
                if v not in stored:
                    visit(VIEWS[v])
                if v not in order:
                    order.append(v)

    visit(text)
    return order


def _splice(ctes: list[str], text: str) -> str:
    if not ctes:
        return text
    body = text.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _each_period(text: str, form: str) -> str:
    """Rows p.period = 1..n, in the words of the engine."""
    return re.sub(r"EACH_PERIOD\(([^)]*)\)", form, text)


def duck_wrap(text: str) -> str:
    out = _splice([f"{v} AS ({VIEWS[v]})" for v in needed(text)], text)
    return _each_period(out, r", unnest(range(1, \1 + 1)) AS p(period)")


def spark_wrap(text: str, sf_dir: str, stored: Mapping[str, str] = {}) -> str:
    """``stored`` names the files that hold the rows of a view."""
    views = {v: f"SELECT * FROM parquet.`{stored[v]}`" if v in stored else VIEWS[v] for v in needed(text, stored)}
    bodies = [*views.values(), text]
    tables = [t for t in TABLES
              if any(re.search(rf"\b(FROM|JOIN)\s+{t}\b", b, re.I) for b in bodies)]
    ctes = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in tables]
    out = _splice(ctes + [f"{v} AS ({body})" for v, body in views.items()], text)
    return _each_period(out, r"LATERAL VIEW explode(sequence(1, \1)) p AS period")


def spark_text(view: str, sf_dir: str, stored: Mapping[str, str] = {}) -> str:
    return spark_wrap(f"SELECT * FROM {view}", sf_dir, stored)
