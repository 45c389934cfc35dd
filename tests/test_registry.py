"""Registered queries: names, twins, and a spread of them against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from workload.views import TABLES

SF = "/root/testdata/sf0.001"
SPREAD = ["parse_stat_cells", "name_keys", "asof_career_rates", "asof_recent_form", "pool_means", "exact_auc", "chronological_split", "conformal_by_pool", "edge_buckets",
          "bankroll_history", "over_probability", "compatible_legs", "prices_by_pair_and_window", "merged_duplicates", "upserted_schedule", "audit_totals_coverage",
          "name_scores", "best_price_key", "label_sides", "keyword_rules", "document_selections"]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["entity_id", "dt", "n_contests"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SPREAD)
def test_twin(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = duck.execute(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    at = {d[0]: i for i, d in enumerate(rel.description)}
    assert sorted(at) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(r[at[c]] for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want
    assert not any(isinstance(v, float) and math.isnan(v) for r in got for v in r)
