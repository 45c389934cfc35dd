"""The scalar library as SQL functions, so SQL text can use the same arithmetic."""

from __future__ import annotations

from contestlake.functions import names

# Bodies in Spark SQL; they inline into the plan like any expression.
FUNCTIONS = {
    "american_to_implied(o DOUBLE)": "CASE WHEN o >= 0 THEN 100D / (o + 100D) ELSE -o / (100D - o) END",
    "american_to_decimal(o DOUBLE)": "CASE WHEN o >= 0 THEN o / 100D + 1D ELSE 100D / abs(o) + 1D END",
    "decimal_to_implied(d DOUBLE)": "CASE WHEN d <= 0 THEN 1D ELSE 1D / d END",
    "fair_share(p DOUBLE, q DOUBLE)": "try_divide(p, p + q)",
    "expected_value(p DOUBLE, d DOUBLE)": "p * d - 1D",
    "kelly_stake(p DOUBLE, d DOUBLE)": "CASE WHEN d > 1 THEN greatest(0D, ((d - 1D) * p - (1D - p)) / (d - 1D) * 0.25D) ELSE 0D END",
    "log_loss(y INT, p DOUBLE)": "-CASE WHEN y = 1 THEN ln(least(greatest(p, 1E-7D), 1D - 1E-7D)) ELSE ln(1D - least(greatest(p, 1E-7D), 1D - 1E-7D)) END",
    "brier(y INT, p DOUBLE)": "(p - y) * (p - y)",
    "elo_expected(diff DOUBLE)": "1D / (1D + pow(10D, -diff / 400D))",
    "name_key(n STRING)": names.KEY_SQL.format("n"),
}


def register(spark) -> None:
    for signature, body in FUNCTIONS.items():
        kind = "STRING" if signature.startswith("name_key") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
