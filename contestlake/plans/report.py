"""The evaluation report as one long table, and quotes attached by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contestlake.functions import names, odds
from contestlake.operators import backtest, metrics


def _long(df: DataFrame, section: str, key: str | None, values: list[str]) -> DataFrame:
    if key is None:
        return df.select(F.lit(section).alias("section"), F.inline(F.array(*[
            F.struct(F.lit(v).alias("key"), F.col(v).cast("double").alias("value")) for v in values])))
    return df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.col(values[0]).cast("double").alias("value"))


def evaluation(oof: DataFrame) -> DataFrame:
    """Overall scores, reliability, yearly log-loss and the closing-line benchmark."""
    parts = [
        _long(metrics.binary(oof, []), "metrics", None, ["n", "log_loss", "brier", "accuracy", "auc"]),
        _long(metrics.reliability(oof), "reliability", "slot", ["observed"]),
        _long(metrics.binary(oof, ["yr"]), "yearly_log_loss", "yr", ["log_loss"]),
        _long(backtest.closing_line(oof), "closing_line", None, ["line_log_loss"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attach_quotes(predictions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Implied probability and stake for predictions whose normalised name is quoted."""
    q = quotes.select(names.name_key(F.col("name")).alias("_k"), "price", "prob")
    return (predictions.withColumn("_k", names.name_key(F.col("name"))).join(q, "_k")
            .withColumns({"implied": odds.decimal_to_implied(F.col("price")), "stake": odds.kelly_stake(F.col("prob"), F.col("price"))}).drop("_k"))
