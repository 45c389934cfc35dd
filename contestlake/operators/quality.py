"""Data-quality checks as rows (check, status, value, limit)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from contestlake.functions import probability as prob
from contestlake.operators import metrics
from contestlake.operators.history import rated, sides
from contestlake.operators.worklists import prior_counts

SEVERITY = ["PASS", "WARN", "FAIL"]


def check(df: DataFrame, name: str, value: Column, fail: Column, warn: Column | None = None, limit: float | None = None) -> DataFrame:
    status = F.when(fail, "FAIL").when(warn, "WARN").otherwise("PASS") if warn is not None else F.when(fail, "FAIL").otherwise("PASS")
    return df.select(F.lit(name).alias("check"), status.alias("status"), value.cast("double").alias("value"), F.lit(limit).cast("double").alias("limit"))


def totals_coverage(contests: DataFrame, totals: DataFrame) -> DataFrame:
    """Rated contests without totals, and with other than two total rows."""
    per = totals.groupBy("contest_id").agg(F.count("*").alias("n"))
    seen = contests.filter(rated(F.col("method"))).select("contest_id").join(per, "contest_id", "left")
    s = seen.agg(F.count("*").alias("all"), F.count_if(F.col("n").isNull()).alias("none"), F.count_if(F.col("n") != 2).alias("odd"))
    share = F.try_divide(F.col("none"), F.col("all"))
    return check(s, "contests_without_totals", share, share > 0.10, F.col("none") > 0, 0.10).unionByName(
        check(s, "contests_with_odd_totals", F.col("odd"), F.lit(False), F.col("odd") > 0))


def totals_match_periods(totals: DataFrame, periods: DataFrame, counters: list[str], tolerance: int = 2) -> DataFrame:
    """Share of (contest, entity) rows whose total differs from the period sum, per counter and for the worst one."""
    sums = periods.groupBy("contest_id", "entity_id").agg(*[F.sum(c).alias(f"_{c}") for c in counters])
    j = totals.join(sums, ["contest_id", "entity_id"])
    s = j.agg(F.count("*").alias("n"), *[F.count_if(F.abs(F.col(c) - F.col(f"_{c}")) > tolerance).alias(c) for c in counters])
    worst = F.greatest(*[F.col(c) for c in counters]) / F.col("n")
    return check(s, "totals_differ_from_periods", worst, F.lit(False), worst > 0.05, 0.05)


def null_keys(df: DataFrame, key: str, name: str) -> DataFrame:
    s = df.agg(F.count_if(F.col(key).isNull()).alias("n"))
    return check(s, name, F.col("n"), F.col("n") > 0, limit=0)


def orphans(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    s = child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n"))
    return check(s, name, F.col("n"), F.col("n") > 0, limit=0)


def shape(df: DataFrame, least: int, most: int, columns: int) -> DataFrame:
    s = df.agg(F.count("*").alias("n"))
    return check(s, "matrix_rows", F.col("n"), ~F.col("n").between(least, most)).unionByName(
        check(s, "matrix_columns", F.lit(len(df.columns)), F.lit(len(df.columns) < columns), limit=columns))


def null_shares(df: DataFrame, columns: list[str], warn: float = 30.0, fail: float = 60.0) -> DataFrame:
    """NULL percentage of every column in one pass."""
    s = df.agg(*[(100.0 * F.avg(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    long = s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("pct")) for c in columns])))
    return long.withColumn("status", F.when(F.col("pct") > fail, "FAIL").when(F.col("pct") > warn, "WARN").otherwise("PASS"))


def chronological(df: DataFrame) -> DataFrame:
    """Rows out of day order in stored order ``seq``."""
    s = metrics.out_of_order(df)
    share = F.try_divide(F.col("out_of_order"), F.col("n"))
    return check(s, "rows_out_of_order", F.col("out_of_order"), share > 0.05, F.col("out_of_order") > 0)


def at_most_twice(df: DataFrame) -> DataFrame:
    s = df.groupBy("contest_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 2).alias("n"))
    return check(s, "contests_more_than_twice", F.col("n"), F.col("n") > 0, limit=0)


def centred(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of every difference column against a tenth of its deviation."""
    s = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")).alias(c) for c in columns])
    long = s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.sd").alias("sd")) for c in columns])))
    return long.withColumn("status", F.when((F.col("sd") > 0) & (F.abs("mean") > 0.1 * F.col("sd")), "WARN").otherwise("PASS"))


def shadowing(spark, features: list[str], after: list[str]) -> DataFrame:
    both = spark.createDataFrame([(features, after)], "f array<string>, a array<string>").select(F.size(F.array_intersect("f", "a")).alias("n"))
    return check(both, "features_shadow_results", F.col("n"), F.col("n") > 0, limit=0)


def recount(contests: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored prior counts (entity_id, dt, n_contests) against a recount over the whole table."""
    again = prior_counts(contests, stored.select("entity_id", "dt"))
    s = stored.join(again, ["entity_id", "dt"]).agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("n_contests") - F.col("n_before")) > 1).alias("bad"))
    share = F.try_divide(F.col("bad"), F.col("n"))
    return check(s, "prior_count_differs", share, share > 0.10, limit=0.10)


def quote_documents(docs: DataFrame, required: list[str], known: list[str]) -> DataFrame:
    """Documents (contest_id, markets map) lacking a required market, and the keys nobody expects."""
    keys = F.map_keys("markets")
    want, have = F.array(*[F.lit(k) for k in required]), F.array(*[F.lit(k) for k in known])
    s = docs.agg(F.count_if(F.size(F.array_except(want, keys)) > 0).alias("lacking"), F.count_if(F.size(F.array_except(keys, have)) > 0).alias("unknown"))
    return check(s, "documents_lacking_market", F.col("lacking"), F.lit(False), F.col("lacking") > 0).unionByName(
        check(s, "documents_with_unknown_market", F.col("unknown"), F.lit(False), F.col("unknown") > 0))


def oof_guard(oof: DataFrame, required: list[str], fail_above: float = 0.6620, warn_above: float = 0.6600) -> DataFrame:
    lacking = [c for c in required if c not in oof.columns]
    s = oof.agg(F.avg(prob.log_loss(F.col("label"), F.col("p"))).alias("ll"))
    return check(s, "oof_columns", F.lit(len(lacking)), F.lit(bool(lacking)), limit=0).unionByName(
        check(s, "oof_log_loss", F.col("ll"), F.col("ll") > fail_above, F.col("ll") > warn_above, fail_above))


def overall(checks: list[DataFrame]) -> DataFrame:
    """Counts per status and the worst status."""
    rows = reduce(DataFrame.unionByName, checks)
    level = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    return rows.agg(F.count("*").alias("checks"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in SEVERITY],
                    F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.max(level) + 1).alias("overall"))


def duplicate_sides(contests: DataFrame) -> DataFrame:
    """Entities that appear on both sides of one contest."""
    s = sides(contests, "contest_id").filter("entity_id = opponent_id").agg(F.count("*").alias("n"))
    return check(s, "same_entity_on_both_sides", F.col("n"), F.col("n") > 0, limit=0)
