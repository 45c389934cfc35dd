"""Predicates and work lists: what to score, grade or refresh."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from contestlake.operators.history import sides

PLACEHOLDERS = ["tba", "tbd", ""]
# fixed values: statuses after which a contest is over
TERMINAL = ["KO/TKO", "SUB"]
FRESH_HOURS = 36


def prior_counts(contests: DataFrame, requests: DataFrame) -> DataFrame:
    """Contests of an entity strictly before a day, from day totals and one running sum."""
    days = sides(contests, "dt").groupBy("entity_id", "dt").agg(F.count("*").alias("n"))
    asked = days.join(requests.withColumn("asked", F.lit(True)), ["entity_id", "dt"], "full")
    running = asked.selectExpr("entity_id", "dt", "asked", "coalesce(sum(n) OVER (PARTITION BY entity_id ORDER BY dt "
                               "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_before")
    return running.filter("asked").drop("asked")


def scorable(schedule: DataFrame, today: Column) -> DataFrame:
    """Upcoming, not cancelled, both sides resolved."""
    return schedule.filter((F.col("event_date") >= today) & ~F.col("is_cancelled")
                           & F.col("red_id").isNotNull() & F.col("blue_id").isNotNull())


def known_name(name: Column) -> Column:
    return ~F.lower(F.trim(name)).isin(PLACEHOLDERS)


def lacking(rows: DataFrame, *attributes: str) -> DataFrame:
    return rows.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in attributes]))


def informative(prob: Column) -> Column:
    """A placeholder probability near one half is left ungraded."""
    return F.when(F.abs(prob - 0.5) >= 0.005, prob)


def events_lacking(contests: DataFrame, first: str, last: str) -> DataFrame:
    return (contests.filter(F.col("dt").between(first, last)).groupBy("dt")
            .agg(F.count("*").alias("n"), F.count_if(F.col("odds_red").isNull()).alias("n_missing"))
            .filter("n_missing > 0"))


def events_having(contests: DataFrame, first: str, last: str) -> DataFrame:
    return contests.filter(F.col("dt").between(first, last) & F.col("odds_red").isNotNull()).select("dt").distinct()


def refresh(sources: list[DataFrame], cache: DataFrame, attribute: str) -> DataFrame:
    """Distinct names of all sources whose cached record is absent or lacks the attribute."""
    wanted = reduce(DataFrame.union, [s.select("name") for s in sources]).distinct()
    known = cache.filter(F.col(attribute).isNotNull()).select("name")
    return wanted.join(known, "name", "left_anti")


def with_market(contests: DataFrame, market: str, *names: str) -> DataFrame:
    present = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    return contests.filter(F.array_contains(F.map_keys("markets"), market) & present)


def cache_age(docs: DataFrame, fetched: str, now: Column) -> DataFrame:
    age = (F.unix_micros(now) - F.unix_micros(F.col(fetched))) / F.lit(3.6e9)
    return docs.withColumn("age_hours", age).withColumn("usable", F.col("age_hours") < FRESH_HOURS)


def display_classes(rows: DataFrame) -> DataFrame:
    """Report classes of a prediction: confidence, data quality, favourite, style, streak."""
    width, n, p = F.abs(F.col("p") - 0.5) * 0.3, F.col("period_ended") * 3, F.col("p")
    return rows.select(
        "contest_id",
        F.when(width < 0.07, "High").when(width < 0.12, "Medium").otherwise("Low").alias("tier"),
        F.when(n >= 10, "good").when(n >= 5, "limited").otherwise("poor").alias("quality"),
        F.when(F.abs(p - 0.5) < 0.03, "toss-up").when(p > 0.5, "A").otherwise("B").alias("favourite"),
        style_class(p >= 0.55, F.col("period_ended") >= 3).alias("style"),
        streak_class(F.when(F.col("period_ended") >= 3, F.col("period_ended")), F.when(F.col("period_ended") == 2, F.lit(2))).alias("streak"),
        F.when(p > 0.5, "better/worse").when(p < 0.5, "worse/better").otherwise("even/even").alias("better"),
        (~F.col("method").isin(TERMINAL)).cast("int").alias("live"))


def style_class(strikes: Column, grapples: Column) -> Column:
    return F.when(strikes & ~grapples, "striker").when(grapples & ~strikes, "grappler").otherwise("balanced")


def streak_class(wins: Column, losses: Column) -> Column:
    return F.when(wins >= 2, "win-streak").when(losses >= 2, "loss-streak").otherwise("none")
