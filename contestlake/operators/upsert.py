"""Dedup, set operations and upserts; "newest wins" is always a top-1 per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order; Spark limits every task to one row per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the smallest by the other columns, so that reruns agree."""
    return newest(rows, keys, [F.col(f"`{c}`").asc_nulls_last() for c in rows.columns if c not in keys] or [F.lit(1)])


def replace(stored: DataFrame, fresh: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Insert-or-replace: fresh rows beat stored ones, later stamps beat earlier ones."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return newest(both, keys, [F.col("_new").desc(), F.col(stamp).desc()]).drop("_new")


def upsert_schedule(stored: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """New contests are added; known ones only renew their time, cancel flag and flags that turn true.

    Repeats inside the batch are combined first.  The cancel flag of a known contest is that of the batch (false if the
    batch has no such column); a new one is not cancelled.
    """
    called_off = F.coalesce(F.bool_or("is_cancelled"), F.lit(False)) if "is_cancelled" in fresh.columns else F.lit(False)
    batch = fresh.groupBy("scheduled_id").agg(
        F.min("event_name").alias("event_name"), F.bool_or("is_title").alias("is_title"), F.bool_or("is_long").alias("is_long"), called_off.alias("called_off"))
    s = stored.select("scheduled_id", *[F.col(c).alias(f"_{c}") for c in ("event_name", "is_title", "is_long", "is_cancelled", "first_seen", "last_updated")])
    j = s.join(batch.withColumn("_hit", F.lit(True)), "scheduled_id", "full")
    hit = F.coalesce("_hit", F.lit(False))
    no = F.lit(False)
    return j.select(
        "scheduled_id", F.coalesce("_event_name", "event_name").alias("event_name"),
        (F.coalesce("_is_title", no) | F.coalesce("is_title", no)).alias("is_title"), (F.coalesce("_is_long", no) | F.coalesce("is_long", no)).alias("is_long"),
        F.when(hit & F.col("_first_seen").isNotNull(), F.col("called_off")).when(hit, no).otherwise(F.col("_is_cancelled")).alias("is_cancelled"), F.coalesce("_first_seen", now).alias("first_seen"),
        F.when(hit, now).otherwise(F.col("_last_updated")).alias("last_updated"), F.col("_first_seen").isNull().alias("is_new"))


def accumulate(stored: DataFrame, fresh: DataFrame, key: str, today: Column) -> DataFrame:
    """Past predictions by id, fresh beats stored, newest first."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return newest(both, [key], [F.col("_new").desc()]).drop("_new").filter(F.col("dt") < today).orderBy(F.col("dt").desc(), key)


def merge_results(history: DataFrame, live: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Live values overwrite history where they are present; rows only in one side are kept."""
    l = live.select(*keys, *[F.col(c).alias(f"_l_{c}") for c in columns])
    return history.join(l, keys, "full").select(*keys, *[F.coalesce(F.col(f"_l_{c}"), F.col(c)).alias(c) for c in columns])


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of the first source, and of the second for keys the first lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))
