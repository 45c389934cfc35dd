"""Exact joins: keys, windows of days, priorities and overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from contestlake.functions import names
from contestlake.operators import upsert


def by_name(rows: DataFrame, entities: DataFrame, *columns: str) -> DataFrame:
    """Entity ids of several name columns; names that belong to several entities stay unresolved."""
    keyed = entities.select(names.name_key(F.col("full_name")).alias("_k"), "entity_id").groupBy("_k").agg(
        F.min("entity_id").alias("_id"), F.max("entity_id").alias("_hi")).filter("_id = _hi").drop("_hi")
    out = rows
    for c in columns:
        k = keyed.select(F.col("_k").alias(f"_k_{c}"), F.col("_id").alias(f"{c}_id"))
        out = out.withColumn(f"_k_{c}", names.name_key(F.col(c))).join(k, f"_k_{c}", "left").drop(f"_k_{c}")
    return out


def missing(fresh: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return fresh.join(stored.select(*keys), list(keys), "left_anti")


def load_steps(fresh: list[DataFrame], stored: list[DataFrame], keys: list[list[str]]) -> list[DataFrame]:
    """Tables of one load in dependency order: stored rows plus the new ones, so a rerun adds nothing."""
    return [s.unionByName(missing(upsert.one_each(f, k), s, *k)) for f, s, k in zip(fresh, stored, keys)]


def pair_key(a: Column, b: Column) -> Column:
    """The same key for (x, y) and (y, x)."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def near_days(left: DataFrame, right: DataFrame, keys: list[str], days: int, left_dt: str = "dt", right_dt: str = "dt") -> DataFrame:
    """Pairs with equal keys at most ``days`` apart, with the gap; right columns get the prefix r_.

    Days fall into buckets one window wide; a left row looks into its own and the
    two adjoining ones.  A key that holds most rows is thus spread over time, and
    only rows of adjoining buckets ever meet.
    """
    width = days + 1
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_bucket", F.floor(F.unix_date(f"r_{right_dt}") / width))
    l = left.withColumn("_bucket", F.explode(F.array(*[F.floor(F.unix_date(left_dt) / width) + i for i in (-1, 0, 1)])))
    on = reduce(lambda x, y: x & y, [l[k] == F.col(f"r_{k}") for k in keys], l["_bucket"] == r["_bucket"])
    gap = F.abs(F.date_diff(F.col(left_dt), F.col(f"r_{right_dt}")))
    return l.join(r, on).drop("_bucket").withColumn("gap", gap).filter(F.col("gap") <= days)


def days_around(rows: DataFrame, days: int) -> DataFrame:
    """Every day at most ``days`` from the day of a row, once."""
    own = rows.select("dt").distinct().filter("dt IS NOT NULL")
    return own.select(F.explode(F.sequence(F.date_sub("dt", days), F.date_add("dt", days))).alias("dt")).distinct()


def nearest(pairs: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Closest right row per left row, the smallest key on ties; limited in every task."""
    w = Window.partitionBy(left_key).orderBy("gap", right_key)
    return pairs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def attach_prices(quotes: DataFrame, contests: DataFrame, days: int = 3) -> DataFrame:
    """Prices of quoted pairs on the contest of the same two names within the day window, oriented to red."""
    q = quotes.withColumn("pair", pair_key(names.name_key(F.col("name1")), names.name_key(F.col("name2"))))
    c = contests.withColumn("pair", pair_key(names.name_key(F.col("red_name")), names.name_key(F.col("blue_name"))))
    hit = nearest(near_days(q, c, ["pair"], days), "quote_id", "r_contest_id")
    same = names.name_key(F.col("name1")) == names.name_key(F.col("r_red_name"))
    return hit.select("quote_id", F.col("r_contest_id").alias("contest_id"), "gap", (~same).cast("int").alias("flipped"),
                      F.when(same, F.col("price1")).otherwise(F.col("price2")).alias("price_red"),
                      F.when(same, F.col("price2")).otherwise(F.col("price1")).alias("price_blue"))


def canonical_market(market: Column, flipped: Column) -> Column:
    """f1_/f2_ prefixes of a quote become r_/b_ of the contest."""
    first, second = F.when(flipped == 1, "b_").otherwise("r_"), F.when(flipped == 1, "r_").otherwise("b_")
    return (F.when(market.startswith("f1_"), F.concat(first, F.substring(market, 4, 200)))
            .when(market.startswith("f2_"), F.concat(second, F.substring(market, 4, 200))).otherwise(market))


def by_priority(records: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match records to entities by source id, then unique name, then unique loose name or same birth day.

    Returns (record_id, entity_id, rule) and the records left for review.
    """
    r = records.withColumns({"_name": names.name_key(F.col("name")), "_loose": names.surname_initial(F.col("name"))})
    e = entities.withColumns({"_name": names.name_key(F.col("full_name")), "_loose": names.surname_initial(F.col("full_name"))})

    def unique(key):
        return e.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")

    exact = r.join(e.filter("source_id IS NOT NULL").groupBy("source_id").agg(F.min("entity_id").alias("_e1")), "source_id", "left")
    exact = exact.join(unique("_name").withColumnRenamed("entity_id", "_e2"), "_name", "left")
    exact = exact.join(unique("_loose").withColumnRenamed("entity_id", "_e3"), "_loose", "left")
    born = e.filter("dob IS NOT NULL").groupBy("_loose", "dob").agg(F.min("entity_id").alias("_e4"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    exact = exact.join(born, ["_loose", "dob"], "left")
    rule = F.when(F.col("_e1").isNotNull(), 1).when(F.col("_e2").isNotNull(), 2).when(F.coalesce("_e3", "_e4").isNotNull(), 3)
    got = exact.select("record_id", F.coalesce("_e1", "_e2", "_e3", "_e4").alias("entity_id"), rule.alias("rule"))
    matched = got.filter("entity_id IS NOT NULL")
    return matched, records.join(matched.select("record_id"), "record_id", "left_anti")


def overlay(rows: DataFrame, fixes: DataFrame, key: str, *columns: str) -> DataFrame:
    """Non-empty values of a reviewed file win."""
    f = fixes.select(key, *[F.nullif(F.trim(c), F.lit("")).alias(f"_f_{c}") for c in columns])
    return rows.join(f, key, "left").withColumns({c: F.coalesce(F.col(f"_f_{c}"), F.col(c)) for c in columns}).drop(*[f"_f_{c}" for c in columns])


def fill_missing(rows: DataFrame, other: DataFrame, key: str, columns: list[str], force: bool = False) -> DataFrame:
    """Absent attributes from another source; ``force`` lets the other source win."""
    o = other.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    take = (lambda c: F.coalesce(F.col(f"_o_{c}"), F.col(c))) if force else (lambda c: F.coalesce(F.col(c), F.col(f"_o_{c}")))
    return rows.join(o, key, "left").withColumns({c: take(c) for c in columns}).drop(*[f"_o_{c}" for c in columns])


def merge_duplicates(rows: DataFrame, key: Column, columns: list[str], tie: str) -> DataFrame:
    """One record per key, each field from the fullest record that has it.

    ``min_by`` per field is an ordinary aggregate: nothing is gathered per key.
    """
    clean = rows.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in columns}).withColumn("_key", key)
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    ranked = clean.withColumn("_rank", F.struct((-filled).alias("f"), F.col(tie).alias("t")))
    return ranked.groupBy("_key").agg(F.count("*").alias("n"), *[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in columns]).withColumnRenamed("_key", "key")


def fallback(rows: DataFrame, schedule: DataFrame, columns: list[str]) -> DataFrame:
    """Blank columns from the schedule entry of the same unordered pair."""
    s = upsert.one_each(schedule.select("pair", *[F.col(c).alias(f"_s_{c}") for c in columns]), ["pair"])
    return rows.join(s, "pair", "left").withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_s_{c}")) for c in columns}).drop(
        *[f"_s_{c}" for c in columns])


def with_override(rows: DataFrame, overrides: DataFrame, aliases: DataFrame) -> DataFrame:
    """Own value, else the override of the name, else the override of its alias."""
    o1 = overrides.select(F.col("name"), F.col("value").alias("_v1"))
    al = aliases.select("name", "alias")
    o2 = overrides.select(F.col("name").alias("alias"), F.col("value").alias("_v2"))
    return (rows.join(o1, "name", "left").join(al, "name", "left").join(o2, "alias", "left")
            .withColumn("value", F.coalesce(F.nullif("value", F.lit("")), "_v1", "_v2")).drop("_v1", "_v2", "alias"))


def preview(schedule: DataFrame, entities: DataFrame, *attributes: str) -> DataFrame:
    """Schedule entries with attributes of both sides and a status."""
    out = schedule
    for s in ("red", "blue"):
        e = upsert.one_each(entities.select(names.name_key(F.col("full_name")).alias("_k"), *[F.col(a).alias(f"{s}_{a}") for a in attributes]), ["_k"])
        out = out.withColumn("_k", names.name_key(F.col(f"{s}_name"))).join(e, "_k", "left").drop("_k")
    status = F.when(F.col("is_cancelled"), "cancelled").when(F.col("winner_id").isNotNull(), "final").otherwise("scheduled")
    return out.withColumn("status", status)


def one_per_contest(rows: DataFrame, red_only: bool = False) -> DataFrame:
    base = rows.filter("a_is_red = 1") if red_only else rows
    w = Window.partitionBy("contest_id").orderBy(*[c for c in ("a_is_red",) if c in rows.columns] or ["contest_id"])
    return base.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def side_totals(contests: DataFrame, totals: DataFrame, counters: list[str]) -> DataFrame:
    """Totals of both sides on one row, keyed A/B; contests lacking a side are left out."""
    t = totals.select("contest_id", "entity_id", *counters)
    rows = contests.select("contest_id", "a_id", "b_id").join(t, "contest_id")
    agg = rows.groupBy("contest_id").agg(
        F.count("*").alias("_n"), *[F.max(F.when(F.col("entity_id") == F.col(f"{s}_id"), F.col(c))).alias(f"{s}_{c}") for s in "ab" for c in counters])
    both = agg.filter("_n = 2").drop("_n")
    return both.withColumns({f"both_{c}": F.col(f"a_{c}") + F.col(f"b_{c}") for c in counters})
