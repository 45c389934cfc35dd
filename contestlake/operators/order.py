"""Global order without a global task: ranks and running totals by range bins.

A bin is a contiguous range of the order key.  Bins are totalled, the short bin
table gets running totals, and rows are only ever ordered inside their own bin.
Bin edges come from an approximate quantile sketch; they steer balance only,
the results are exact for any edges.
"""

from __future__ import annotations

import os

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

BINS = 64


def sortable(df: DataFrame, key: str) -> Column:
    """A number that ascends with the key: numbers themselves, text by the six bytes that follow what all values share."""
    if dict(df.dtypes)[key] != "string":
        return F.col(key).cast("double")
    ends = df.agg(F.min(key), F.max(key)).first()
    shared = len(os.path.commonprefix([(e or "").encode() for e in ends]))
    digits = F.rpad(F.hex(F.substring(F.encode(key, "UTF-8"), shared + 1, 6)), 12, "0")
    return F.conv(digits, 16, 10).cast("double")


def with_bin(df: DataFrame, key: str, out: str = "bin", bins: int = BINS) -> DataFrame:
    """Range bin of a numeric key, roughly equal in rows."""
    probs = [i / bins for i in range(1, bins)]
    cuts = sorted(set(df.stat.approxQuantile(key, probs, 0.25 / bins)))
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=key, outputCol=out, handleInvalid="keep").transform(
        df.withColumn(key, F.col(key).cast("double")))


def running(df: DataFrame, groups: list[str], bin_cols: list[str], order: list[str], measures: dict[str, str]) -> DataFrame:
    """Total of each measure over all earlier rows of the group, in the order (bin_cols, order).

    ``bin_cols`` must sort like ``order``.
    """
    none = F.lit(0)
    totals = df.groupBy(*groups, *bin_cols).agg(*[F.sum(m).alias(f"_t_{o}") for o, m in measures.items()])
    across = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy(*bin_cols).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, *bin_cols, *[
        F.coalesce(F.sum(f"_t_{o}").over(across), none).alias(f"_o_{o}") for o in measures])
    inside = Window.partitionBy(*groups, *bin_cols).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    here = df.withColumns({f"_i_{o}": F.coalesce(F.sum(m).over(inside), none) for o, m in measures.items()})
    return (here.join(offsets, [*groups, *bin_cols])
            .withColumns({o: F.col(f"_o_{o}") + F.col(f"_i_{o}") for o in measures})
            .drop(*[f"_{p}_{o}" for o in measures for p in "oi"]))


def by_day(df: DataFrame, id_col: str, bins: int = 8) -> DataFrame:
    """Bins for the order (dt, id): the day, split further by ranges of the id."""
    return with_bin(df.withColumn("_id", sortable(df, id_col)), "_id", "id_bin", bins).drop("_id")


def position(df: DataFrame, id_col: str, bins: int = 8) -> DataFrame:
    """Zero-based position of each row in the order (dt, id), and the row count."""
    binned = by_day(df, id_col, bins).withColumn("_one", F.lit(1).cast("bigint"))
    placed = running(binned, [], ["dt", "id_bin"], [id_col], {"pos": "_one"})
    return placed.withColumn("total", df.select(F.count("*")).scalar()).drop("_one", "id_bin")


def quantiles(df: DataFrame, groups: list[str], value: str, level: Column, bins: int = BINS) -> DataFrame:
    """Exact interpolated quantile per group at a level that may depend on the count ``n``.

    Equal values are counted first, so a value shared by many rows is one row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("c"))
    ranked = running(with_bin(counts, value, "bin", bins), groups, ["bin"], [value], {"start": "c"})
    present = df.filter(F.col(value).isNotNull())
    if groups:
        sized = ranked.join(present.groupBy(*groups).agg(F.count("*").alias("n")), groups)
    else:
        sized = ranked.withColumn("n", present.select(F.count("*")).scalar())
    at = sized.withColumn("level", F.least(level, F.lit(1.0))).withColumn("at", (F.col("n") - 1) * F.col("level"))
    lo, hi = F.floor("at"), F.least(F.floor("at") + 1, F.col("n") - 1)
    end = F.col("start") + F.col("c")
    picked = at.groupBy(*groups, "n").agg(
        F.max(F.when((F.col("start") <= lo) & (lo < end), F.col(value))).alias("_lo"),
        F.max(F.when((F.col("start") <= hi) & (hi < end), F.col(value))).alias("_hi"),
        F.max(F.col("at") - lo).alias("_part"))
    return picked.select(*groups, "n", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("q"))


def carry_last(df: DataFrame, groups: list[str], seq: str, value: str, out: str, size: int = 1000, positions: DataFrame | None = None) -> DataFrame:
    """Newest non-NULL value before each row of the group, by its position ``seq`` in the group.

    A group is cut into runs of ``size`` positions; only the newest value of each run
    crosses over to the next ones.  ``positions`` are the same rows before costly columns were
    added: a pass over them finds out whether any row lies outside the first run, and if none does, ``df`` is read once.
    """
    run = F.floor(F.col(seq) / size)
    if positions is not None and positions.select(run.alias("_bin")).filter("_bin <> 0 OR _bin IS NULL").isEmpty():
        before = Window.partitionBy(*groups).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.last(value, True).over(before))
    binned = df.withColumn("_bin", run)
    tops = binned.filter(F.col(value).isNotNull()).groupBy(*groups, "_bin").agg(F.max_by(value, seq).alias("_top"))
    # every later run must see it, so runs without any value are listed too
    runs = binned.select(*groups, "_bin").distinct().join(tops, [*groups, "_bin"], "left")
    across = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    earlier = runs.select(*groups, "_bin", F.last("_top", True).over(across).alias("_earlier")).filter("_earlier IS NOT NULL")
    inside = Window.partitionBy(*groups, "_bin").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    here = binned.withColumn("_here", F.last(value, True).over(inside))
    return (here.join(earlier, [*groups, "_bin"], "left").withColumn(out, F.coalesce("_here", "_earlier"))
            .drop("_bin", "_here", "_earlier"))
