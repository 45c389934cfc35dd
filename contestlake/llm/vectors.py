"""Vectors as packed rows, and the blocks that searches over them share."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def usable(vectors: DataFrame, vec_id: str, embedding: str, zero: bool) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part: with an id, no null or non-finite component and,
    unless ``zero``, a component other than zero."""
    v = F.col(embedding).cast("array<double>")
    out = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.filter(fine if zero else fine & F.exists("v", lambda x: x != 0))


def padded(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows with vectors filled up with zeros to the longest one; its length; the number of rows."""
    found = rows.agg(F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    d, n = found["d"] or 0, found["n"]
    fill = F.when(F.size("v") < d, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("v")))).otherwise(F.col("v"))
    return rows.withColumn("v", fill), d, n


def chunk(chunks: int, *columns: str) -> Column:
    """A query's chunk, by hash; repeated rows share one."""
    return F.pmod(F.xxhash64(F.lit(11), *columns), F.lit(chunks)).cast("int")


def each(n: int) -> Column:
    """One row for every number below n."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)


def stack(column, width: int) -> np.ndarray:
    """Rows of a pandas or Arrow column of arrays as a matrix of doubles."""
    return np.array(list(column), np.float64).reshape(len(column), width)


def repeats(ids: np.ndarray) -> int:
    """How often the most frequent id occurs; that many times k rows hold k different ids."""
    return int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 1


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of different ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    _, at = np.unique(ids[order], return_index=True)
    return order[np.sort(at)[:k]]


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to the smaller id."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
