"""Exact top-k: an impact-ordered index read score at a time, with proofs for stopping."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from contestlake.functions.plan import durable
from contestlake.llm import vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block of the index; queries that read it together; possible members at which reading stops; queries of a task.
BLOCK, TOGETHER, POSSIBLE, ASKED = 4_096, 128, 160, 16_384
#: Share of all components, as one in so many, from which the segments of an impact are read as a matrix.
CROWDED = 64
SCALE = 64


class Index:
    """Postings of a block of integer vectors, by component, in segments of descending quantised impact.

    The quantised impact of a component is the bit length of its magnitude; a segment (impact, component)
    lists the rows and exact values.  Segments of one impact that hold over one in ``CROWDED`` of all components
    lie in one matrix, with zeros between them, and are read as one product.  ``rest`` holds, for each impact, the norm of what is left of each row
    once the segments of that and higher impacts have been read.
    """

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        impact = np.frexp(np.abs(rows))[1] * (rows != 0)
        self.impacts = sorted(set(np.unique(impact).tolist()) - {0}, reverse=True)
        self.segments, self.rest = {}, {}
        for level in self.impacts:
            here = impact == level
            if here.sum() * CROWDED > here.size:
                self.segments[level] = np.where(here, rows, 0.0)
            else:
                self.segments[level] = [(d, at, rows[at, d][:, None]) for d in range(rows.shape[1]) if len(at := np.flatnonzero(here[:, d]))]
            left = np.where(impact < level, rows, 0.0)
            self.rest[level] = np.sqrt((left * left).sum(axis=1))

    def possible(self, queries: np.ndarray, own: np.ndarray, k: int, enough: int = POSSIBLE):
        """For each query the rows that may be among its k best: (query, rows).

        ``own`` marks, per row and query, the pairs that do not count.  Segments are read by descending impact.
        By the inequality of Cauchy and Schwarz a score lies within rest * |query| of what was read, so a row
        whose upper bound is below the k-th largest lower bound is no member; that is the proof for stopping.
        """
        n = len(self.rows)
        norm = np.sqrt((queries * queries).sum(axis=1))
        read = np.zeros((n, len(queries)))
        active = np.arange(len(queries))
        weights = queries.T.copy()
        for level in self.impacts:
            if isinstance(self.segments[level], np.ndarray):
                read += self.segments[level] @ weights
            else:
                for d, at, value in self.segments[level]:
                    read[at] += value * weights[d]
            done = level == self.impacts[-1]
            slack = self.rest[level][:, None] * norm[active] * (1 + 1e-12) + (0 if done else 1e-6)
            if not done and np.median(slack) * 4 > np.median(norm) * SCALE:
                continue  # nothing can be proved yet
            low, high = np.where(own[:, active], -np.inf, read - slack), np.where(own[:, active], -np.inf, read + slack)
            floor = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(active), -np.inf)
            may = (high >= floor) & ~own[:, active]
            stop = done | (may.sum(axis=0) <= enough)
            for j in np.flatnonzero(stop):
                yield int(active[j]), np.flatnonzero(may[:, j])
            if done or stop.all():
                return
            active, read, weights = active[~stop], read[:, ~stop], weights[:, ~stop]
        if not self.impacts:
            for j in range(len(queries)):
                yield j, np.flatnonzero(~own[:, j])


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> pd.DataFrame:
    index, out, deep = Index(rows), [], k * vectors.repeats(row_ids)
    whole = rows.astype(np.int64)
    for at in range(0, len(queries), TOGETHER):
        part, ids = queries[at:at + TOGETHER], query_ids[at:at + TOGETHER]
        for j, near in index.possible(part, row_ids[:, None] == ids[None, :], deep, max(POSSIBLE, 2 * deep)):
            score = whole[near] @ part[j].astype(np.int64)
            first = vectors.first(row_ids[near], score, k)
            out.append((np.full(len(first), ids[j]), row_ids[near][first], score[first]))
    ids, vecs, scores = (np.concatenate(c) for c in zip(*out)) if out else ([], [], [])
    return pd.DataFrame({"query_id": np.asarray(ids, np.int64), "vec_id": np.asarray(vecs, np.int64), "score": np.asarray(scores, np.int64)})


def exact(table: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k rows of largest integer inner product, ties to the smaller id.

    Components become floor(64 x).  Vectors that are null or hold null or non-finite components take no part, nor
    do rows without id; shorter vectors are filled up with zeros; zero vectors take part; repeated ids count once,
    with their best score.  Scores must stay below 2^53.  Rows are dealt by hash into blocks of like size, and queries
    into chunks; a task indexes one block for the queries of one chunk, and every chunk reads every block.
    """
    rows, width, n = vectors.padded(vectors.usable(table, vec_id, embedding, zero=True))
    whole = durable(rows.select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v")))
    blocks = max(1, math.ceil(n / BLOCK))
    queries = whole.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    chunks = max(1, math.ceil(queries.count() / ASKED))
    members = whole.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("chunk", vectors.each(chunks))
    asked = queries.withColumn("chunk", vectors.chunk(chunks, "query_id", "q")).withColumn("block", vectors.each(blocks))

    def read(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return search_block(vectors.stack(queries["q"], width), queries["query_id"].to_numpy(), vectors.stack(block["v"], width), block["vec_id"].to_numpy(), k)

    found = asked.groupBy("block", "chunk").cogroup(members.groupBy("block", "chunk")).applyInPandas(read, "query_id long, vec_id long, score long")
    return vectors.best(found, k)
