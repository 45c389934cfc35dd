"""Approximate nearest neighbours: a forest of random-projection trees behind one priority queue, then exact scores."""

from __future__ import annotations

import heapq
import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from contestlake.functions.plan import durable
from contestlake.llm import vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Trees; levels of each; rows that the splits are fitted on at most (every row is indexed).
TREES, LEVELS, FITTED = 4, 6, 16_384
#: Rows that the leaves opened for a query hold together over all trees (a row counts once per tree), as a share
#: of all rows.  Vectors without clusters need this much for a recall of 0.9; clustered ones far less.
OPENED = 1.0
#: Rows of a leaf that one task scores at a time, and queries that it scores them for.
BLOCK, ASKED = 4_096, 16_384


@dataclass
class Forest:
    """Complete binary trees: node i has the children 2i+1 and 2i+2; leaves are numbered from left to right."""

    levels: int
    normals: np.ndarray  # tree, inner node, component
    cuts: np.ndarray     # tree, inner node

    def leaf(self, x: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normals[tree][node]) > self.cuts[tree][node])
        return node - ((1 << self.levels) - 1)

    def open_leaves(self, x: np.ndarray, sizes: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """Leaves of all trees in the order of the shared queue, until they hold ``wanted`` rows.

        A node's priority is the sum of the squared distances to the splits on the way to it that the query
        lies on the other side of; nodes of the smallest sum come first, whatever their tree.
        """
        trees, inner = self.cuts.shape
        margin = np.einsum("tij,j->ti", self.normals, x) - self.cuts if inner else self.cuts
        queue = [(0.0, t, 0) for t in range(trees)]
        out, held = [], 0
        while queue and held < wanted:
            p, t, node = heapq.heappop(queue)
            if node >= inner:
                leaf = node - inner
                if sizes[t, leaf]:
                    out.append((t, leaf))
                    held += sizes[t, leaf]
                continue
            m = float(margin[t, node])
            heapq.heappush(queue, (p + min(m, 0.0) ** 2, t, 2 * node + 2))
            heapq.heappush(queue, (p + max(m, 0.0) ** 2, t, 2 * node + 1))
        return out


def grow(x: np.ndarray, trees: int, levels: int, seed: int = 7) -> Forest:
    """Splits between random pairs of the sample, at the median, so that leaves hold like numbers of rows."""
    rng = np.random.default_rng(seed)
    levels = max(0, min(levels, int(math.log2(max(len(x), 1) / 8)) if len(x) >= 8 else 0))
    inner = (1 << levels) - 1
    normals, cuts = np.zeros((trees, inner, x.shape[1])), np.zeros((trees, inner))
    for t in range(trees):
        held = {0: np.arange(len(x))}
        for node in range(inner):
            rows = held.pop(node)
            way = rng.standard_normal(x.shape[1])
            if len(rows) > 1:
                a, b = x[rng.choice(rows, 2, replace=False)]
                if (a != b).any():
                    way = a - b
            way /= np.linalg.norm(way)
            at = x[rows] @ way
            normals[t, node], cuts[t, node] = way, np.median(at) if len(rows) else 0.0
            right = at > cuts[t, node]
            held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
    return Forest(levels, normals, cuts)


def exact_best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query, by the inner product summed in one fixed order."""
    out, deep = [], k * vectors.repeats(row_ids)
    for at in range(0, len(queries), 512):
        rough = queries[at:at + 512] @ rows.T
        slack = 1e-9 * (1 + np.abs(rough).max(axis=1))
        for i, q in enumerate(range(at, at + len(rough))):
            s = rough[i]
            s[row_ids == query_ids[q]] = -np.inf
            floor = np.partition(s, len(s) - deep)[len(s) - deep] - slack[i] if len(s) > deep else -np.inf
            near = np.flatnonzero((s >= floor) & (s > -np.inf))
            score = (rows[near] * queries[q]).sum(axis=1)
            first = vectors.first(row_ids[near], score, k)
            out.append((np.full(len(first), query_ids[q]), row_ids[near][first], score[first]))
    ids, vecs, scores = (np.concatenate(c) if out else np.zeros(0) for c in zip(*out)) if out else ([], [], [])
    return pd.DataFrame({"query_id": np.asarray(ids, np.int64), "vec_id": np.asarray(vecs, np.int64), "score": np.asarray(scores, np.float64)})


def nearest(table: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = TREES,
            levels: int = LEVELS, opened: float = OPENED, fitted: int = FITTED) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query row.

    ``is_query`` is a condition on ``vec_id``.  Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows without id; shorter vectors are filled up with zeros; repeated ids
    count once, with their best score.  The splits are fitted on a bounded sample, every row is indexed.
    Leaves are cut into blocks and queries into chunks, so a leaf with a third of all rows, or one that all
    queries open, is scored by many tasks.
    """
    rows, width, n = vectors.padded(vectors.usable(table, vec_id, embedding, zero=False))
    spark = table.sparkSession
    draw = F.xxhash64(F.lit(5), "vec_id")
    part = rows.filter(F.pmod(draw, F.lit(1 << 20)) < (1 << 20) * min(1.0, 2 * fitted / max(n, 1))).orderBy(draw, "vec_id").limit(fitted)
    drawn = vectors.stack([r["v"] for r in part.select("v").collect()], width)
    forest = grow(drawn / np.maximum(np.linalg.norm(drawn, axis=1, keepdims=True), 1e-300), trees, levels)
    n_leaves = 1 << forest.levels
    shared = spark.sparkContext.broadcast(forest)  # trees x nodes x components, whatever the number of rows

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = vectors.stack(batch.column(1).to_pylist(), width)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                leaves = np.stack([t * n_leaves + shared.value.leaf(unit, t) for t in range(trees)], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(leaves), pa.list_(pa.int64()))], ["vec_id", "v", "leaves"])

    placed = durable(rows.mapInArrow(place, "vec_id long, v array<double>, leaves array<long>"))
    held = np.zeros((trees, n_leaves), np.int64)
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect():
        held[r["leaf"] // n_leaves, r["leaf"] % n_leaves] = r["n"]
    blocks = np.maximum(1, -(-held // BLOCK))
    wanted = max(opened * n * 1.0, 10 * k * trees)

    def visit(batches):
        for batch in batches:
            ids, cells, vecs = [], [], batch.column(1).to_pylist()
            x = vectors.stack(vecs, width)
            for i, q in enumerate(batch.column(0).to_pylist()):
                for t, leaf in shared.value.open_leaves(x[i] / np.linalg.norm(x[i]), held, wanted):
                    for block in range(blocks[t, leaf]):
                        ids.append(i)
                        cells.append(f"{t * n_leaves + leaf}:{block}")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), batch.column(1).take(pa.array(ids, pa.int64())), pa.array(cells, pa.string())], ["query_id", "q", "cell"])

    asked = placed.filter(is_query).select("vec_id", "v")
    chunks = max(1, math.ceil(asked.count() / ASKED))
    probes = asked.mapInArrow(visit, "query_id long, q array<double>, cell string").withColumn("chunk", vectors.chunk(chunks, "query_id", "q"))
    counts = F.array(*[F.lit(int(b)) for b in blocks.ravel()]) if blocks.max() > 1 else None
    leaf_rows = placed.select("vec_id", "v", F.explode("leaves").alias("leaf"))
    block = F.pmod(F.xxhash64("vec_id"), F.element_at(counts, F.col("leaf").cast("int") + 1)) if counts is not None else F.lit(0)
    members = leaf_rows.select("vec_id", "v", F.concat_ws(":", "leaf", block).alias("cell"), vectors.each(chunks).alias("chunk"))

    def score(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return exact_best(vectors.stack(queries["q"], width), queries["query_id"].to_numpy(), vectors.stack(block["v"], width), block["vec_id"].to_numpy(), k)

    found = probes.groupBy("cell", "chunk").cogroup(members.groupBy("cell", "chunk")).applyInPandas(score, "query_id long, vec_id long, score double")
    return vectors.best(found, k)
