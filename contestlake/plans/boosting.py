"""Gradient-boosted trees of many folds and bags at once, with signs that a feature's effect must have.

All members grow together: a pass over the rows adds up one histogram for each (member, node, feature, bin), so that the
number of Spark jobs depends on rounds and depth, not on how many members there are.  What leaves a task is bounded by
members x nodes x features x bins; a row is stored once, as bytes of bins.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from contestlake.functions.plan import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Values of a feature are told apart by at most so many bins; bin 0 is for missing ones.
BINS = 32
#: Penalty on leaf values, least second derivative in a leaf, step size.
PENALTY, LEAST, STEP = 1.0, 1.0, 0.1
# fixed values: cumulative probabilities of a Poisson(1) draw
COPIES = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815)


@dataclass(frozen=True)
class Member:
    """A model of the ensemble: it learns from rows of years before ``before``; a bag draws its rows, -1 takes each once.

    ``scale`` multiplies the weights of its rows.
    """

    before: int
    bag: int = -1
    scale: float = 1.0


@dataclass
class Trees:
    """Cuts of the features, the members, and for each a list of trees as rows of a node table.

    A tree has (feature, bin, value) for node k; its children are 2k + 1 (up to the bin) and 2k + 2; feature -1 is a leaf.
    """

    names: list[str]
    edges: list[list[float]]
    levels: dict[str, dict[str, int]]
    members: list[Member]
    depth: int
    nodes: list[list[np.ndarray]] = field(default_factory=list)

    def margins(self, member: int, bins: np.ndarray) -> np.ndarray:
        total = np.zeros(len(bins))
        for tree in self.nodes[member]:
            total += tree[place(tree, bins, self.depth), 2]
        return total


def place(tree: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row has reached after ``depth`` levels, or the leaf above it."""
    at = np.zeros(len(bins), np.int64)
    for _ in range(depth):
        feature = tree[at, 0].astype(np.int64)
        inner = feature >= 0
        right = bins[np.arange(len(bins)), np.maximum(feature, 0)] > tree[at, 1]
        at = np.where(inner, 2 * at + 1 + right, at)
    return at


def binned(rows: DataFrame, trees: Trees, keep: list[str]) -> DataFrame:
    """The kept columns and ``bins``, one byte a feature."""
    cols = []
    for name, edges in zip(trees.names, trees.edges):
        if name in trees.levels:
            # a table of at most BINS - 1 levels
            known = F.create_map(*[F.lit(x) for pair in trees.levels[name].items() for x in pair]) if trees.levels[name] else None
            cols.append(F.coalesce(F.try_element_at(known, F.col(name).cast("string")), F.lit(0)) if known is not None else F.lit(0))
        else:
            x = F.col(name).cast("double")
            above = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x)) if edges else F.lit(0)
            cols.append(F.when(x.isNull() | F.isnan(x), 0).otherwise(1 + above))
    return rows.select(*keep, F.array(*[c.cast("int") for c in cols]).alias("bins"))


def prepare(rows: DataFrame, numeric: list[str], categories: list[str], members: list[Member], depth: int) -> Trees:
    """Cuts at quantiles of each feature and the commonest levels of each category; both need no label."""
    at = [k / (BINS - 1) for k in range(1, BINS - 1)]
    cuts = rows.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), at, 2000).alias(c) for c in numeric]).first() if numeric else {}
    levels = {}
    for c in categories:
        top = rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(BINS - 1).collect()
        levels[c] = {r["v"]: k for k, r in enumerate(top, 1)}
    return Trees([*numeric, *categories], [*[sorted(set(cuts[c] or [])) for c in numeric], *[[] for _ in categories]], levels, members, depth, [[] for _ in members])


def copies(ids: np.ndarray, bag: int) -> np.ndarray:
    """How often a bag draws each row: by a hash of row and bag, so that a task that runs again draws the same."""
    if bag < 0:
        return np.ones(len(ids))
    x = ids ^ np.uint64((bag + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(COPIES, u, "right").astype(float)


def best_split(g: np.ndarray, h: np.ndarray, signs: np.ndarray, low: float, high: float) -> tuple[int, int, float, float] | None:
    """(feature, bin, left value, right value) of largest gain that keeps the signs, from histograms (features x bins)."""
    total_g, total_h = g[0].sum(), h[0].sum()
    left_g, left_h = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    left, right = (np.clip(-a / (b + PENALTY), low, high) for a, b in ((left_g, left_h), (right_g, right_h)))
    worth = lambda a, b, v: -(a * v + (b + PENALTY) * v * v / 2)
    whole = np.clip(-total_g / (total_h + PENALTY), low, high)
    gain = worth(left_g, left_h, left) + worth(right_g, right_h, right) - worth(total_g, total_h, whole)
    ok = (left_h >= LEAST) & (right_h >= LEAST) & (signs[:, None] * (right - left) >= 0) & (gain > 1e-9)
    if not ok.any():
        return None
    # equal gains up to rounding go to the first feature and bin
    k = int(np.flatnonzero(ok.ravel() & (gain.ravel() >= gain[ok].max() * (1 - 1e-9)))[0])
    f, b = divmod(k, gain.shape[1])
    return f, b, float(left[f, b]), float(right[f, b])


def fit(rows: DataFrame, trees: Trees, signs: dict[str, int] | None = None, rounds: int = 10) -> Trees:
    """Grow ``rounds`` trees of every member.

    ``rows`` has ``bins``, ``id`` (long, names the row), ``yr``, ``label`` and ``weight``.  ``signs`` says of a feature whether the
    probability may only rise (1) or fall (-1) with it; the values below a split by such a feature stay on their
    sides of its middle, so that the whole ensemble keeps the sign.  Missing values count as the lowest.
    """
    sign = np.array([(signs or {}).get(n, 0) for n in trees.names])
    n_features, members, depth = len(trees.names), trees.members, trees.depth
    for _ in range(rounds):
        growing = [np.full((2 ** (depth + 1) - 1, 3), (-1.0, 0.0, 0.0)) for _ in members]
        bounds = [{0: (-np.inf, np.inf)} for _ in members]
        open_nodes = [{0} for _ in members]
        for level in range(depth):
            shared = rows.sparkSession.sparkContext.broadcast((trees, growing, open_nodes, bounds))
            first, width = 2 ** level - 1, 2 ** level

            def histograms(batches):
                trees, growing, open_nodes, _ = shared.value
                sums = np.zeros((len(members), 2, width * n_features * BINS))
                for batch in batches:
                    ids, yr, label, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                    bins = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
                    if not len(ids):
                        continue
                    cell = np.arange(n_features) * BINS + bins
                    for m, member in enumerate(members):
                        if not open_nodes[m]:
                            continue
                        w = np.where(yr < member.before, copies(ids.view(np.uint64), member.bag) * weight * member.scale, 0.0)
                        use = np.flatnonzero(w > 0)
                        if not len(use):
                            continue
                        own = bins[use]
                        node = place(growing[m], own, level)
                        p = 1 / (1 + np.exp(-trees.margins(m, own)))
                        at = (cell[use] + (node - first)[:, None] * (n_features * BINS))[node >= first]
                        for k, v in enumerate((p - label[use], p * (1 - p))):
                            sums[m, k] += np.bincount(at.ravel(), np.repeat((w[use] * v)[node >= first], n_features), sums.shape[2])
                out = [(m, first + k) for m in range(len(members)) for k in range(width) if first + k in open_nodes[m]]
                cut = lambda m, k, which: sums[m, which].reshape(width, -1)[k - first].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()),
                                                  pa.array([cut(m, k, 0) for m, k in out], pa.binary()), pa.array([cut(m, k, 1) for m, k in out], pa.binary())], ["member", "node", "g", "h"])

            def split(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
                # partial sums are added in a fixed order
                frame = frame.sort_values(["g", "h"])
                g, h = (np.sum([np.frombuffer(x) for x in frame[c]], axis=0).reshape(n_features, BINS) for c in ("g", "h"))
                low, high = shared.value[3][key[0]][key[1]]
                value = float(np.clip(-g[0].sum() / (h[0].sum() + PENALTY), low, high))
                found = best_split(g, h, sign, low, high) or (-1, 0, value, value)
                return pd.DataFrame([(key[0], key[1], value, *found)], columns=["member", "node", "value", "feature", "bin", "left", "right"])

            partial = rows.select("id", "yr", F.col("label").cast("double"), F.col("weight").cast("double"), "bins").mapInArrow(histograms, "member int, node int, g binary, h binary")
            found = partial.groupBy("member", "node").applyInPandas(split, "member int, node int, value double, feature int, bin int, left double, right double").collect()
            for r in found:
                m, k, tree = r["member"], r["node"], growing[r["member"]]
                open_nodes[m].discard(k)
                if level == 0:
                    tree[k, 2] = STEP * r["value"]
                if r["feature"] < 0:
                    continue
                tree[k] = (r["feature"], r["bin"], tree[k, 2])
                low, high = bounds[m][k]
                middle, s = (r["left"] + r["right"]) / 2, sign[r["feature"]]
                for child, value, side in ((2 * k + 1, r["left"], -1), (2 * k + 2, r["right"], 1)):
                    tree[child, 2] = STEP * value
                    bounds[m][child] = (max(low, middle), high) if s * side > 0 else (low, min(high, middle)) if s * side < 0 else (low, high)
                    open_nodes[m].add(child)
        for m, tree in enumerate(growing):
            trees.nodes[m].append(tree)
    return trees


def score(rows: DataFrame, trees: Trees, keep: list[str], which=None) -> DataFrame:
    """The kept columns with (member, raw) for each member that ``which`` names for the row's year (all by default)."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    chosen = which or (lambda member, yr: np.ones(len(yr), bool))
    n, n_features = len(keep), len(trees.names)
    source = rows.select(*keep, F.col("yr").alias("_yr"), "bins")
    kinds = ", ".join(f"`{c}` {t}" for c, t in source.dtypes[:n])

    def run(batches):
        trees = shared.value
        for batch in batches:
            yr = batch.column(n).to_numpy(zero_copy_only=False)
            bins = batch.column(n + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
            for m, member in enumerate(trees.members):
                use = np.flatnonzero(chosen(member, yr))
                if len(use):
                    raw = 1 / (1 + np.exp(-trees.margins(m, bins[use])))
                    yield pa.RecordBatch.from_arrays([*[c.take(pa.array(use)) for c in batch.columns[:n]], pa.array(np.full(len(use), m), pa.int32()), pa.array(raw)], [*keep, "member", "raw"])

    return source.mapInArrow(run, f"{kinds}, member int, raw double")


def node_table(trees: Trees, spark) -> DataFrame:
    """member, tree, node, feature, bin, value of every node in use; its size depends on the settings alone."""
    rows = [(m, t, k, trees.names[int(x[0])] if x[0] >= 0 else None, int(x[1]), float(x[2])) for m, grown in enumerate(trees.nodes) for t, tree in enumerate(grown)
            for k, x in enumerate(tree) if k == 0 or tree[(k - 1) // 2, 0] >= 0]
    return spark.createDataFrame(rows, "member int, tree int, node int, feature string, bin int, value double")


def bagged_folds(rows: DataFrame, numeric: list[str], categories: list[str], years: list[int], calibrated, bags: int = 20, rounds: int = 10, depth: int = 3,
                 signs: dict[str, int] | None = None, key: str = "contest_id") -> DataFrame:
    """Mean and deviation over calibrated bags for every row of every fold year, from earlier rows only.

    For each fold one member without a bag learns from all but the last year before it; ``calibrated(held, scored)`` gets
    its (fold, label, raw) on that year and (key, fold, raw) of the bags, and adds ``p``.  ``rows`` has key, yr, label, weight.
    """
    # weights fall with age: the newest row that a member learns from shall weigh 1
    largest = {r["yr"]: r["w"] for r in rows.groupBy("yr").agg(F.max("weight").alias("w")).toLocalIterator()}
    scale = lambda before: 1 / max(w for y, w in largest.items() if y < before)
    members = [m for y in years for m in (Member(y - 1, -1, scale(y - 1)), *[Member(y, b, scale(y)) for b in range(bags)])]
    trees = prepare(rows, numeric, categories, members, depth)
    kept = durable(binned(rows.withColumn("id", F.xxhash64(key)), trees, ["id", key, F.col("yr").cast("int").alias("yr"), "label", "weight"]))
    fit(kept, trees, signs, rounds)
    held = score(kept, trees, [key, "yr", "label"], lambda m, yr: (yr == m.before) & (m.bag < 0))
    held = durable(held.select((F.col("yr") + 1).alias("fold"), "label", "raw"))
    bag = score(kept, trees, [key, "yr"], lambda m, yr: (yr == m.before) & (m.bag >= 0))
    each = calibrated(held, durable(bag.select(key, F.col("yr").alias("fold"), "raw")))
    return each.groupBy(key, "fold").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("spread"))
