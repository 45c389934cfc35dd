"""Quality classifier: positive-unlabelled learning with a non-negative unbiased risk."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from contestlake.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS, ORDERS = 10, (2, 3)
#: Bounds of the samples that the weights are fitted on.
POSITIVES, UNLABELLED = 3_000, 6_000
STEPS, RATE, DECAY = 400, 0.03, 1e-4
#: Bins of the scores that the class prior is estimated from, with the slack and the doubt of the best bin.
BINS, SLACK, DOUBT = 1_000, 0.01, 0.1
N_STATISTICS = 12


def shape(codes: np.ndarray) -> np.ndarray:
    """Code points with lower-case letters as a, upper-case as A, digits as 0; marks stay."""
    out = codes.copy()
    low = codes < 128
    out[(codes >= 97) & (codes <= 122)] = 97
    out[(codes >= 65) & (codes <= 90)] = 65
    out[(codes >= 48) & (codes <= 57)] = 48
    out[~low] = np.where((codes[~low] >= 0xC0) & (codes[~low] <= 0xDE), 65, 97)
    return out


def statistics(text: str, codes: np.ndarray) -> np.ndarray:
    """Shares that tell prose from boilerplate, shouting, tables and repetition."""
    n = max(len(codes), 1)
    words = text.split()
    lines = text.split("\n")
    ascii_ = codes < 128
    upper = ((codes >= 65) & (codes <= 90)).sum()
    lower = ((codes >= 97) & (codes <= 122)).sum()
    digits = ((codes >= 48) & (codes <= 57)).sum()
    spaces = (codes <= 32).sum()
    marks = ascii_.sum() - upper - lower - digits - spaces
    wide = len(codes) - ascii_.sum()
    m = max(len(words), 1)
    distinct = len(set(words))
    stops = text.count(".") + text.count("!") + text.count("?")
    return np.array([
        upper / n, digits / n, spaces / n, marks / n, wide / n, distinct / m, min(1.0, distinct / m ** 0.75), len(set(lines)) / len(lines),
        min(1.0, np.log1p(m) / 12), min(1.0, n / m / 20), min(1.0, stops / m), (text.count("!") + text.count("|")) / n,
    ])


def features(text: str | None) -> np.ndarray:
    """Statistics, then square roots of the shares of hashed shape n-grams."""
    text = text or ""
    codes = common.code_points(text)
    grams = common.gram_counts(shape(codes), BITS, ORDERS)
    return np.concatenate([statistics(text, codes), np.sqrt(grams / max(grams.sum(), 1))])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        g = ((features(text) - self.mean) * self.scale) @ self.weights + self.intercept
        return float(1 / (1 + np.exp(-np.clip(g, -35, 35))))


def half(doc_id: str, text: str) -> Column:
    """Half of a document, for scores by a model that has not seen it."""
    return F.pmod(F.xxhash64(F.lit(3), F.col(doc_id), F.col(text)), F.lit(2))


def sample(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """At most ``most`` rows by hash of the text, thinned by the hash before they are ranked."""
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < 2.0 * most / max(n, 1))
    return drawn.orderBy("draw", "doc_id").limit(most)


def matrix(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Packed features of a bounded sample, and the half of each row."""
    def make(batch):
        return [pa.array([features(t).astype("<f4").tobytes() for t in batch.column(0).to_pylist()], pa.binary())]

    got = common.append(rows.withColumn("half", half("doc_id", "text")), ["text"], "packed binary", make, ["draw", "half"]).collect()
    got.sort(key=lambda r: (r["draw"], bytes(r["packed"])))
    return np.array([np.frombuffer(r["packed"], "<f4") for r in got], np.float64).reshape(len(got), N_STATISTICS + (1 << BITS)), np.array([r["half"] for r in got], np.int64)


def best_bin(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from counts of both by ascending score bin.

    Above a threshold that few negatives pass, the tail of the unlabelled is the prior times the tail of the
    positives.  The threshold is the one with the least upper bound of that quotient.  Without rows: a half.
    """
    n_p, n_u = positives.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    tail_p, tail_u = positives[::-1].cumsum() / n_p, unlabelled[::-1].cumsum() / n_u
    some = tail_p > 0
    noise = np.sqrt(np.log(4 / DOUBT) / (2 * n_u)) + np.sqrt(np.log(4 / DOUBT) / (2 * n_p))
    quotient = tail_u[some] / tail_p[some]
    found = quotient[np.argmin(quotient + (1 + SLACK) * noise / tail_p[some])]
    return float(np.clip(found, 1 / (n_u + 2), 1 - 1 / (n_u + 2)))


def estimated_prior(trusted: DataFrame, base: DataFrame, pos: np.ndarray, unl: np.ndarray, half_p: np.ndarray, half_u: np.ndarray) -> float:
    """Class prior of all rows of ``base``; ``trusted`` has the distinct ids of its positives.

    Two models tell positives from unlabelled rows, each fitted on one half of the samples; every row of
    ``base`` is scored by the model of the other half and only counts by score bin reach the driver.
    """
    parts = [(pos[half_p == k], unl[half_u == k]) for k in (0, 1)]
    if any(not len(p) or not len(u) for p, u in parts):
        return 0.5
    models = base.sparkSession.sparkContext.broadcast([train(p, u, 0.5, separate) for p, u in parts])

    def make(batch):
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        return [pa.array([min(int(models.value[1 - h].score(t) * BINS), BINS - 1) for t, h in rows], pa.int32())]

    # ids and bins are joined, so that no text is shuffled
    scored = common.append(base.withColumn("half", half("doc_id", "text")), ["text", "half"], "bin int", make, ["doc_id"])
    known = scored.join(trusted.select("doc_id", F.lit(1).alias("positive")), "doc_id", "left")
    counts = known.groupBy("bin").agg(F.count("*").alias("unlabelled"), F.count("positive").alias("positives")).collect()
    by_bin = np.zeros((2, BINS))
    for r in counts:
        by_bin[:, r["bin"]] = r["positives"], r["unlabelled"]
    return best_bin(*by_bin)


def risk_gradient(w, b, pos, unl, prior):
    """Gradient of the non-negative risk for the logistic loss; where the part of the unseen negatives
    is negative, the step goes against it instead."""
    def sig(v):
        return 1 / (1 + np.exp(-np.clip(v, -35, 35)))

    gp, gu = pos @ w + b, unl @ w + b
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    dp, du = sig(gp) / len(pos), sig(gu) / len(unl)      # slopes of the loss of calling a row positive when it is not
    dn_w, dn_b = unl.T @ du - prior * (pos.T @ dp), du.sum() - prior * dp.sum()
    if negative < 0:
        return -dn_w, -dn_b
    dq = -sig(-gp) / len(pos)                              # slope of the loss of missing a positive
    return prior * (pos.T @ dq) + dn_w, prior * dq.sum() + dn_b


def separate(w, b, pos, unl, prior):
    """Gradient of the logistic loss of telling positives from unlabelled rows, both of weight one half."""
    dp, du = -1 / (1 + np.exp(np.clip(pos @ w + b, -35, 35))) / len(pos), 1 / (1 + np.exp(-np.clip(unl @ w + b, -35, 35))) / len(unl)
    return (pos.T @ dp + unl.T @ du) / 2, (dp.sum() + du.sum()) / 2


def train(pos: np.ndarray, unl: np.ndarray, prior: float, gradient=risk_gradient) -> Model:
    mean, scale = unl.mean(axis=0), 1 / (unl.std(axis=0) + 1e-3)
    p, u = (pos - mean) * scale, (unl - mean) * scale
    p, u = np.clip(p, -8, 8), np.clip(u, -8, 8)
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        gw, gb = gradient(w, b, p, u, prior)
        gw = gw + DECAY * w
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = RATE * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
    return Model(mean, scale, w, b)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Trusted positives are labelled 1 and learnable; the unlabelled are learnable documents as they come.

    The class prior is estimated from the scores of both; labels other than 1 are not used.  A document with
    several labels counts as their smallest.  Without any positive or any document there is no model; where a
    half of the documents has none, the prior is a half.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(learn)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(learn)
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    trusted = base.join(marks, "doc_id", "left_semi")
    (pos, half_p), (unl, half_u) = matrix(sample(trusted, positives, 1)), matrix(sample(base, unlabelled, 2))
    if not len(pos) or not len(unl):
        return None
    return train(pos, unl, estimated_prior(marks, base, pos, unl, half_p, half_u))


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Each row with a score from 0 to 1 of its whole text; a null text counts as empty, no model means 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch):
        return [pa.array([shared.value.score(t) if shared.value else 0.5 for t in batch.column(0).to_pylist()], pa.float64())]

    return common.append(docs, [text], f"{out} double", make, keep)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", at_least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, repeated ids and null texts included."""
    model = fit(docs, labels, common.remainder(F.col("doc_id"), 4) != 2, text, doc_id)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    slim = slim.select("doc_id", (common.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return score(slim, model, keep=["doc_id", "held_out"]).withColumn("predicted", F.when(F.col("score") >= at_least, 1).otherwise(0))
