"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from contestlake.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNDETERMINED = "und"
BITS, ORDERS = 14, (1, 2, 3)
#: Bounds of the labelled sample that the weights are fitted on: rows per language, rows in all.
PER_LANGUAGE, IN_ALL = 1_000, 6_000
#: Follow-the-regularised-leader: rate, offset, L1, L2; passes over the sample; share kept for the temperature.
ALPHA, BETA, L1, L2, PASSES, KEPT_FOR_TEMPERATURE = 0.5, 1.0, 0.02, 0.002, 3, 0.2
LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of the lower-case text; everything but letters counts as a space."""
    codes = common.code_points(text.lower()).copy()
    plain = codes < 128
    codes[plain & ~((codes >= 97) & (codes <= 122))] = 32
    return common.gram_counts(codes, BITS, ORDERS)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bins and, last, the intercept; by language
    temperature: float

    def vector(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((count > 0) & (self.idf > 0))
        x = np.log1p(count[at]) * self.idf[at]
        norm = np.sqrt((x * x).sum())
        return np.append(at, len(self.idf)), np.append(x / norm if norm else x, 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and its calibrated probability; undetermined without letters or without a learned language."""
        if not text or not self.languages or not LETTER.search(text):
            return UNDETERMINED, 0.0
        at, x = self.vector(counts(text))
        p = softmax(x @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def document_frequencies(texts: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each bin occurs, over all rows; one partial vector per task, summed by Spark."""
    def run(batches):
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in common.slices(batches):
            for t in batch.column(0).to_pylist():
                total += counts(t or "") > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], ["bin", "n"])

    # one row per bin at most, whatever the size of the data
    rows = texts.select(text).mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(1 << BITS, np.int64)
    n = 0
    for r in rows:
        if r["bin"] < 0:
            n = r["n"]
        else:
            found[r["bin"]] = r["n"]
    return found, n


def sample(labelled: DataFrame, text: str, lang: str, per_language: int, in_all: int) -> DataFrame:
    """At most ``per_language`` different texts of each language and ``in_all`` in all, by hash of the text.

    Copies count once: shares are taken of the different texts of a language, so that neither a group of copies fills
    its sample nor a language of few texts is thinned away.  Texts are thinned by their hash before any is shuffled,
    then ranked exactly; a rank, unlike a share, bounds what is collected.  The table of shares sent to every task has
    ``in_all`` rows at most.
    """
    keyed = labelled.select(F.col(text).alias("text_"), F.col(lang).alias("l_"), F.xxhash64(F.lit(17), F.col(text)).alias("hash_"))
    sizes = keyed.select(F.col("l_").alias("lang_"), "hash_").distinct().groupBy("lang_").agg(F.count("*").alias("n_"))
    each = F.least(F.lit(per_language), F.greatest(F.lit(1), F.floor(F.lit(in_all) / F.count("*").over(Window.partitionBy(F.lit(0))))))
    sizes = sizes.orderBy(F.desc("n_"), "lang_").limit(in_all).withColumn("each_", each)
    thinned = keyed.withColumn("draw_", F.pmod("hash_", F.lit(1 << 30)) / F.lit(float(1 << 30))).join(F.broadcast(sizes), F.col("l_") == F.col("lang_"))
    thinned = thinned.filter(F.col("draw_") < 3 * F.col("each_") / F.col("n_")).groupBy("l_", "hash_", "draw_", "each_").agg(F.min("text_").alias("text_"))
    order = Window.partitionBy("l_").orderBy("draw_", "hash_")
    return thinned.withColumn("k_", F.row_number().over(order)).filter(F.col("k_") <= F.col("each_")).filter(F.col("k_") <= per_language)


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model:
    """Fit on the rows where ``learn`` holds, with a text and a language.

    Document frequencies and language counts cover all such rows; the weights are fitted on a sample
    bounded by the parameters, of which only packed n-gram counts reach the driver.
    """
    rows = docs.filter(learn).select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    found, n = document_frequencies(rows, "text")
    idf = np.where(found > 0, np.log((1 + n) / (1 + found)) + 1e-3, 0.0)

    def packed(batch):
        bins, times = [], []
        for t in batch.column(0).to_pylist():
            c = counts(t)
            at = np.flatnonzero(c)
            bins.append(at.astype("<u2").tobytes())
            times.append(np.log1p(c[at]).astype("<f4").tobytes())
        return [pa.array(bins, pa.binary()), pa.array(times, pa.binary())]

    drawn = common.append(sample(rows, "text", "lang", per_language, in_all), ["text_"], "bins binary, times binary", packed, ["l_", "draw_"])
    got = sorted(drawn.collect(), key=lambda r: (r["draw_"], r["l_"], bytes(r["bins"])))
    languages = sorted({r["l_"] for r in got})
    if not languages:
        return Model([], idf, np.zeros((len(idf) + 1, 0)), 1.0)
    model = Model(languages, idf, np.zeros((len(idf) + 1, len(languages))), 1.0)
    data = []
    for r in got:
        at = np.frombuffer(r["bins"], "<u2").astype(np.int64)
        x = np.frombuffer(r["times"], "<f4") * idf[at]
        norm = np.sqrt((x * x).sum())
        data.append((np.append(at, len(idf)), np.append(x / norm if norm else x, 1.0), languages.index(r["l_"])))
    held = data[::round(1 / KEPT_FOR_TEMPERATURE)] if len(data) >= 50 else []
    chosen = [d for k, d in enumerate(data) if k % round(1 / KEPT_FOR_TEMPERATURE)] if held else data
    model.weights = follow_leader(chosen, len(idf) + 1, len(languages))
    if held:
        model.temperature = temperature([x @ model.weights[at] for at, x, _ in held], [y for *_, y in held])
    return model


def follow_leader(data: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int) -> np.ndarray:
    """Per-coordinate follow-the-regularised-leader with elastic net on the softmax loss."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(z, n):
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(PASSES):
        for at, x, y in data:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    return weights(z, n)


def temperature(scores: list[np.ndarray], truth: list[int]) -> float:
    """The temperature of least log-loss on held-back rows, by golden section over its logarithm."""
    s, y = np.array(scores), np.array(truth)

    def loss(log_t):
        v = s / np.exp(log_t)
        v = v - v.max(axis=1, keepdims=True)
        return float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(y)), y]).mean())

    lo, hi, ratio = -4.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Each row with a language and its probability, from the whole text.

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned.
    Other columns pass through; the new names must differ from theirs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bins x languages

    def make(batch):
        found = [shared.value.predict(t) for t in batch.column(0).to_pylist()]
        return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

    return common.append(docs, [text], f"{lang} string, {score} double", make, keep)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents that are not held out."""
    held = common.remainder(F.col(doc_id), 3) == 1
    model = fit(docs, ~held, text, lang)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    return predict(slim, model, keep=["doc_id", "held_out"])


def accepted(docs: DataFrame, least: float = 0.3, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose language is determined with at least this probability, with the columns of ``docs``."""
    model = fit(docs, common.remainder(F.col(doc_id), 3) != 1, text, lang)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("text"))
    found = predict(row, model, keep=["row"])
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")
