"""Training jobs on MLlib: walk-forward folds, calibration, bags, blends, classes, quantiles."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from contestlake.functions import probability as prob
from contestlake.functions.plan import durable
from contestlake.operators import folds, order, totals
from contestlake.plans import boosting

#: Models that are fitted at the same time.
AT_ONCE = 4
MIN_TRAIN, MIN_VAL, MIN_CALIB = 100, 10, 50
# fixed values: sizes below which a class fold is left out (rows before and in the fold; fitted and calibrating rows of
# the classes), and the share of the earlier rows that the forest is fitted on
CLASS_ROWS, CLASS_FITTED, CLASS_SHARE = (200, 10), (100, 30), 0.85


def prepare(rows: DataFrame, numeric: list[str], categories: list[str]) -> tuple[DataFrame, list, list[str]]:
    """NULLs become 0 plus an indicator; categories are indexed.  Returns rows, stages, inputs."""
    cols = {f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric}
    cols.update({f"n_{c}": F.col(c).isNull().cast("double") for c in numeric})
    out = rows.withColumns(cols)
    stages = [StringIndexer(inputCol=c, outputCol=f"i_{c}", handleInvalid="keep") for c in categories]
    inputs = [*cols, *[f"i_{c}" for c in categories]]
    return out, [*stages, VectorAssembler(inputCols=inputs, outputCol="features")], inputs


def booster(train: DataFrame, stages: list, label: str = "label", rounds: int = 10, depth: int = 3,
            weight: str | None = "weight", holdout: str | None = None) -> PipelineModel:
    """Weighted gradient-boosted classifier; ``holdout`` names a validation flag for early stopping."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=42)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if holdout:
        gbt = gbt.setValidationIndicatorCol(holdout)
    return Pipeline(stages=[*stages, gbt]).fit(train)


def raw_probability(model: PipelineModel, rows: DataFrame, out: str = "raw") -> DataFrame:
    scored = model.transform(rows)
    drop = [c for c in ("rawPrediction", "probability", "prediction", "features") if c in scored.columns]
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(*drop)


def fit_isotonic(rows: DataFrame, p: str, label: str):
    """Monotone calibration curve; rows of equal probability are merged first, which does not change it."""
    points = rows.groupBy(F.col(p).alias("_x")).agg(F.avg(label).alias("label"), F.count("*").cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="_x", labelCol="label", weightCol="weight").fit(points)


def calibrate(model, rows: DataFrame, p: str, out: str) -> DataFrame:
    """Apply a curve; probabilities outside its range take the end values."""
    return model.transform(rows.withColumn("_x", F.col(p))).withColumnRenamed("prediction", out).drop("_x")


def _weights(rows: DataFrame) -> DataFrame:
    return folds.decay_weights(rows)


def years_from(rows: DataFrame, first: int) -> list[int]:
    """Fold years; one row per calendar year reaches the driver."""
    return [r[0] for r in rows.filter(F.col("yr") >= first).select("yr").distinct().orderBy("yr").toLocalIterator()]


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {r["yr"]: r["n"] for r in rows.groupBy("yr").agg(F.count("*").alias("n")).toLocalIterator()}


def walk_forward(rows: DataFrame, numeric: list[str], categories: list[str], first: int, rounds: int = 10) -> DataFrame:
    """Out-of-fold probabilities: boost on all but the last training year, calibrate on it, score the next."""
    data, stages, _ = prepare(rows, numeric, categories)
    data = durable(data)
    sizes = _sizes(data)
    parts = []
    for y in years_from(data, first):
        core, calib = sum(n for k, n in sizes.items() if k < y - 1), sizes.get(y - 1, 0)
        if core < MIN_TRAIN or calib < MIN_CALIB or sizes[y] < MIN_VAL:
            continue
        model = booster(_weights(data.filter(F.col("yr") < y - 1)), stages, rounds=rounds)
        curve = fit_isotonic(raw_probability(model, data.filter(F.col("yr") == y - 1)), "raw", "label")
        parts.append(durable(calibrate(curve, raw_probability(model, data.filter(F.col("yr") == y)), "raw", "p").withColumn("fold", F.lit(y))))
    if not parts:
        raise ValueError("no fold has enough rows")
    return reduce(DataFrame.unionByName, parts)


def stacked(oof: DataFrame) -> DataFrame:
    """Leave-one-fold-out curve on the raw out-of-fold probabilities, beside the per-fold one."""
    oof = durable(oof.select("contest_id", "fold", "label", "raw", "p"))
    parts = []
    for f in [r[0] for r in oof.select("fold").distinct().orderBy("fold").toLocalIterator()]:
        curve = fit_isotonic(oof.filter(F.col("fold") != f), "raw", "label")
        parts.append(calibrate(curve, oof.filter(F.col("fold") == f), "raw", "p_stacked"))
    return reduce(DataFrame.unionByName, parts)


def final(rows: DataFrame, numeric: list[str], categories: list[str], oof: DataFrame, rounds: int = 10):
    """The model to score with: boosted on all rows, with the curve of all out-of-fold raw probabilities.

    Returns a function that adds ``raw`` and ``p`` to prepared-like rows with the same inputs.
    """
    data, stages, _ = prepare(rows, numeric, categories)
    model = booster(_weights(data), stages, rounds=rounds)
    curve = fit_isotonic(oof, "raw", "label")

    def score(coming: DataFrame) -> DataFrame:
        return calibrate(curve, raw_probability(model, prepare(coming, numeric, categories)[0]), "raw", "p")

    return score


def calibration_table(stacked_rows: DataFrame) -> DataFrame:
    return stacked_rows.groupBy("fold").agg(
        F.count("*").alias("n"), F.avg(prob.log_loss(F.col("label"), F.col("p"))).alias("per_fold"),
        F.avg(prob.log_loss(F.col("label"), F.col("p_stacked"))).alias("stacked"))


def importances(models: list[PipelineModel], inputs: list[str], spark) -> DataFrame:
    """Mean gain per input over the models."""
    rows = [(c, float(v)) for m in models for c, v in zip(inputs, m.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, gain double").groupBy("feature").agg(F.avg("gain").alias("gain"))


def bagged(train: DataFrame, score: DataFrame, stages: list, bags: int = 20, rounds: int = 10, curve=None) -> DataFrame:
    """Mean and deviation over bootstrap bags, each calibrated by ``curve`` if one is given.

    A bag draws Poisson(1) copies of a row as its weight; the draw is a hash of the
    row and the bag, so a recomputed task draws the same.
    """
    # fixed values: cumulative probabilities of a Poisson(1) draw
    steps = [0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815]
    out = score
    for b in range(bags):
        u = F.pmod(F.xxhash64("contest_id", F.lit(b)), F.lit(1 << 30)) / float(1 << 30)
        copies = sum(((u >= s).cast("double") for s in steps[1:]), (u >= steps[0]).cast("double"))
        drawn = train.withColumn("bag_weight", copies * F.col("weight")).filter("bag_weight > 0")
        out = raw_probability(booster(drawn, stages, rounds=rounds, weight="bag_weight"), out, f"bag_{b}")
        out = out.drop(*[s.getOutputCol() for s in stages if isinstance(s, StringIndexer)])
        if curve is not None:
            out = calibrate(curve, out, f"bag_{b}", "_bag").withColumn(f"bag_{b}", F.col("_bag")).drop("_bag")
        out = durable(out)
    bag = F.array(*[F.col(f"bag_{b}") for b in range(bags)])
    mean = F.aggregate(bag, F.lit(0.0), lambda a, x: a + x) / bags
    out = out.withColumn("mean", mean)
    spread = F.sqrt(F.aggregate(bag, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / bags)
    return out.withColumn("spread", spread).drop(*[f"bag_{b}" for b in range(bags)])


def fold_years(data: DataFrame, first: int) -> list[int]:
    """Fold years with enough rows to boost on, to calibrate on and to score."""
    sizes = _sizes(data)
    return [y for y in years_from(data, first) if sum(n for k, n in sizes.items() if k < y - 1) >= MIN_TRAIN and sizes.get(y - 1, 0) >= MIN_CALIB and sizes[y] >= MIN_VAL]


def bagged_walk_forward(rows: DataFrame, numeric: list[str], categories: list[str], first: int, bags: int = 20, rounds: int = 10, signs: dict[str, int] | None = None) -> DataFrame:
    """Mean and deviation of calibrated bags on every fold year, from earlier rows only; all folds and bags are grown at once."""
    data = durable(_weights(rows))
    years = fold_years(data, first)
    if not years:
        raise ValueError("no fold has enough rows")

    def calibrated(held: DataFrame, scored: DataFrame) -> DataFrame:
        parts = [calibrate(fit_isotonic(held.filter(F.col("fold") == y), "raw", "label"), scored.filter(F.col("fold") == y), "raw", "p") for y in years]
        return reduce(DataFrame.unionByName, parts)

    return boosting.bagged_folds(data, numeric, categories, years, calibrated, bags, rounds, signs=signs)


def blend(oof: DataFrame) -> DataFrame:
    """Logistic blend of model and rating log-odds, used only if it lowers the log-loss."""
    rows = durable(oof.withColumns({"l_model": prob.logit(F.col("p")), "l_rating": prob.logit(prob.elo_expected(F.col("elo_a") - F.col("elo_b")))}))
    assembled = VectorAssembler(inputCols=["l_model", "l_rating"], outputCol="features").transform(rows)
    model = LogisticRegression(featuresCol="features", labelCol="label", maxIter=100, regParam=0.0).fit(assembled)
    scored = model.transform(assembled).withColumn("blended", vector_to_array("probability")[1])
    loss = scored.agg(F.avg(prob.log_loss(F.col("label"), F.col("p"))).alias("a"), F.avg(prob.log_loss(F.col("label"), F.col("blended"))).alias("b"))
    better = loss.select(F.col("b") < F.col("a")).scalar()
    return scored.withColumn("used_blend", better.cast("int")).withColumn("final", F.when(F.col("used_blend") == 1, F.col("blended")).otherwise(F.col("p"))).drop(
        "features", "rawPrediction", "probability", "prediction")


def class_model(train: DataFrame, calib: DataFrame, score: DataFrame, classes: list[str], truth: str, stages: list, trees: int = 20) -> DataFrame:
    """Class probabilities from a forest, one calibration curve per class, renormalised."""
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(truth)) - 1
    forest = RandomForestClassifier(featuresCol="features", labelCol="_y", numTrees=trees, maxDepth=5, seed=42)
    model = Pipeline(stages=[*stages, forest]).fit(train.withColumn("_y", index.cast("double")))
    cut = lambda df: model.transform(df).withColumn("_v", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction", "features")
    held, out = durable(cut(calib)), cut(score)
    for i, c in enumerate(classes):
        value = F.coalesce(F.try_element_at("_v", F.lit(i + 1)), F.lit(0.0))
        curve = fit_isotonic(held.withColumns({"_p": value, "_hit": (F.col(truth) == c).cast("double")}), "_p", "_hit")
        out = calibrate(curve, out.withColumn("_p", value), "_p", f"c_{c}").drop("_p")
    total = reduce(lambda a, b: a + b, [F.col(f"c_{c}") for c in classes])
    return out.withColumn("_t", total).withColumns({f"c_{c}": F.when(F.col("_t") > 0, F.col(f"c_{c}") / F.col("_t")).otherwise(F.lit(1.0 / len(classes)))
                                                    for c in classes}).drop("_t", "_v")


def class_walk_forward(rows: DataFrame, numeric: list[str], categories: list[str], classes: list[str], truth: str, first: int, trees: int = 20) -> DataFrame:
    """Class probabilities of every row of each fold year, from earlier rows only.

    In the order (dt, contest_id) the first CLASS_SHARE of the earlier rows fit the forest and the others calibrate it;
    rows of no class take part in neither.  Folds with too few rows are left out.
    """
    data, stages, _ = prepare(rows, numeric, categories)
    data = durable(order.position(data, "contest_id"))
    sizes, known = _sizes(data), data.filter(F.col(truth).isin(classes))
    parts = []
    for y in years_from(data, first):
        before = sum(n for k, n in sizes.items() if k < y)
        cut = int(before * CLASS_SHARE)
        fitted, held = known.filter(F.col("pos") < cut), known.filter((F.col("pos") >= cut) & (F.col("pos") < before))
        if before < CLASS_ROWS[0] or sizes[y] < CLASS_ROWS[1] or fitted.count() < CLASS_FITTED[0] or held.count() < CLASS_FITTED[1]:
            continue
        parts.append(durable(class_model(fitted, held, data.filter(F.col("yr") == y), classes, truth, stages, trees).withColumn("fold", F.lit(y))))
    if not parts:
        raise ValueError("no fold has enough rows")
    return reduce(DataFrame.unionByName, parts).drop("pos", "total")


def quantile_forest(train: DataFrame, score: DataFrame, target: str, stages: list, key: str = "contest_id", trees: int = 10, depth: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Five conditional quantiles of a count per scored row, beside the columns in ``keep``.

    A forest groups training rows into leaves.  What it learned is the number of rows of each (tree, leaf, count), a table
    bounded by trees x leaves x distinct counts; it is broadcast, and each scored row adds the shares of its own leaves up.
    """
    forest = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, leafCol="leaf", seed=42)
    model = Pipeline(stages=[*stages, forest]).fit(train)
    leaves = lambda df, *cols: model.transform(df).select(*cols, vector_to_array("leaf").alias("leaf"))
    counts = leaves(train, F.col(target).cast("double").alias("y")).select("y", F.posexplode("leaf").alias("tree", "leaf")).groupBy("tree", "leaf", "y").agg(F.count("*").alias("c")).collect()
    ys = np.array(sorted({r["y"] for r in counts}))
    shares = np.zeros((trees, 1 + int(max(r["leaf"] for r in counts)), len(ys)))
    for r in counts:
        shares[r["tree"], int(r["leaf"]), np.searchsorted(ys, r["y"])] = r["c"]
    shares /= np.maximum(shares.sum(2, keepdims=True), 1) * trees
    shared = train.sparkSession.sparkContext.broadcast((ys, np.cumsum(shares, 2)))
    levels, names, n = list(totals.LEVELS.values()), [key, *keep], 1 + len(keep)
    step = max(1, 4_000_000 // len(ys))
    rows = leaves(score, *names)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:n])

    def reached(batches):
        """The first count up to which the shares add up to each level."""
        ys, below = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                leaf = part.column(n).flatten().to_numpy(zero_copy_only=False).reshape(-1, trees).astype(np.int64)
                total = sum(below[t, leaf[:, t]] for t in range(trees))
                found = [pa.array(ys[(total >= level - 1e-9).argmax(1)]) for level in levels]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *found], [*names, *totals.LEVELS])

    return totals.monotone(rows.mapInArrow(reached, kinds + "".join(f", {q} double" for q in totals.LEVELS)))


def quantile_walk_forward(rows: DataFrame, targets: list[str], numeric: list[str], categories: list[str], first: int, trees: int = 10) -> DataFrame:
    """Quantiles and actual value per fold year and target.  Folds with too few rows are left out."""
    data, stages, _ = prepare(rows, numeric, categories)
    data = durable(data)
    sizes, parts = _sizes(data), []
    for y in years_from(data, first):
        if sum(n for k, n in sizes.items() if k < y) < MIN_TRAIN or sizes[y] < MIN_VAL:
            continue
        inputs = Pipeline(stages=stages).fit(data.filter(F.col("yr") < y))
        ready = lambda rows: inputs.transform(rows).select("contest_id", "features", *targets)
        past, coming = ready(data.filter(F.col("yr") < y)).persist(), ready(data.filter(F.col("yr") == y))

        def one(target):
            scored = coming.withColumn("actual", F.col(target).cast("double"))
            return quantile_forest(past, scored, target, [], trees=trees, keep=("actual",)).withColumns({"target": F.lit(target), "fold": F.lit(y)})

        # the targets do not wait for each other's jobs
        with ThreadPool(AT_ONCE) as pool:
            parts.append(durable(reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(one), targets))))
        past.unpersist()
    if not parts:
        raise ValueError("no fold has enough rows")
    return reduce(DataFrame.unionByName, parts)
