"""Quality of predicted probabilities, classes and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contestlake.functions import probability as prob
from contestlake.operators import order


def binary(df: DataFrame, groups: list[str], label: str = "label", p: str = "p", eps: float = 1e-7) -> DataFrame:
    """n, log-loss, Brier, accuracy and average-rank AUC per group."""
    scores = df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(prob.log_loss(F.col(label), F.col(p), eps)).alias("log_loss"),
        F.avg(prob.brier(F.col(label), F.col(p))).alias("brier"),
        F.avg(((F.col(p) >= 0.5).cast("int") == F.col(label)).cast("int")).alias("accuracy"))
    areas = auc(df, groups, label, p)
    if groups:
        return scores.join(areas, groups, "left")
    return scores.withColumn("auc", areas.scalar())


def auc(df: DataFrame, groups: list[str], label: str = "label", p: str = "p") -> DataFrame:
    """Exact AUC with ties at half: equal scores are merged, then negatives below are counted per bin."""
    merged = df.groupBy(*groups, p).agg(F.sum(label).cast("double").alias("pos"),
                                        (F.count("*") - F.sum(label)).cast("double").alias("neg"))
    below = order.running(order.with_bin(merged, p), groups, ["bin"], [p], {"under": "neg"})
    won = F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2))
    return below.groupBy(*groups).agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def reliability(df: DataFrame, label: str = "label", p: str = "p", bins: int = 10) -> DataFrame:
    """Mean prediction and observed share per equal-width bin; the last bin is closed."""
    slot = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    return df.groupBy(slot.alias("slot")).agg(F.avg(p).alias("mean_pred"), F.avg(label).alias("observed"), F.count("*").alias("n"))


def explode_classes(df: DataFrame, classes: list[str], truth: str, probs: dict[str, str]) -> DataFrame:
    """One row per row and class with the renormalised probability and hit flag."""
    total = sum((F.col(probs[c]) for c in classes[1:]), F.col(probs[classes[0]]))
    return df.withColumn("_total", total).select(
        "*", F.inline(F.array(*[F.struct(F.lit(c).alias("class"), F.try_divide(F.col(probs[c]), F.col("_total")).alias("class_p"),
                                         (F.col(truth) == c).cast("int").alias("hit")) for c in classes]))).drop("_total")


def per_class(long: DataFrame) -> DataFrame:
    """One-vs-rest quality of every class and its base rate."""
    scored = binary(long, ["class"], "hit", "class_p")
    return scored.join(long.groupBy("class").agg(F.avg("hit").alias("base_rate"), F.avg("class_p").alias("mean_pred")), "class")


def multiclass(df: DataFrame, classes: list[str], truth: str, probs: dict[str, str], eps: float = 1e-7) -> DataFrame:
    """Log-loss, base-rate log-loss, lift and top-1 accuracy over renormalised rows."""
    total = sum((F.col(probs[c]) for c in classes[1:]), F.col(probs[classes[0]]))
    vec = F.array(*[F.try_divide(F.col(probs[c]), total) for c in classes])
    names = F.array(*[F.lit(c) for c in classes])
    rows = df.filter(F.col(truth).isin(classes)).select(
        F.col(truth).alias("t"), F.element_at(vec, F.array_position(names, F.col(truth)).cast("int")).alias("pt"),
        F.element_at(names, F.array_position(vec, F.array_max(vec)).cast("int")).alias("top"))
    shares = rows.groupBy("t").agg(
        F.count("*").alias("c"), F.sum(-F.log(prob.clip(F.col("pt"), eps, 1.0))).alias("loss"),
        F.sum((F.col("t") == F.col("top")).cast("int")).alias("right"))
    whole = F.sum("c")
    out = shares.agg(whole.alias("n"), (F.sum("loss") / whole).alias("log_loss"), (F.sum("right") / whole).alias("top1"),
                     (-(F.sum(F.col("c") * F.log("c")) / whole - F.log(whole))).alias("base_log_loss"))
    return out.withColumn("lift", F.col("base_log_loss") - F.col("log_loss"))


def drift(df: DataFrame, day: Column, recent_days: int = 90, before_rows: int = 200, alert_at: float = 0.05,
          min_recent: int = 10, min_before: int = 50) -> DataFrame:
    """Log-loss of the recent days against the rows just before them, with an alert flag.

    The older rows are a top-k by (day, id), which Spark limits in every task.
    """
    loss = prob.log_loss(F.col("label"), F.col("p"))
    cut = F.date_sub(day, recent_days)
    recent = df.filter(F.col("dt") >= cut).agg(F.count("*").alias("n_recent"), F.avg(loss).alias("recent"))
    older = (df.filter(F.col("dt") < cut).orderBy(F.col("dt").desc(), F.col("contest_id").desc()).limit(before_rows)
             .agg(F.count("*").alias("n_before"), F.avg(loss).alias("before")))
    both = recent.withColumn("_o", older.select(F.struct("n_before", "before")).scalar()).select("*", "_o.*").drop("_o")
    enough = (F.col("n_recent") >= min_recent) & (F.col("n_before") >= min_before)
    return both.withColumn("delta", F.when(enough, F.col("recent") - F.col("before"))).withColumn(
        "alert", F.coalesce(F.col("delta") > alert_at, F.lit(False)).cast("int"))


def pinball_table(df: DataFrame, levels: dict[str, float], actual: str = "actual") -> DataFrame:
    """Mean pinball loss per quantile column and the share of monotone rows."""
    names = list(levels)
    mono = None
    for a, b in zip(names, names[1:]):
        step = F.col(a) <= F.col(b)
        mono = step if mono is None else mono & step
    return df.agg(F.count("*").alias("n"), F.avg(mono.cast("int")).alias("monotone_share"),
                  *[F.avg(prob.pinball(F.col(actual), F.col(c), l)).alias(f"loss_{c}") for c, l in levels.items()])


def out_of_order(df: DataFrame) -> DataFrame:
    """Rows whose day is earlier than a preceding row's day in stored order (stored key ``seq``).

    Only a running maximum per range of the key is needed: range maxima first, rows second.
    """
    binned = order.with_bin(df.withColumn("_seq", F.col("seq").cast("double")), "_seq")
    from pyspark.sql import Window
    tops = binned.groupBy("bin").agg(F.max("dt").alias("top"))
    w = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select("bin", F.max("top").over(w).alias("before"))
    inside = Window.partitionBy("bin").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = binned.withColumn("here", F.max("dt").over(inside)).join(F.broadcast(before), "bin")
    return seen.agg(F.count("*").alias("n"),
                    F.count_if(F.greatest("before", "here") > F.col("dt")).alias("out_of_order"))
