"""Ranked matchup factors, stat gaps and scored rules; numbers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: factors where a lower value is better; all others are better when higher
LOWER_IS_BETTER = ["age", "post_peak", "sig_abs_per_min", "ko_loss_rate", "sub_loss_rate", "finish_loss_rate", "loss_streak", "wrestled_pressure"]
# fixed values: compared statistics and whether higher is better
BARS = {"slpm": True, "sig_acc": True, "sig_str_def": True, "td_per_min": True, "td_def": True, "finish_rate": True, "finish_loss_rate": False}


def resolved_diff(columns: list[str], feature: str) -> Column:
    """The stored difference, else side a minus side b."""
    parts = []
    if f"diff_{feature}" in columns:
        parts.append(F.col(f"diff_{feature}"))
    if f"a_{feature}" in columns and f"b_{feature}" in columns:
        parts.append(F.col(f"a_{feature}") - F.col(f"b_{feature}"))
    return F.coalesce(*parts).cast("double")


def direction(diff: Column, low: Column) -> Column:
    good = F.when(low, -diff).otherwise(diff)
    return F.when(good > 0, "a").when(good < 0, "b").otherwise("tie")


def top_factors(rows: DataFrame, importance: dict[str, float], n: int = 3) -> DataFrame:
    """Per contest the factors with the largest |difference| x importance, relative to the first."""
    cells = [F.struct(F.lit(f).alias("factor"), resolved_diff(rows.columns, f).alias("diff"), F.lit(w).alias("weight"),
                      F.lit(f in LOWER_IS_BETTER).alias("low")) for f, w in importance.items()]
    long = rows.select("contest_id", F.inline(F.array(*cells))).filter("diff IS NOT NULL AND diff <> 0")
    # the factors of one contest are one row's own columns: a short, fixed list
    w = Window.partitionBy("contest_id")
    scored = long.withColumn("score", F.abs("diff") * F.col("weight"))
    ranked = scored.withColumns({"rank": F.row_number().over(w.orderBy(F.col("score").desc(), "factor")), "_top": F.max("score").over(w)})
    return ranked.filter(F.col("rank") <= n).select("contest_id", "rank", "factor", (F.col("score") / F.greatest("_top", F.lit(1e-9))).alias("magnitude"),
                                                    direction(F.col("diff"), F.col("low")).alias("side"))


def stat_gaps(rows: DataFrame, most: int = 6) -> DataFrame:
    """Relative gap and better side of the compared statistics, first ``most`` present ones."""
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("stat"), F.col(f"a_{k}").alias("a"), F.col(f"b_{k}").alias("b"), F.lit(h).alias("high"))
                      for i, (k, h) in enumerate(BARS.items())])
    present = F.slice(F.filter(cells, lambda c: c["a"].isNotNull() & c["b"].isNotNull()), 1, most)
    long = rows.select("contest_id", F.inline(present))
    gap = F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("a"), F.abs("b"), F.lit(1e-6)) * 100
    better = F.when(F.col("high"), F.col("a") >= F.col("b")).otherwise(F.col("a") <= F.col("b"))
    return long.select("contest_id", "stat", F.least(gap, F.lit(99.0)).alias("gap_pct"), F.when(better, "a").otherwise("b").alias("side"))


def _mutual(first: Column, second: Column) -> Column:
    return F.coalesce(first, second, F.lit(0.0))


def rule_scores() -> dict[str, Column]:
    """Strength of each rule; 0 means it does not fire."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    z = lambda c: F.coalesce(c, F.lit(0.0))

    def solid(s):
        n = z(s("n_contests"))
        return F.when(s("never_finished") == 1, 1.0).otherwise(0.0) + F.when(n >= 5, n / 25).otherwise(0.0)

    def wrestle(s, o):
        return F.when((z(s("td_per_min")) > 1.5) & (z(o("td_def")) < 0.6), z(s("td_per_min")) - 1.0 + (0.6 - z(o("td_def"))))

    def knockout(s, o):
        return F.when((z(s("ko_rate")) >= 0.4) & (z(o("ko_loss_rate")) >= 0.2), z(s("ko_rate")) + z(o("ko_loss_rate")))

    def submit(s, o):
        return F.when((z(s("sub_rate")) > 0.3) & (z(o("sub_loss_rate")) > 0.15), z(s("sub_rate")) - 0.3 + (z(o("sub_loss_rate")) - 0.15)).otherwise(0.0)

    def gap(c, at_least):
        return F.when(F.greatest(z(a(c)), z(b(c))) >= at_least, F.abs(z(a(c)) - z(b(c)))).otherwise(0.0)

    n_gap = F.abs(z(a("n_contests")) - z(b("n_contests")))
    return {
        "a_never_finished": solid(a), "b_never_finished": solid(b), "wrestling": _mutual(wrestle(a, b), wrestle(b, a)),
        "striking_volume": gap("slpm", 4.0), "knockout_threat": _mutual(knockout(a, b), knockout(b, a)),
        "experience": F.when((n_gap >= 5) & (F.least(z(a("n_contests")), z(b("n_contests"))) <= 5), n_gap / 10).otherwise(0.0),
        "reach": F.coalesce(F.greatest(F.lit(0.0), F.abs(a("reach_cm") - b("reach_cm")) - 5), F.lit(0.0)),
        "striking_defence": F.when(a("sig_str_def").isNotNull() & b("sig_str_def").isNotNull(), gap("sig_str_def", 0.6)).otherwise(0.0),
        "streak": gap("win_streak", 3.0), "age": F.coalesce(F.greatest(F.lit(0.0), F.abs(a("age") - b("age")) - 4), F.lit(0.0)),
        "submission_threat": F.greatest(submit(a, b), submit(b, a)),
        "uncertainty": F.coalesce(F.when(F.col("uncertainty") >= 0.12, F.col("uncertainty")), F.lit(0.0)),
        "short_notice": F.when((a("short_notice") == 1) | (b("short_notice") == 1), 1.0).otherwise(0.0)}


def top_rules(rows: DataFrame, n: int = 3) -> DataFrame:
    """Per contest the strongest firing rules."""
    cells = F.array(*[F.struct((-v.cast("double")).alias("order"), F.lit(k).alias("rule")) for k, v in rule_scores().items()])
    best = F.slice(F.array_sort(F.filter(cells, lambda c: c["order"] < 0)), 1, n)
    return rows.select("contest_id", F.posexplode(best).alias("i", "c")).select(
        "contest_id", (F.col("i") + 1).alias("rank"), "c.rule", (-F.col("c.order")).alias("score"))
