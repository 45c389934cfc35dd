"""Class probabilities made consistent with the winner probability."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contestlake.functions import probability as prob

KINDS = ["ko", "sub", "dec"]
# fixed values: round shares of finishes when no round model is present
ROUND_PRIOR = {"short": [0.38, 0.28, 0.34, 0.0, 0.0], "long": [0.26, 0.20, 0.20, 0.18, 0.16]}


def _finish(rows: DataFrame) -> DataFrame:
    out = rows.withColumns({"p_finish": F.col("pa_ko") + F.col("pa_sub") + F.col("pb_ko") + F.col("pb_sub"),
                            "p_decision": F.col("pa_dec") + F.col("pb_dec")})
    return out


def scale_to_winner(rows: DataFrame) -> DataFrame:
    """Scale each side's classes to p and 1-p; round shares r1..r5 become P(finish in round)."""
    target = {"a": F.col("p"), "b": 1.0 - F.col("p")}
    scaled = {}
    for s in "ab":
        total = F.col(f"p{s}_ko") + F.col(f"p{s}_sub") + F.col(f"p{s}_dec")
        factor = F.when(total > 1e-9, target[s] / total).otherwise(F.lit(0.0))
        scaled.update({f"p{s}_{k}": F.col(f"p{s}_{k}") * factor for k in KINDS})
    out = _finish(rows.withColumns(scaled))
    total = F.col("r1") + F.col("r2") + F.col("r3") + F.col("r4") + F.col("r5")
    return out.withColumns({f"p_r{i}": F.try_divide(F.col(f"r{i}"), total) * F.col("p_finish") for i in range(1, 6)})


def from_rates(rows: DataFrame) -> DataFrame:
    """Class probabilities from career rates, or from their differences when rates are missing."""
    has_ko = F.col("a_ko_rate").isNotNull() & F.col("b_ko_rate").isNotNull()
    has_sub = F.col("a_sub_rate").isNotNull() & F.col("b_sub_rate").isNotNull()
    dko, dsub = F.coalesce("diff_ko_rate", F.lit(0.0)), F.coalesce("diff_sub_rate", F.lit(0.0))
    ko = F.when(has_ko, (F.col("a_ko_rate") + F.col("b_ko_rate")) / 2).otherwise(0.28 + prob.clip(dko * 0.5, -0.12, 0.12))
    sub = (F.when(has_ko & has_sub, (F.col("a_sub_rate") + F.col("b_sub_rate")) / 2).when(has_ko, F.lit(0.12))
           .otherwise(0.12 + prob.clip(dsub * 0.5, -0.06, 0.06)))
    out = rows.withColumns({"_ko": ko, "_sub": sub})
    out = out.withColumn("_dec", F.greatest(F.lit(0.01), 1.0 - F.col("_ko") - F.col("_sub")))
    out = out.withColumn("_all", F.col("_ko") + F.col("_sub") + F.col("_dec"))
    side = {"a": F.col("p"), "b": 1.0 - F.col("p")}
    out = out.withColumns({f"p{s}_{k}": F.col(f"_{k}") / F.col("_all") * side[s] for s in "ab" for k in KINDS})
    out = _finish(out)
    prior = [F.when(F.col("is_long") == 1, F.lit(l)).otherwise(F.lit(s)) for s, l in zip(ROUND_PRIOR["short"], ROUND_PRIOR["long"])]
    return out.withColumns({f"p_r{i}": w * F.col("p_finish") for i, w in enumerate(prior, start=1)}).drop("_ko", "_sub", "_dec", "_all")
