"""Side assignment, differences, crosses and the mirrored training matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from contestlake.functions import parse, plan
from contestlake.operators.history import sides

# fixed values: rates that become differences, in report order
DIFFS = ["win_rate", "finish_rate", "ko_rate", "sub_rate", "slpm", "sapm", "sig_acc", "td_per_min", "td_acc",
         "sub_per_min", "ctrl_ratio", "l3_win_rate", "l5_win_rate", "l3_finish_rate", "l3_kd", "l3_td_rate",
         "l3_slpm", "l5_slpm", "win_streak", "loss_streak", "freq_24m", "ewma_win_rate", "ewma_finish_rate",
         "ewma_slpm", "ewma_kd_per_contest", "td_def", "sig_str_def", "sig_abs_per_min", "ko_loss_rate",
         "sub_loss_rate", "finish_loss_rate"]
# fixed values: rates kept per side
ABSOLUTE = ["ko_rate", "sub_rate", "finish_rate", "sub_per_min", "td_per_min", "slpm", "sapm", "sig_acc",
            "ctrl_ratio", "td_def", "sig_str_def", "sig_abs_per_min", "ko_loss_rate", "sub_loss_rate",
            "finish_loss_rate", "never_finished"]
# fixed values: rates pulled to the pool mean for newcomers
SHRUNK = ["win_rate", "finish_rate", "ko_rate", "sub_rate", "slpm", "sapm", "sig_acc", "td_per_min", "td_acc",
          "sub_per_min", "ctrl_ratio"]
TRUSTED = 5
PULL = 0.3
# fixed values: peak age per pool of the shipped age table
PEAK_AGE = {"heavyweight": 28, "light heavyweight": 24, "middleweight": 25, "welterweight": 25, "lightweight": 26,
            "featherweight": 26, "bantamweight": 24, "flyweight": 27, "women's strawweight": 24,
            "women's flyweight": 24, "women's bantamweight": 26}
# output: (own column, opposing column, gated); gated multiplies by one minus the opposing rate
CROSSES = {
    "{s}_finish_threat": ("finish_rate", "finish_loss_rate", False),
    "expected_{s}_ko_threat": ("ko_rate", "ko_loss_rate", False),
    "expected_{s}_sub_threat": ("sub_rate", "sub_loss_rate", False),
    "expected_{s}_strikes_landed": ("slpm", "sig_str_def", True),
    "expected_{s}_sig_acc": ("sig_acc", "sig_str_def", True),
    "expected_{s}_td_landed": ("td_per_min", "td_def", True),
}


def assign_sides(contests: DataFrame) -> DataFrame:
    """Side A is red for half of the contests, chosen by a hash of the contest id."""
    red = (F.substring(F.md5(F.col("contest_id").cast("string")), 1, 1) < "8")
    out = contests.withColumn("a_is_red", red.cast("int"))
    pick = {"id": "{}_id", "short_notice": "{}_short_notice", "odds": "odds_{}"}
    cols = {}
    for name, pattern in pick.items():
        r, b = pattern.format("red"), pattern.format("blue")
        if r in contests.columns:
            cols[f"a_{name}"] = F.when(red, F.col(r)).otherwise(F.col(b))
            cols[f"b_{name}"] = F.when(red, F.col(b)).otherwise(F.col(r))
    out = out.withColumns(cols)
    return out.withColumn("label", (F.col("winner_id") == F.col("a_id")).cast("int"))


def pool_means(contests: DataFrame, totals: DataFrame, finish_by_text: bool = True) -> DataFrame:
    """Ratio-of-sums rates of each pool, one row per pool.

    ``finish_by_text=False`` keeps the exact-match test under which 'KO/TKO'
    does not count as a knockout.
    """
    m = F.upper("method")
    ko = m.contains("KO") if finish_by_text else F.col("method").isin("KO", "TKO")
    sub = m.contains("SUB") if finish_by_text else F.col("method") == "SUB"
    won = F.coalesce(F.col("winner_id") == F.col("entity_id"), F.lit(False))
    minutes = F.sum("time_ended_sec") / 60.0
    joined = (contests.filter("method IS NOT NULL").select("contest_id", "pool", "winner_id", "method", "time_ended_sec")
              .join(totals.select("contest_id", "entity_id", "sig_l", "sig_a", "td_l", "td_a", "sub_att", "ctrl"), "contest_id"))

    def per_minute(c):
        return F.try_divide(F.sum(c), minutes)

    aggs = {
        "win_rate": F.avg(won.cast("int")), "finish_rate": F.avg((ko | sub).cast("int")),
        "ko_rate": F.avg(ko.cast("int")), "sub_rate": F.avg((sub & won).cast("int")),
        "slpm": per_minute("sig_l"), "sapm": per_minute("sig_a"),
        "sig_acc": F.try_divide(F.sum("sig_l"), F.sum("sig_a")), "td_per_min": per_minute("td_l"),
        "td_acc": F.try_divide(F.sum("td_l"), F.sum("td_a")), "sub_per_min": per_minute("sub_att"),
        "ctrl_ratio": F.try_divide(F.sum("ctrl"), F.sum("time_ended_sec")),
    }
    return joined.groupBy("pool").agg(*[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in aggs.items()])


def pool_means_asof(contests: DataFrame, totals: DataFrame) -> DataFrame:
    """The same rates from contests on earlier days only: one row per (pool, day)."""
    from pyspark.sql import Window
    m = F.upper("method")
    ko, sub = m.contains("KO"), m.contains("SUB")
    won = F.coalesce(F.col("winner_id") == F.col("entity_id"), F.lit(False))
    joined = contests.filter("method IS NOT NULL").join(totals.drop("dt", "period_ended"), "contest_id")
    parts = {"rows": F.lit(1), "won": won.cast("int"), "fin": (ko | sub).cast("int"), "ko": ko.cast("int"),
             "subw": (sub & won).cast("int"), "sec": F.col("time_ended_sec")}
    parts.update({c: F.col(c) for c in ("sig_l", "sig_a", "td_l", "td_a", "sub_att", "ctrl")})
    daily = joined.groupBy("pool", "dt").agg(*[F.sum(v).alias(k) for k, v in parts.items()])
    w = Window.partitionBy("pool").orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    p = daily.select("pool", "dt", *[F.sum(k).over(w).alias(k) for k in parts])
    minutes = F.col("sec") / 60.0
    rates = {"win_rate": ("won", "rows"), "finish_rate": ("fin", "rows"), "ko_rate": ("ko", "rows"),
             "sub_rate": ("subw", "rows"), "sig_acc": ("sig_l", "sig_a"), "td_acc": ("td_l", "td_a"),
             "ctrl_ratio": ("ctrl", "sec")}
    cols = {k: F.try_divide(F.col(a), F.col(b)) for k, (a, b) in rates.items()}
    cols.update({k: F.try_divide(F.col(a), minutes) for k, a in
                 {"slpm": "sig_l", "sapm": "sig_a", "td_per_min": "td_l", "sub_per_min": "sub_att"}.items()})
    return p.select("pool", "dt", *[F.coalesce(cols[k], F.lit(0.0)).alias(k) for k in SHRUNK])


def shrink(features: DataFrame, means: DataFrame) -> DataFrame:
    """Pull the rates of entities with 1..4 prior contests towards the pool mean.

    ``means`` is keyed by pool, or by (pool, dt) when it is itself as-of.
    Newcomers without any contest keep their NULL rates.
    """
    keys = ["pool", "dt"] if "dt" in means.columns else ["pool"]
    prior = means.select(*keys, *[F.col(c).alias(f"_m_{c}") for c in SHRUNK])
    n = F.col("n_contests")
    weight = F.lit(PULL) * (1 - n / TRUSTED)
    few = (n > 0) & (n < TRUSTED)

    def pulled(c):
        mean = F.col(f"_m_{c}")
        mixed = F.coalesce((1 - weight) * F.col(c) + weight * mean, mean, F.col(c))
        return F.when(few & mean.isNotNull(), mixed).otherwise(F.col(c))

    return (features.join(prior, keys, "left").withColumns({c: pulled(c) for c in SHRUNK})
            .drop(*[f"_m_{c}" for c in SHRUNK]))


def attach_sides(contests: DataFrame, features: DataFrame) -> DataFrame:
    """Join per-entity features to both sides of a contest; ``fa.<name>`` and ``fb.<name>`` name them.

    ``features`` has one row per key.  The features stay plain columns under the two aliases: a struct of them would have
    every feature computed, whichever of them are read.  Both sides read one exchange of the features.
    """
    keys = ["dt", "pool"] if "pool" in features.columns else ["dt"]
    feats = [c for c in features.columns if c not in ("entity_id", "dt", "pool")]
    spread = plan.spread(features, "entity_id", *keys)
    out = contests
    for s in "ab":
        side = spread.select(F.col("entity_id").alias(f"_{s}_id"), *[F.col(k).alias(f"_{s}_{k}") for k in keys], *feats)
        out = out.join(side.alias(f"f{s}"), reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{s}_{x}") for k, x in [(f"{s}_id", "id"), *zip(keys, keys)]]), "left")
    return out.select(*contests.columns, *[F.col(f"f{s}.{c}") for s in "ab" for c in feats])


def difference(c: str) -> Column:
    return (F.col(f"fa.{c}") - F.col(f"fb.{c}")).alias(f"diff_{c}")


def cross_features() -> list[Column]:
    """Style crosses of both sides and their differences."""
    made: dict[str, Column] = {}

    def gate(own, opp, gated):
        return own * (1.0 - opp) if gated else own * opp

    for pattern, (mine, theirs, gated) in CROSSES.items():
        for s, o in (("a", "b"), ("b", "a")):
            made[pattern.format(s=s)] = gate(F.col(f"f{s}.{mine}"), F.col(f"f{o}.{theirs}"), gated)
    for s, o in (("a", "b"), ("b", "a")):
        made[f"{s}_keep_standing"] = F.col(f"f{s}.slpm") * F.col(f"f{s}.td_def")
        made[f"{s}_wrestled_pressure"] = F.col(f"f{o}.td_per_min") * (1.0 - F.col(f"f{s}.td_def"))
        made[f"expected_{s}_strikes_taken"] = F.col(f"f{o}.slpm") * (1.0 - F.col(f"f{s}.sig_str_def"))
    out = [v.alias(k) for k, v in made.items()]
    for k in made:
        if k.startswith("a_"):
            out.append((made[k] - made["b_" + k[2:]]).alias("diff_" + k[2:]))
        elif k.startswith("expected_a_"):
            rest = k[len("expected_a_"):]
            out.append((made[k] - made["expected_b_" + rest]).alias("diff_expected_" + rest))
    return out


def physicals(rows: DataFrame, entities: DataFrame, peak: DataFrame | None = None) -> DataFrame:
    """Ages, reach, height, stance flags and years past the pool's peak age, per side."""
    dims = entities.select("entity_id", "dob", "stance", "height_cm", "reach_cm")
    # one join for both sides: a side row per contest, folded back by contest
    packed = (rows.select("contest_id", F.inline(F.array(
        F.struct(F.lit("a").alias("_side"), F.col("a_id").alias("entity_id")),
        F.struct(F.lit("b").alias("_side"), F.col("b_id").alias("entity_id")))))
        .join(dims, "entity_id", "left"))
    bundle = F.struct("dob", "stance", "height_cm", "reach_cm")
    folded = packed.groupBy("contest_id").agg(
        F.max(F.when(F.col("_side") == "a", bundle)).alias("_pa"), F.max(F.when(F.col("_side") == "b", bundle)).alias("_pb"))
    out = rows.join(folded, "contest_id", "left")
    for s in "ab":
        stance = F.lower(F.trim(F.coalesce(F.col(f"_p{s}.stance"), F.lit(""))))
        out = out.withColumns({
            f"{s}_age": parse.age_years(F.col(f"_p{s}.dob"), F.col("dt")),
            f"{s}_reach_cm": F.col(f"_p{s}.reach_cm"), f"{s}_height_cm": F.col(f"_p{s}.height_cm"),
            f"_{s}_south": stance == "southpaw", f"_{s}_ortho": stance.isin("orthodox", "switch", "")})
    if peak is not None:
        out = out.join(F.broadcast(peak.select("pool", "peak_age")), "pool", "left")
    else:
        table = F.create_map(*[F.lit(x) for kv in PEAK_AGE.items() for x in kv])
        out = out.withColumn("peak_age", table[parse.pool_key(F.col("pool"))])
    out = out.withColumns({f"{s}_post_peak": parse.years_past(F.col(f"{s}_age"), F.col("peak_age")) for s in "ab"})
    out = out.withColumns({
        **{f"diff_{c}": F.col(f"a_{c}") - F.col(f"b_{c}") for c in ("age", "post_peak", "reach_cm", "height_cm")},
        "a_southpaw_vs_b_orthodox": (F.col("_a_south") & F.col("_b_ortho")).cast("int"),
        "a_orthodox_vs_b_southpaw": (F.col("_a_ortho") & F.col("_b_south")).cast("int"),
        "both_southpaw": (F.col("_a_south") & F.col("_b_south")).cast("int")})
    return out.drop("_pa", "_pb", "peak_age", "_a_south", "_b_south", "_a_ortho", "_b_ortho")


def _partner(c: str, have: set[str]) -> str | None:
    """Column of the other side, by the naming rules of this module."""
    fixed = {"a_southpaw_vs_b_orthodox": "a_orthodox_vs_b_southpaw",
             "a_orthodox_vs_b_southpaw": "a_southpaw_vs_b_orthodox"}
    if c in fixed:
        return fixed[c]
    swaps = [("a_", "b_"), ("expected_a_", "expected_b_")]
    for x, y in swaps:
        for p, q in ((x, y), (y, x)):
            if c.startswith(p) and q + c[len(p):] in have:
                return q + c[len(p):]
    for p, q in (("_a", "_b"), ("_b", "_a")):
        if c.endswith(p) and c[:-2] + q in have:
            return c[:-2] + q
    return None


def mirror(rows: DataFrame) -> DataFrame:
    """Each contest from both points of view: sides swapped, differences negated; one pass over the rows."""
    have = set(rows.columns)

    def seen(c):
        if c in ("label", "a_is_red"):
            return (1 - F.col(c)).alias(c)
        if c.startswith("diff_"):
            return (-F.col(c)).alias(c)
        return F.col(_partner(c, have) or c).alias(c)

    same = F.struct(*[F.col(c).alias(c) for c in rows.columns])
    return rows.select(F.inline(F.array(same, F.struct(*[seen(c) for c in rows.columns]))))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def requests_of(contests: DataFrame) -> DataFrame:
    """(entity, day) pairs that need as-of features."""
    return sides(contests, "dt").select("entity_id", "dt").distinct()


def age_curve(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Win rate and count by pool and whole years of age; entities of unknown age are left out."""
    aged = rows.join(entities.filter("dob IS NOT NULL").select("entity_id", "dob"), "entity_id")
    age = F.floor(parse.age_years(F.col("dob"), F.col("dt"))).alias("age")
    return aged.groupBy("pool", age).agg(F.avg("won").alias("win_rate"), F.count("*").alias("n"))


def peak_ages(curve: DataFrame, at_least: int) -> DataFrame:
    """Age with the best win rate per pool, the youngest on ties."""
    return (curve.filter(F.col("n") >= at_least).groupBy("pool")
            .agg(F.expr("min_by(age, struct(-win_rate, age)) AS peak_age")))
