"""Strictly-prior features per (entity, day), free of same-day leakage.

The history is first reduced to one row per (entity, day).  Every frame then
runs over days, so an entity that owns a large share of all contests still
contributes at most one row per calendar day to its window, and "strictly
before" is simply "earlier day rows".  All frames share the entity partitioning:
one shuffle to (entity, day), one to entity.  A task holds its rows once for each
order that its frames ask for, so frames by day share one order, and the frames of a
decay pass another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contestlake.functions.plan import spread
from contestlake.operators.history import STATS

HALF_LIFE = 3.0
BLOCK = 1500        # contests per rescaling block; 2^(1500/3) stays well inside a double
SUMS = [*STATS, "opp_td_l", "opp_td_a", "opp_sig_l", "opp_sig_a", "won", "ko", "finish",
        "sub_win", "ko_loss", "sub_loss", "finish_loss", "sec"]
NEWEST = 5           # contests that the recent-form features look back on
EWMA = {"win_rate": "won", "finish_rate": "finish", "slpm": "slpm", "kd_per_contest": "kd"}
# measures whose values are present together share one prefix pass
PASSES = [["win_rate", "finish_rate"], ["slpm"], ["kd_per_contest"]]
_RECENT = ["won", "finish", "kd", "td_l", "td_a", "sig_l", "sec"]
_PAST = "OVER (PARTITION BY entity_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_THRU = "OVER (PARTITION BY entity_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def daily(history: DataFrame) -> DataFrame:
    """One row per (entity, day): sums, the newest contests, decayed sums, day-end runs."""
    newest_first = "OVER (PARTITION BY entity_id, dt ORDER BY contest_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ranked = spread(history, "entity_id", "dt").selectExpr("*", "sig_l / (sec / 60D) AS slpm").selectExpr(
        "*", f"row_number() {newest_first} AS rn",
        # place among the values present: 1 for the newest, whose weight is 1
        *[f"count({v}) {newest_first} AS k_{k}" for k, v in EWMA.items()])
    ratio = repr(2.0 ** (-1.0 / HALF_LIFE)) + "D"
    day = ranked.groupBy("entity_id", "dt").agg(*map(F.expr, [
        "count(*) AS n", *[f"sum({c}) AS {c}" for c in SUMS],
        "min(CASE WHEN won = 0 THEN rn END) AS loss_rn", "min(CASE WHEN won = 1 THEN rn END) AS win_rn",
        *[f"struct(coalesce(sum({v} * pow({ratio}, k_{k} - 1)), 0D) AS s, coalesce(sum(CASE WHEN {v} IS NOT NULL THEN pow({ratio}, k_{k} - 1) END), 0D) AS t, "
          f"count({v}) AS k) AS e_{k}" for k, v in EWMA.items()],
        f"array_sort(collect_list(CASE WHEN rn <= {NEWEST} THEN struct(rn, {', '.join(_RECENT)}, slpm) END)) AS tail"]))
    return day


def entity_asof(history: DataFrame, requests: DataFrame) -> DataFrame:
    """Features of each requested (entity_id, dt), from contests on earlier days only."""
    want = requests.selectExpr("entity_id", "dt", "true AS wanted").distinct()
    days = daily(history).join(want, ["entity_id", "dt"], "full")
    ewma = [f"e_{k}" for k in EWMA]
    days = days.selectExpr(
        "entity_id", "dt", "wanted", "tail", "loss_rn", "win_rn", *ewma,
        *[f"coalesce({c}, 0) AS {c}" for c in ["n", *SUMS]])
    days = spread(days, "entity_id")
    days = days.selectExpr("*", f"sum(n) {_THRU} AS thru", f"coalesce(sum(int(n > 0)) {_PAST}, 0) AS act")
    prior = days.selectExpr(
        "entity_id", "dt", "wanted", "n", "tail", *ewma,
        *[f"sum(coalesce(e_{group[0]}.k, 0)) {_THRU} AS _thru_{group[0]}" for group in PASSES],
        # active day k sits at 2k+1 and a request without contests at 2k, so that a
        # RANGE frame over the position always covers the last five active days
        "CASE WHEN n > 0 THEN act * 2 + 1 ELSE act * 2 END AS pos",
        f"coalesce(sum(n) {_PAST}, 0) AS n_prior", *[f"coalesce(sum({c}) {_PAST}, 0) AS p_{c}" for c in SUMS],
        f"max(CASE WHEN n > 0 THEN dt END) {_PAST} AS last_dt",
        # place of the newest loss and win in the entity's whole sequence
        f"coalesce(last(CASE WHEN loss_rn IS NOT NULL THEN thru - loss_rn + 1 END, true) {_PAST}, 0) AS loss_at",
        f"coalesce(last(CASE WHEN win_rn IS NOT NULL THEN thru - win_rn + 1 END, true) {_PAST}, 0) AS win_at",
        "sum(n) OVER (PARTITION BY entity_id ORDER BY dt RANGE BETWEEN INTERVAL 24 MONTHS PRECEDING "
        "AND CURRENT ROW) - n AS n24")
    prior = prior.selectExpr(
        "*", "slice(flatten(transform(array_sort(collect_list(CASE WHEN n > 0 THEN struct(-pos AS back, tail) END) "
        "OVER (PARTITION BY entity_id ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING)), d -> d.tail)), 1, 5)"
        " AS newest").drop("tail")
    for group in PASSES:
        prior = _decay_pass(prior, group)
    return _features(prior.filter("wanted"))


def _decay_pass(days: DataFrame, group: list[str]) -> DataFrame:
    """Half-life means from prefix sums, rescaled per block of contests.

    Day d of a block weighs 2^((contests through d - block start) / half-life).  The last block before it that
    holds contests enters once: scaled back if it is the adjoining one, on its own if the day's block has no
    earlier day, not at all otherwise, as it is then below double precision.  Numerator and denominator share
    the scale, so it cancels.  A day steps by its true number of contests, however many blocks that spans.
    """
    keep = [c for c in days.columns if c != f"_thru_{group[0]}" and c not in [f"e_{k}" for k in group]]
    days = days.selectExpr("*", f"_thru_{group[0]} AS _thru", f"floor(_thru_{group[0]} / {BLOCK}) AS _blk")
    days = days.selectExpr("*", *[
        f"coalesce(e_{k}.{p} * pow(2D, (_thru - _blk * {BLOCK}) / {HALF_LIFE}D), 0D) AS _{p}_{k}"
        for k in group for p in "st"])
    parts = [f"_{p}_{k}" for k in group for p in "st"]
    # the frames by day come first: their order serves those by block
    days = days.selectExpr("*", *[f"coalesce(sum({c}) OVER (PARTITION BY entity_id, _blk ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D) AS _i{c}" for c in parts])
    days = days.selectExpr("*", *[f"sum({c}) OVER (PARTITION BY entity_id, _blk) AS _b{c}" for c in parts])
    back = repr(2.0 ** (-BLOCK / HALF_LIFE)) + "D"
    days = days.selectExpr(
        "*", f"last(struct(_blk AS blk, {', '.join(f'_b{c} AS {c}' for c in parts)})) OVER (PARTITION BY entity_id ORDER BY _blk "
        "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _old")

    def weighted(p, k):
        scale = f"CASE WHEN _i_t_{k} = 0 THEN 1D WHEN _blk - _old.blk = 1 THEN {back} ELSE 0D END"
        return f"(_i_{p}_{k} + coalesce(_old._{p}_{k}, 0D) * {scale})"

    return days.selectExpr(*keep, *[f"try_divide({weighted('s', k)}, {weighted('t', k)}) AS ewma_{k}" for k in group])


def _features(d: DataFrame) -> DataFrame:
    some, sec = "CASE WHEN n_prior > 0 THEN", "greatest(p_sec, 30)"

    def rate(c, name):
        return f"{some} p_{c} / n_prior END AS {name}"

    def per_min(c, name):
        return f"{some} p_{c} / ({sec} / 60D) END AS {name}"

    def share(a, b, name):
        return f"{some} coalesce(try_divide(p_{a}, p_{b}), 0D) END AS {name}"

    def newest(k, c):
        return f"aggregate(slice(newest, 1, {k}), 0L, (a, x) -> a + coalesce(x.{c}, 0))"

    def form(k, c, name):
        return f"{some} {newest(k, c)} / size(slice(newest, 1, {k})) END AS {name}"

    def form_slpm(k):
        return f"{some} {newest(k, 'sig_l')} / ({newest(k, 'sec')} / 60D) END AS l{k}_slpm"

    return d.selectExpr(
        "entity_id", "dt", "n_prior AS n_contests", "p_won AS wins", "n_prior - p_won AS losses",
        rate("won", "win_rate"), rate("finish", "finish_rate"), rate("ko", "ko_rate"), rate("sub_win", "sub_rate"),
        per_min("sig_l", "slpm"), per_min("sig_a", "sapm"), share("sig_l", "sig_a", "sig_acc"),
        per_min("td_l", "td_per_min"), share("td_l", "td_a", "td_acc"), per_min("sub_att", "sub_per_min"),
        f"{some} p_ctrl / {sec} END AS ctrl_ratio",
        form(3, "won", "l3_win_rate"), form(5, "won", "l5_win_rate"), form(3, "finish", "l3_finish_rate"),
        f"{newest(3, 'kd')} AS l3_kd",
        f"{some} coalesce(try_divide({newest(3, 'td_l')}, {newest(3, 'td_a')}), 0D) END AS l3_td_rate",
        form_slpm(3), form_slpm(5),
        "n_prior - loss_at AS win_streak", "n_prior - win_at AS loss_streak",
        "datediff(dt, last_dt) AS days_since_last", "n24 / 2D AS freq_24m",
        *[f"ewma_{k}" for k in EWMA],
        "1D - try_divide(p_opp_td_l, p_opp_td_a) AS td_def", "1D - try_divide(p_opp_sig_l, p_opp_sig_a) AS sig_str_def",
        per_min("opp_sig_l", "sig_abs_per_min"), rate("ko_loss", "ko_loss_rate"), rate("sub_loss", "sub_loss_rate"),
        rate("finish_loss", "finish_loss_rate"),
        "int(n_prior > 0 AND p_finish_loss = 0) AS never_finished")
