"""Global ranks, quantiles and areas without a global task."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestlake.operators import calibrate, cards, metrics, order, resolve


def test_position_with_a_hot_day(spark):
    rng = random.Random(1)
    rows = [(i, dt.date(2001, 1, 1) + dt.timedelta(days=0 if i % 3 else rng.randint(0, 30))) for i in rng.sample(range(100_000), 900)]
    got = order.position(spark.createDataFrame(rows, "contest_id bigint, dt date"), "contest_id").collect()
    want = {c: k for k, (c, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r["contest_id"]: r["pos"] for r in got} == want and got[0]["total"] == 900


def test_position_of_text_ids(spark):
    rng = random.Random(2)
    rows = [(f"contest-é{i:x}", dt.date(2001, 1, 1) + dt.timedelta(days=0 if i % 3 else rng.randint(0, 9))) for i in rng.sample(range(100_000), 300)]
    df = spark.createDataFrame(rows, "contest_id string, dt date")
    got = order.position(df, "contest_id").collect()
    want = {c: k for k, (c, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0].encode())))}
    assert {r["contest_id"]: r["pos"] for r in got} == want
    assert order.by_day(df, "contest_id").select("id_bin").distinct().count() > 1
    pages = cards.nested(df, "dt", [], size=50).collect()
    assert sum(p["n"] for p in pages) == 300 and max(p["n"] for p in pages) == 50


def test_conformal_levels_match_numpy(spark):
    rng = np.random.default_rng(5)
    y, p, g = rng.integers(0, 2, 700), rng.random(700), rng.integers(0, 3, 700)
    p[:250] = 0.25
    g[:20] = 9
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(y, p, g)], "label int, p double, g int")
    res = np.abs(y - p)

    def q(v):
        return np.quantile(v, min(np.ceil((len(v) + 1) * 0.9) / len(v), 1.0))

    assert calibrate.halfwidth(df).first()["halfwidth"] == pytest.approx(q(res))
    got = {r["g"]: r for r in calibrate.halfwidth_by_group(df, "g").collect()}
    for k in (0, 1, 2, 9):
        v = res[g == k]
        assert got[k]["halfwidth"] == pytest.approx(q(res) if len(v) < 50 else q(v)) and got[k]["fallback"] == int(len(v) < 50)
    low_high = calibrate.intervals(df, "g", calibrate.scaled(df), None, calibrate.halfwidth(df)).agg(F.min("lo"), F.max("hi")).first()
    assert 0.0 <= low_high[0] and low_high[1] <= 1.0


def test_auc_counts_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(300)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label int, p double")
    assert metrics.auc(df, []).first()["auc"] == pytest.approx(want)
    perfect = spark.createDataFrame([(0, 0.1), (1, 0.9)], "label int, p double")
    assert metrics.binary(perfect, []).first()["auc"] == 1.0


def test_carry_last_over_a_long_group(spark):
    rows = [(1, i, "v%d" % i if i % 50 == 7 else None) for i in range(500)]
    got = order.carry_last(spark.createDataFrame(rows, "g int, seq int, v string"), ["g"], "seq", "v", "prev", size=30).collect()
    for r in got:
        seen = [x[2] for x in rows if x[1] < r["seq"] and x[2]]
        assert r["prev"] == (seen[-1] if seen else None)


def test_near_days_equals_cross_comparison(spark):
    rng = random.Random(4)
    mk = lambda n: [(i, rng.choice("ab"), dt.date(2000, 1, 1) + dt.timedelta(days=rng.randint(0, 60))) for i in range(n)]
    left, right = mk(60), mk(60)
    schema = "id int, k string, dt date"
    got = resolve.near_days(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], 3)
    want = {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and abs((a[2] - b[2]).days) <= 3}
    rows = got.select("id", "r_id").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
