"""As-of features against a plain loop, with same-day contests, gaps and very busy days."""

import datetime as dt
import random

import pytest

from contestlake.operators import asof, cross, schedule

D0 = dt.date(2000, 1, 1)
COLS = ["contest_id", "entity_id", "dt", "pool", "kd", "sig_l", "sig_a", "td_l", "td_a", "sub_att", "ctrl",
        "opp_td_l", "opp_td_a", "opp_sig_l", "opp_sig_a", "won", "ko", "finish", "sub_win", "ko_loss", "sub_loss", "finish_loss", "sec"]
SCHEMA = ", ".join(f"{c} {'date' if c == 'dt' else 'string' if c == 'pool' else 'bigint'}" for c in COLS)


def history(rng, entities, days, per_day, busy=None):
    rows, cid = [], 0
    for e in range(entities):
        for d in sorted(rng.sample(range(days * 3), days)):
            n = busy if (busy and e == 0 and d % 7 == 0) else rng.randint(1, per_day)
            for _ in range(n):
                cid += 1
                won, ko = rng.randint(0, 1), rng.randint(0, 1)
                sig = rng.randint(0, 40)
                kd = None if rng.random() < 0.2 else rng.randint(0, 3)
                rows.append((cid, e, D0 + dt.timedelta(days=d), "p", kd, sig, sig + 5, 1, 2, 1, 30, 1, rng.randint(0, 2), 3, 9, won, ko, ko, 0,
                             int(ko and not won), 0, int(ko and not won), rng.randint(30, 300)))
    return rows


def expected(rows, e, day):
    past = sorted((r for r in rows if r[1] == e and r[2] < day), key=lambda r: (r[2], r[0]))
    if not past:
        return dict(n_contests=0, win_rate=None, win_streak=0, loss_streak=0, l3_kd=0, ewma_win_rate=None, ewma_kd_per_contest=None, days_since_last=None, l5_win_rate=None)
    won = [r[15] for r in past]

    def ewma(v):
        v = [x for x in v if x is not None]
        if not v:
            return None
        w = [0.5 ** ((len(v) - 1 - i) / 3) for i in range(len(v))]
        return sum(a * b for a, b in zip(v, w)) / sum(w)

    def run(target):
        n = 0
        for x in reversed(won):
            if x != target:
                break
            n += 1
        return n

    return dict(n_contests=len(past), win_rate=sum(won) / len(won), win_streak=run(1), loss_streak=run(0), l3_kd=sum(r[4] or 0 for r in past[-3:]),
                ewma_win_rate=ewma(won), ewma_kd_per_contest=ewma([r[4] for r in past]), days_since_last=(day - past[-1][2]).days,
                l5_win_rate=sum(won[-5:]) / len(won[-5:]))


@pytest.mark.parametrize("busy", [None, 400])
def test_matches_loop(spark, busy):
    rng = random.Random(7)
    rows = history(rng, 3, 25, 3, busy)
    asked = sorted({(r[1], r[2]) for r in rows} | {(e, D0 + dt.timedelta(days=k)) for e in range(3) for k in (0, 20, 50, 200)})
    got = asof.entity_asof(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "entity_id bigint, dt date")).collect()
    assert len(got) == len(asked)
    for r in got:
        for k, v in expected(rows, r["entity_id"], r["dt"]).items():
            assert r[k] == (pytest.approx(v, rel=1e-9, abs=1e-12) if v is not None else None), (k, r["entity_id"], r["dt"])


def test_long_career_uses_blocks(spark):
    rows = [(i, 0, D0 + dt.timedelta(days=i), "p", i % 4, 5, 9, 0, 0, 0, 0, 0, 0, 0, 0, int(i * 7919 % 10 < 5), 0, 0, 0, 0, 0, 0, 60) for i in range(3300)]
    days = [1499, 1500, 1501, 2999, 3001, 3290]
    asked = spark.createDataFrame([(0, D0 + dt.timedelta(days=k)) for k in days], "entity_id bigint, dt date")
    for r in asof.entity_asof(spark.createDataFrame(rows, SCHEMA), asked).collect():
        assert r["ewma_win_rate"] == pytest.approx(expected(rows, 0, r["dt"])["ewma_win_rate"], rel=1e-9)


def test_days_of_many_contests(spark):
    """A day counts with all its contests, also if it spans several blocks."""
    per_day = [3, 400, 2, 4000, 1, 1, 160, 2]
    flat = [d for d, n in enumerate(per_day) for _ in range(n)]
    rows = [(i, 0, D0 + dt.timedelta(days=d), "p", i % 4, 5, 9, 0, 0, 0, 0, 0, 0, 0, 0, int(i * 7919 % 10 < 5), 0, 0, 0, 0, 0, 0, 60) for i, d in enumerate(flat)]
    asked = spark.createDataFrame([(0, D0 + dt.timedelta(days=k)) for k in range(9)], "entity_id bigint, dt date")
    for r in asof.entity_asof(spark.createDataFrame(rows, SCHEMA), asked).collect():
        want = expected(rows, 0, r["dt"])["ewma_win_rate"]
        assert r["ewma_win_rate"] == (pytest.approx(want, rel=1e-9) if want is not None else None), r["dt"]


def test_schedule_strength_matches_loop(spark):
    rng = random.Random(3)
    rows = sorted({(e, D0 + dt.timedelta(days=rng.randint(0, 12)), c, 1400.0 + rng.randint(0, 300), rng.randint(0, 1)) for c, e in enumerate([0] * 40 + [1] * 9)})
    df = spark.createDataFrame(rows, "entity_id bigint, dt date, contest_id bigint, opp_score double, won int")
    for r in schedule.rolling(df).collect():
        past = sorted(x for x in rows if x[0] == r["entity_id"] and (x[1], x[2]) < (r["dt"], r["contest_id"]))[-5:]
        assert r["sos_opponent"] == (pytest.approx(sum(x[3] for x in past) / len(past)) if past else None)


def test_mirror_twice_is_identity(spark):
    rows = [(1, 1, 1, 10, 20, 0.5, 1.0, 2.0, 1, 0, 3.0, 4.0, 1500.0, 1490.0)]
    cols = "contest_id label a_is_red a_id b_id diff_x a_slpm b_slpm a_southpaw_vs_b_orthodox a_orthodox_vs_b_southpaw expected_a_td_landed expected_b_td_landed elo_a elo_b".split()
    both = cross.mirror(spark.createDataFrame(rows, cols))
    again = cross.mirror(both)
    assert sorted(map(tuple, again.collect())) == sorted(list(map(tuple, both.collect())) * 2)
    other = both.filter("label = 0").first()
    assert (other["a_id"], other["a_slpm"], other["diff_x"], other["a_orthodox_vs_b_southpaw"], other["expected_a_td_landed"], other["elo_a"]) == (20, 2.0, -0.5, 1, 4.0, 1490.0)


def test_frames_share_few_orders(spark):
    """A task keeps its rows once for each order, so a decay pass asks for one only, and its inputs are dropped after it."""
    cols = ", ".join(f"{c} bigint" for c in ["kd", "sig_l", "sig_a", "td_l", "td_a", "sub_att", "ctrl", "opp_td_l", "opp_td_a", "opp_sig_l", "opp_sig_a", "won", "ko", "finish", "sub_win", "ko_loss", "sub_loss", "finish_loss", "sec"])
    rows = spark.createDataFrame([], f"contest_id bigint, entity_id bigint, dt date, pool string, {cols}")
    plan = asof.entity_asof(rows, rows.select("entity_id", "dt"))._jdf.queryExecution().executedPlan().toString()
    orders = [line for line in plan.splitlines() if "Sort [entity_id" in line and "_blk" in line]
    assert len(orders) == len(asof.PASSES)


def test_sides_compute_only_what_is_read(spark, capsys):
    """Features that nobody reads cost no frame, and rows are dealt by entity whatever the session's partitions are."""
    rows = spark.createDataFrame(history(random.Random(8), 4, 10, 2), SCHEMA)
    contests = rows.selectExpr("contest_id", "dt", "pool", "entity_id AS a_id", "(entity_id + 1) % 4 AS b_id")
    feats = asof.entity_asof(rows, contests.selectExpr("dt", "explode(array(a_id, b_id)) AS entity_id"))
    got = cross.attach_sides(contests, feats).select("contest_id", cross.difference("win_rate"), "fa.slpm", "fb.n_contests")
    got.explain()
    plan = capsys.readouterr().out
    assert "_blk" not in plan and "collect_list" not in plan
    assert "hashpartitioning(entity_id" in plan and "2000)" in plan
    seen = {r["contest_id"]: (r["diff_win_rate"], r["n_contests"]) for r in got.collect()}
    for r in contests.collect():
        a, b = (expected([x for x in map(tuple, rows.collect())], e, r["dt"]) for e in (r["a_id"], r["b_id"]))
        diff = None if a["win_rate"] is None or b["win_rate"] is None else pytest.approx(a["win_rate"] - b["win_rate"])
        assert seen[r["contest_id"]] == (diff, b["n_contests"])
