"""Boosting of many members at once against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestlake.plans import boosting
from contestlake.plans.boosting import Member


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(2), []
    for k in range(900):
        a, b = rng.gauss(0, 1), rng.choice([None, rng.gauss(0, 1)])
        p = 1 / (1 + math.exp(-(1.2 * a - 0.5 * (b or 0) + 0.8 * math.sin(3 * a))))
        out.append((k, 2000 + k % 6, a, b, rng.choice("xyz"), int(rng.random() < p), rng.choice([0.5, 1.0])))
    return spark.createDataFrame(out, "id long, yr int, a double, b double, c string, label int, weight double").repartition(4).cache()


def grown(rows, members, signs=None, rounds=3, depth=2):
    trees = boosting.prepare(rows, ["a", "b"], ["c"], members, depth)
    kept = boosting.binned(rows, trees, ["id", "yr", "label", "weight"]).cache()
    return boosting.fit(kept, trees, signs, rounds), kept


def looped(rows, member, rounds, depth):
    """Exhaustive splits, node by node; the margin of each row."""
    data = [(r["id"], r["bins"], r["label"], r["weight"] * float(boosting.copies(np.array([r["id"]], np.int64).view(np.uint64), member.bag)[0])) for r in rows if r["yr"] < member.before]
    data = [d for d in data if d[3] > 0]
    margin, every = {d[0]: 0.0 for d in data}, {r["id"]: 0.0 for r in rows}
    for _ in range(rounds):
        steps = {}

        def sums(part):
            p = [1 / (1 + math.exp(-margin[i])) for i, *_ in part]
            return sum(w * (q - y) for (_, _, y, w), q in zip(part, p)), sum(w * q * (1 - q) for (*_, w), q in zip(part, p))

        def gain(g, h):
            return g * g / (h + boosting.PENALTY) / 2

        def grow(part, others, left):
            g, h = sums(part)
            best = None
            if left:
                for f in range(3):
                    for b in range(boosting.BINS - 1):
                        one, two = [d for d in part if d[1][f] <= b], [d for d in part if d[1][f] > b]
                        if not one or not two:
                            continue
                        (g1, h1), (g2, h2) = sums(one), sums(two)
                        worth = gain(g1, h1) + gain(g2, h2) - gain(g, h)
                        if min(h1, h2) >= boosting.LEAST and worth > 1e-9 and (best is None or worth > best[0] * (1 + 1e-9)):
                            best = (worth, f, b)
            if best is None:
                steps.update({i: -boosting.STEP * g / (h + boosting.PENALTY) for i, _ in others})
                return
            _, f, b = best
            for side in (True, False):
                grow([d for d in part if (d[1][f] <= b) == side], [o for o in others if (o[1][f] <= b) == side], left - 1)

        grow(data, [(r["id"], r["bins"]) for r in rows], depth)
        every = {i: v + steps[i] for i, v in every.items()}
        margin = {i: every[i] for i in margin}
    return every


def test_members_are_those_of_plain_loops(rows):
    members = [Member(2003), Member(2005, 0), Member(2005, 1)]
    trees, kept = grown(rows, members)
    got = {(r["member"], r["id"]): r["raw"] for r in boosting.score(kept, trees, ["id"]).collect()}
    plain = kept.collect()
    for m, member in enumerate(members):
        for i, margin in looped(plain, member, 3, 2).items():
            assert got[m, i] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
    assert len(got) == 3 * 900
    table = boosting.node_table(trees, rows.sparkSession)
    assert table.select("member", "tree").distinct().count() == 9 and table.filter("node = 0").count() == 9


@pytest.mark.parametrize("sign", [1, -1])
def test_signs_hold_everywhere(spark, rows, sign):
    trees, _ = grown(rows, [Member(2006), Member(2006, 3)], {"a": sign, "b": -1}, rounds=8, depth=3)
    grid = [(i * 100 + k, 2005, i / 10 - 3, j, c, 0, 1.0) for i in range(60) for k, (j, c) in enumerate([(None, "x"), (0.3, "y"), (-2.0, "z"), (1.5, "x")])]
    points = spark.createDataFrame(grid, "id long, yr int, a double, b double, c string, label int, weight double")
    scored = boosting.score(boosting.binned(points, trees, ["id", "yr"]), trees, ["id"]).collect()
    got = {(r["member"], r["id"]): r["raw"] for r in scored}
    for m in (0, 1):
        for k in range(4):
            line = [got[m, i * 100 + k] for i in range(60)]
            assert all(sign * (y - x) >= -1e-12 for x, y in zip(line, line[1:]))
        assert all(got[m, i * 100 + 2] >= got[m, i * 100 + 1] - 1 for i in range(60))
    assert sign < 0 or max(got.values()) - min(got.values()) > 0.2


def test_bagged_folds(rows):
    fitted = []

    def calibrated(held, scored):
        fitted.append(held.groupBy("fold").count().count())
        return scored.withColumn("p", F.col("raw"))

    out = boosting.bagged_folds(rows.withColumnRenamed("id", "contest_id"), ["a", "b"], ["c"], [2003, 2005], calibrated, bags=4, rounds=3)
    got = {(r["contest_id"], r["fold"]): (r["mean"], r["spread"]) for r in out.collect()}
    assert {k[1] for k in got} == {2003, 2005} and len(got) == 300 and fitted == [2]
    assert all(0 < m < 1 and 0 <= s < 0.2 for m, s in got.values()) and any(s > 0 for _, s in got.values())
    again = {(r["contest_id"], r["fold"]): (r["mean"], r["spread"]) for r in out.collect()}
    assert again == got
