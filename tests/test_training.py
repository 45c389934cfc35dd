"""Training jobs against plain computations."""

import datetime as dt
import random

import numpy as np
from pyspark.ml.feature import VectorAssembler

from contestlake.plans import training


def test_quantiles_of_one_leaf_are_those_of_all_rows(spark):
    rng = random.Random(4)
    y = [int(rng.expovariate(0.1)) for _ in range(300)]
    train = spark.createDataFrame([(i, 1.0, v) for i, v in enumerate(y)], "contest_id bigint, x double, y int")
    stages = [VectorAssembler(inputCols=["x"], outputCol="features")]
    got = training.quantile_forest(train, train.filter("contest_id < 5"), "y", stages, trees=3).collect()
    want = {f"q{int(100 * q)}": float(np.quantile(y, q, method="inverted_cdf")) for q in (0.1, 0.25, 0.5, 0.75, 0.9)}
    assert len(got) == 5 and all(r[q] == v for r in got for q, v in want.items())


def test_class_folds_use_earlier_rows_and_leave_out_small_ones(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        year = 2000 + i // 300
        x = rng.random()
        rows.append((i, dt.date(year, 1, 1) + dt.timedelta(days=i % 300), year, x, None if i % 3 == 0 else "R1" if x + rng.random() > 1 else "R2"))
    rows.append((900, dt.date(2003, 1, 1), 2003, 0.5, "R1"))
    df = spark.createDataFrame(rows, "contest_id bigint, dt date, yr int, x double, truth string")
    got = training.class_walk_forward(df, ["x"], [], ["R1", "R2"], "truth", 2000, trees=3).collect()
    assert {r["fold"] for r in got} == {2001, 2002} and len(got) == 600
    assert all(abs(r["c_R1"] + r["c_R2"] - 1) < 1e-9 for r in got)
    high, low = ([r["c_R1"] for r in got if cond(r["x"])] for cond in (lambda x: x > 0.8, lambda x: x < 0.2))
    assert np.mean(high) > np.mean(low) + 0.3


def test_queries_score_every_year_that_has_enough_before_it(spark):
    import workload.modelling as modelling
    from workload import load_all
    from workload.registry import Tables

    source = "/root/testdata/sf0.001"
    rows = modelling.training_rows(Tables(spark, source))
    years = training.fold_years(rows, 0)
    got = load_all().queries["walk_forward_predictions"](spark, source)
    assert sorted(r["fold"] for r in got.select("fold").distinct().collect()) == years
    assert got.count() == rows.filter(rows["yr"].isin(years)).count()


def test_quantiles_of_each_leaf_without_shuffling_scored_rows(spark, capsys):
    rng = random.Random(5)
    rows = [(i, float(i % 2), int(rng.expovariate(0.1)) + 100 * (i % 2)) for i in range(600)]
    train = spark.createDataFrame(rows, "contest_id bigint, x double, y int")
    got = training.quantile_forest(train, train, "y", [VectorAssembler(inputCols=["x"], outputCol="features")], trees=3, keep=("y",))
    got.explain()
    assert "Exchange" not in capsys.readouterr().out
    want = {x: {f"q{int(100 * q)}": float(np.quantile([r[2] for r in rows if r[1] == x], q, method="inverted_cdf")) for q in (0.1, 0.25, 0.5, 0.75, 0.9)} for x in (0.0, 1.0)}
    seen = {r["contest_id"]: r for r in got.collect()}
    assert len(seen) == 600 and all(seen[i]["y"] == y and all(seen[i][q] == v for q, v in want[x].items()) for i, x, y in rows)
