"""Pricing, portfolio and grading expectations."""

import random

import pytest
from pyspark.sql import functions as F

from contestlake.operators import grade, portfolio, pricing, totals
from contestlake.sources import documents

BETS = "scope string, bet_id bigint, contest string, our_prob double, price double, kelly_pct double, outcome_keys array<string>"


def book(spark, rows):
    return spark.createDataFrame([("all", i, c, 0.5, d, k, keys) for i, (c, d, k, keys) in enumerate(rows)], BETS)


def stakes(df):
    return [r["stake_pct"] for r in df.orderBy("bet_id").collect()]


def test_caps(spark):
    """A book of mixed prices: what is within the limits is left as it is, and no limit is passed anywhere."""
    modest = [("m", 1.9, 2.25, ["A|DEC|"]), ("n", 3.4, 1.5, ["B|SUB|2", "B|SUB|3"]), ("o", 6.0, 4.75, ["B|KO|1"])]
    assert sorted(stakes(portfolio.build(book(spark, modest)))) == [1.5, 2.25, 4.75]
    rng = random.Random(31)
    crowded = [(f"e{rng.randrange(7)}", round(rng.uniform(1.6, 7), 2), round(rng.uniform(2, 30), 1), ["B|SUB|1", f"A|KO|{rng.randrange(1, 6)}"]) for _ in range(35)]
    legs = portfolio.build(book(spark, crowded)).collect()
    by_contest = {}
    for r in legs:
        by_contest.setdefault(r["contest"], []).append(r["stake_pct"])
    assert legs and all(0 < x <= 5 for v in by_contest.values() for x in v) and all(sum(v) <= 15 + 1e-9 for v in by_contest.values())
    assert sum(map(sum, by_contest.values())) <= 50 + 1e-9
    apart = [(f"g{k}", 2.2 + k / 8, 3.1 + (k * 7 % 11) / 4, ["B|DEC|"]) for k in range(11)]
    assert len(set(stakes(portfolio.build(book(spark, apart[:6]), "flat")))) == 1
    assert portfolio.build(book(spark, apart * 30), "flat").count() == 0  # shares below the smallest stake
    assert portfolio.build(book(spark, apart), "concentrated").count() == 8
    assert portfolio.build(book(spark, [("w", 3.0, 2.6, [f"A|SUB|{k}"]) for k in range(1, 6)])).count() == 1  # no two can win together
    with pytest.raises(ValueError):
        portfolio.build(book(spark, modest), "everything")


def test_repeated_sets_keep_five(spark):
    assert portfolio.build(book(spark, [("x", 2.5, 4.0, ["A|KO|1"]) for _ in range(9)])).count() == 5


def summary(spark, rows):
    legs = spark.createDataFrame([("all", c, s, 0.0, m, k) for c, s, m, k in rows], "scope string, contest string, stake_pct double, ev_per_unit double, payout double, outcome_keys array<string>")
    return portfolio.summary(legs).first()["best_case_pct"]


def test_best_case(spark):
    # overlapping legs both win, disjoint ones exclude each other, contests add up, no keys always win
    assert summary(spark, [("x", 5.0, 1.0, ["A|KO|1", "A|SUB|1"]), ("x", 4.0, 2.0, ["A|KO|1"])]) == pytest.approx(13.0)
    assert summary(spark, [("x", 5.0, 1.0, ["A|KO|1"]), ("y", 5.0, 2.0, ["B|KO|1"])]) == pytest.approx(15.0)
    assert summary(spark, [("x", 2.0, 2.0, [])]) == pytest.approx(4.0)
    assert summary(spark, [("x", 5.0, 2.0, ["A|KO|1"]), ("x", 4.0, 1.0, ["B|KO|1"])]) == pytest.approx(6.0)


def test_same_outcome_keeps_better_price(spark):
    raw = spark.createDataFrame([(1, "distance", "Yes", 0.6, 1.85, ["A|DEC|DEC", "B|DEC|DEC"]), (1, "method_neutral", "Points", 0.6, 1.95, ["B|DEC|DEC", "A|DEC|DEC"])],
                                "contest_id int, market string, selection string, our_prob double, price double, outcome_keys array<string>")
    buckets = spark.createDataFrame([("distance", 0.0, 1.0, 9.0, 40)], "market_class string, edge_lo double, edge_hi double, roi_pct double, n int")
    rows = pricing.dedup(pricing.gate(pricing.value(raw), buckets)).collect()
    assert [(r["price"], r["is_value"], r["n_merged"], r["hist_n"]) for r in rows] == [(1.95, 1, 2, 0)] or (rows[0]["price"], rows[0]["is_value"]) == (1.95, 1)


def pred(spark, is_long):
    return spark.createDataFrame([(1, is_long, 0.2, 0.1, 0.25, 0.15, 0.1, 0.2, 0.2, 0.15, 0.1, 0.06, 0.04, 0.55, 0.45, 0.55, "Ann Lee", "Bo Roe")],
                                 "contest_id int, is_long int, pa_ko double, pa_sub double, pa_dec double, pb_ko double, pb_sub double, pb_dec double, p_r1 double, p_r2 double, p_r3 double, "
                                 "p_r4 double, p_r5 double, p_finish double, p_decision double, p double, a_name string, b_name string")


@pytest.mark.parametrize("is_long", [0, 1])
def test_joint_sums_to_marginals(spark, is_long):
    rows = {(r["side"], r["method"]): r["s"] for r in pricing.joint(pred(spark, is_long)).groupBy("side", "method").agg(F.sum("p").alias("s")).collect()}
    assert rows == {k: pytest.approx(v) for k, v in {("A", "KO"): 0.2, ("A", "SUB"): 0.1, ("B", "KO"): 0.15, ("B", "SUB"): 0.1}.items()}
    assert pricing.joint(pred(spark, is_long).withColumn("p_finish", F.lit(0.0))).agg(F.sum("p")).first()[0] == 0.0


def test_half_lines_round_up_only_in_compat(spark):
    quotes = spark.createDataFrame([(1, "total_rounds", "Under 2.5 Rounds", None, None, None, 2.0)],
                                   "contest_id int, market string, selection string, side string, method string, rounds array<int>, price double")
    keys = {c: pricing.price(quotes, pred(spark, 0), compat=c).first() for c in (True, False)}
    assert keys[True]["our_prob"] == pytest.approx(0.45) and keys[False]["our_prob"] == pytest.approx(0.35)
    assert len(keys[True]["outcome_keys"]) == 12 and len(keys[False]["outcome_keys"]) == 8


def test_over_probability(spark):
    rows = spark.createDataFrame([(80.0, 110.0, 140.0, 175.0, 215.0, float(x)) for x in range(0, 400, 20)] + [(80.0, 110.0, 140.0, 175.0, 215.0, 10_000.0)],
                                 "q10 double, q25 double, q50 double, q75 double, q90 double, line double")
    got = [r[0] for r in totals.monotone(rows).select(totals.over_probability(F.col("line"))).collect()]
    assert got[0] >= 0.95 and got[-1] <= 0.05 and all(a >= b for a, b in zip(got, got[1:]))


def test_grading(spark):
    bets = spark.createDataFrame([(1, "m", "a", ["A|KO|1", "A|DEC|DEC"]), (1, "m", "b", ["B|KO|1"]), (2, "m", "c", ["A|KO|1"]), (2, "m", "d", ["A|DEC|DEC", "B|DEC|DEC"]), (1, "t", "e", ["TOTAL|total_sig_strikes_a|over|10.5"]),
                                  (1, "t", "f", ["TOTAL|total_sig_strikes_a|under|12"]), (1, "x", "g", [])], "contest_id int, market string, selection string, outcome_keys array<string>")
    results = spark.createDataFrame([(1, "A|KO|1", "A"), (2, None, "A")], "contest_id int, actual_key string, actual_side string")
    actual = spark.createDataFrame([(1, "total_sig_strikes_a", 12.0)], "contest_id int, market string, actual double")
    got = {r["selection"]: r["result"] for r in grade.grade(bets, results, actual).collect()}
    assert got == {"a": "won", "b": "lost", "c": "won", "d": None, "e": "won", "f": "lost", "g": None}


def test_joint_market_documents(spark):
    doc = ('{"markets":[{"name":"Method & Round Combo (3 Rounds)","selections":[' + ",".join('{"name":"%s","price":{"winPrice":9.0}}' % s for s in
           ("Ann Lee KO/TKO & Round 1", "Ann Lee Submission & Round 2", "Bo Roe KO/TKO & Round 3", "Submission & Round 1", "KO/TKO & Round 2",
            "Ann Lee to win by KO/TKO in Rounds 1 or 2", "Bo Roe to win by Submission in Rounds 1,2 or 3", "Bo Roe to win by KO/TKO in Rounds 2,3 or 4")) + "]}]}")
    rows = documents.method_rounds(spark.createDataFrame([(1, "Ann Lee", "Bo Roe", doc)], "contest_id int, a_name string, b_name string, doc string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["market"], []).append((r["side"], r["method"], tuple(r["rounds"])))
    assert sorted(by["method_round"]) == [("A", "KO", (1,)), ("A", "SUB", (2,)), ("B", "KO", (3,))]
    assert len(by["method_round_neutral"]) == 2
    assert sorted(by["method_round_range"]) == [("A", "KO", (1, 2)), ("B", "KO", (2, 3, 4)), ("B", "SUB", (1, 2, 3))]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bets_are_graded_where_they_lie(spark):
    """Bets dealt by contest are not dealt out again by market, and totals count for every row that they have."""
    key = lambda m, line: [f"TOTAL|{m}|over|{line}"]
    bets = spark.createDataFrame([(1, key("x", 3)), (1, key("y", 3)), (1, ["A|KO|1"]), (2, key("x", 3)), (None, key("x", 3)), (3, [])], "contest_id long, outcome_keys array<string>")
    results = spark.createDataFrame([(1, "A|KO|1", "A")], "contest_id long, actual_key string, actual_side string")
    totals = spark.createDataFrame([(1, "x", 5.0), (1, "x", 2.0), (2, "y", 9.0), (1, None, 9.0), (None, "x", 9.0)], "contest_id long, market string, actual double")
    got = grade.grade(bets, results, totals)
    assert sorted(map(str, ((r["contest_id"], *r["outcome_keys"], r["result"]) for r in got.collect()))) == sorted(map(str, [
        (1, "TOTAL|x|over|3", "won"), (1, "TOTAL|x|over|3", "lost"), (1, "TOTAL|y|over|3", None), (1, "A|KO|1", "won"),
        (2, "TOTAL|x|over|3", None), (None, "TOTAL|x|over|3", None), (3, None)]))
    assert "_target" not in "".join(x for x in plan_text(got).splitlines() if "hashpartitioning" in x)


def test_pricing_code_is_short_enough_to_be_compiled(spark):
    """The virtual machine only interprets methods of more than 8,000 bytes."""
    predictions = spark.createDataFrame([], "contest_id long, p double, is_long int, p_finish double, p_decision double, a_name string, b_name string, "
                                        + ", ".join(f"p{s}_{m} double" for s in "ab" for m in ("ko", "sub", "dec")) + ", " + ", ".join(f"p_r{i} double" for i in range(1, 6)))
    quotes = spark.createDataFrame([], "contest_id long, market string, selection string, side string, method string, rounds array<int>, price double")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        codes = pricing.price(quotes, predictions)._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())]
    assert sizes and all(0 < n < 8_000 for n in sizes)


def test_round_shares_are_plain_sums(spark):
    """Shares of the scheduled rounds, without functions that Spark interprets element by element."""
    rows = spark.createDataFrame([(1, 0, 0.6, 0.3, 0.1, 0.2, 0.4, 0.4), (2, 1, 0.5, 0.2, None, 0.1, -0.3, 0.2), (3, None, 0.6, 0.1, 0.1, 0.0, 0.4, 0.4), (4, 1, 0.0, 0.2, 0.2, 0.2, 0.2, 0.2), (5, 0, None, 0.2, 0.2, 0.2, 0.2, 0.2), (6, 0, 0.5, 0.0, 0.0, 0.0, 0.9, 0.0)],
                                 "contest_id long, is_long int, p_finish double, " + ", ".join(f"p_r{i} double" for i in range(1, 6)))
    made = pricing.with_round_shares(rows, "c")
    got = {r["contest_id"]: r["c"] for r in made.collect()}
    zero = [0.0] * 5
    want = {1: [0.3 / 0.6, 0.1 / 0.6, 0.2 / 0.6, 0, 0], 2: [0.2 / 0.5, 0, 0.1 / 0.5, 0, 0.2 / 0.5], 3: [0.5, 0.5, 0, 0, 0], 4: zero, 5: zero, 6: zero}
    assert made.columns == [*rows.columns, "c"] and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert "lambda" not in plan_text(made)


def test_contests_of_a_query_are_made_once(spark):
    """Views read the stored contests; their rows are those of the view's text."""
    from workload import views
    from workload.registry import Tables

    source = "/root/testdata/sf0.001"
    t = Tables(spark, source)
    for name in ("contest", "totals", "periods", "oof"):
        got = getattr(t, name)
        assert "lineitem" not in "".join(got.inputFiles())
        want = spark.sql(views.spark_text(name, source))
        assert got.dtypes == want.dtypes and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert any("supplier" in f for f in t.entity.inputFiles())
