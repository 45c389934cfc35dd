"""Closed-form expectations of prices, parsers and names."""

import pytest
from pyspark.sql import functions as F

from contestlake.functions import names, odds, parse, probability as prob, similarity


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def lit(x):
    return F.lit(x)


def test_prices(spark):
    a, b, d, k0, k1 = one(spark, odds.american_to_implied(lit(150.0)), odds.american_to_implied(lit(-200.0)), odds.american_to_decimal(lit(-200.0)),
                          odds.kelly_stake(lit(0.5), lit(1.333)), odds.kelly_stake(lit(0.5), lit(2.5)))
    assert a == pytest.approx(0.4) and b == pytest.approx(2 / 3) and d == pytest.approx(1.5)
    assert k0 == 0.0 and k1 > 0
    x, y = one(spark, odds.fair_share(lit(0.55), lit(0.5)), odds.fair_share(lit(0.5), lit(0.55)))
    assert x + y == pytest.approx(1.0)
    assert one(spark, odds.parse_american(lit("−150")), odds.parse_american(lit("n/a"))) == (-150.0, None)


def test_parsers(spark):
    assert one(spark, parse.clock_seconds(lit("2:34")), parse.clock_seconds(lit("--"))) == (154, 0)
    assert one(spark, parse.landed_of_attempted(lit("11 of 38")))[0] == (11, 38)
    assert one(spark, parse.landed_of_attempted(lit("x of 3")))[0] == (0, 0)
    assert one(spark, parse.feet_inches_cm(lit("5' 11\"")), parse.inches_cm(lit('72"')), parse.inches_cm(lit("--"))) == (180.3, 182.9, None)
    assert one(spark, parse.url_id(lit("http://x/y/abc//")), parse.pool_key(lit("UFC  Lightweight Title Bout"))) == ("abc", "lightweight")
    got = one(spark, *[parse.outcome_method(lit(m)) for m in ("Decision - Split", "M-DEC", "KO/TKO", "U-DEC", "Could Not Continue", "")])
    assert got == ("Decision (S)", "Decision (M)", "KO/TKO", "Decision (U)", "Could Not Continue", None)
    assert one(spark, parse.round_range(lit("2,3 or 4")), parse.round_range(lit("1 or 9"))) == ([2, 3, 4], [1])
    assert one(spark, parse.years_past(lit(30.0), lit(26)), parse.years_past(lit(None).cast("double"), lit(26)), parse.years_past(lit(20.0), lit(26))) == (4.0, 0.0, 0.0)
    assert one(spark, parse.any_date(lit("Jul 4, 1987")), parse.any_date(lit("--")))[1] is None


def test_names(spark):
    assert one(spark, names.name_key(lit("José  O'Neill-Ñu")), names.name_slug(lit("Zoë Kravitz")), names.surname_initial(lit("Ann Lee"))) == ("jose o neill nu", "zoe-kravitz", "lee|a")


def test_scores_and_bounds(spark):
    perfect, wrong, sd = one(spark, prob.log_loss(lit(1), lit(1.0)), prob.log_loss(lit(0), lit(1.0)), prob.local_sd(lit(0.0)))
    assert perfect < 1e-6 and wrong > 10 and sd == pytest.approx(0.1)
    rd, same = one(spark, prob.inflate_deviation(lit(340.0), lit(100_000)), prob.inflate_deviation(lit(80.0), lit(0)))
    assert rd == 350.0 and same == 80.0


def test_similarity():
    assert similarity.plain("abcd", "abcd") == 100.0
    assert similarity.plain("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert similarity.token_sort("lee ann", "ann lee") == 100.0
    assert similarity.token_set("ann lee", "ann lee junior") == 100.0
    assert similarity.partial("lee", "ann lee wins") == 100.0
    assert similarity.plain("", "") == 100.0 and similarity.token_set("", "a") == 0.0
