"""Quotes are read once on their way from label to edge."""

from pyspark.sql import functions as F

from contestlake.functions import names
from contestlake.operators import sidemarkets

LABELS = ["Over 2½ rounds", "Draw", "Ann Lee wins by TKO/KO", "Any other result", "Bo Roe wins by submission", "Not Bo Roe inside distance", "Any other result"]
MARKETS = ["total_rounds_2.5", None, "r_method_KO_TKO", "r_method_KO_TKO", "b_method_SUB", "b_inside_distance", "b_inside_distance"]


def quotes(spark, start=1):
    rows = [(c, start + i, label, "Ann Lee", "Bo Roe", 150.0) for c in (1, 2) for i, label in enumerate(LABELS)]
    return spark.createDataFrame(rows, "contest_id bigint, seq bigint, label string, red_name string, blue_name string, american double")


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_quotes_of_one_run_are_classified_without_a_join(spark):
    got = sidemarkets.classify(quotes(spark))
    assert joins(got) == 0
    assert [r["market"] for r in got.filter("contest_id = 2").orderBy("seq").collect()] == MARKETS
    # the same rows across the end of a run, and far beyond the first one
    for start in (-3, 996, 5000):
        assert [r["market"] for r in sidemarkets.classify(quotes(spark, start)).filter("contest_id = 2").orderBy("seq").collect()] == MARKETS


def test_edges_price_every_quote_once(spark):
    rows = [(1, 1, "distance", 150.0, 0.5, 1), (1, 2, "distance", -170.0, 0.5, 0), (1, 3, "ends_round_1", 300.0, 0.3, 1), (2, 1, "distance", 120.0, None, 1), (2, 2, "distance", -120.0, 0.6, 0)]
    got = sidemarkets.edges(spark.createDataFrame(rows, "contest_id bigint, seq bigint, market string, american double, our_prob double, won int"))
    assert joins(got) == 0
    fair = {(r["contest_id"], r["seq"]): (r["fair"], r["single"]) for r in got.collect()}
    a, b, c, d = 100 / 250, 170 / 270, 100 / 220, 120 / 220
    want = {(1, 1): (a / (a + b), 0), (1, 2): (b / (a + b), 0), (1, 3): (None, 1), (2, 2): (d / (c + d), 0)}
    assert {k: (v and round(v, 9), s) for k, (v, s) in fair.items()} == {k: (v and round(v, 9), s) for k, (v, s) in want.items()}


def test_last_token_of_plain_names_equals_that_of_the_key(spark):
    texts = ["Ann Lee", "  ANN  lee 3 ", "", " ", "solo", "Ann Lee\n", "José Ánchez", "O'Neil-Smith Jr.", "Ørn Bø", None]
    rows = spark.createDataFrame([(x,) for x in texts], "n string").select(
        names.last_token(F.col("n")).alias("got"), F.element_at(F.split(names.name_key(F.col("n")), " "), -1).alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
