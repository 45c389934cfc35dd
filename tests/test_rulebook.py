"""Keyword rules held as rows, against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from contestlake.operators import rulebook


@pytest.mark.parametrize("inline", [1_000, 2])
def test_rules_against_a_loop(spark, inline):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    rules = [(rng.randint(0, 9), some(rng.randint(1, 4)), f"L{i}") for i in range(12)] + [(-1, "", "never"), (-1, None, "never")]
    texts = [*[some(rng.randint(0, 7)) for _ in range(60)], "", None, "zzz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, words string")
    held = spark.createDataFrame(rules, "priority int, keyword string, label string")
    got = {r["k"]: r["label"] for r in rulebook.label(rows, F.col("words"), held, "label", "none", inline).collect()}
    assert got == {k: min(((p, l) for p, w, l in rules if w and t is not None and w in t), default=(0, "none"))[1] for k, t in enumerate(texts)}
    assert rulebook.label(rows, F.col("words"), held.limit(0), "label").filter("label IS NULL").count() == len(texts)
    assert rulebook.label(rows.limit(0), F.col("words"), held, "label", "none", inline).count() == 0
