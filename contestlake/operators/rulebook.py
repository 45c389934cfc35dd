"""Ordered keyword rules held as rows (priority, keyword, label): the first rule whose keyword a text contains gives its label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rules that are put into the plan as one constant; more of them meet the texts in a join.
INLINE = 1_000


def table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules in order of their place in a list."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "priority long, keyword string, label string")


def _inline(text: Column, rules: list) -> Column:
    held = F.array(*[F.struct(F.lit(r["keyword"]).alias("keyword"), F.lit(r["label"]).alias("label")) for r in rules])
    return F.get(F.filter(held, lambda r: F.contains(text, r["keyword"])), F.lit(0))["label"]


def _joined(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Label of each distinct text: its pieces of the keywords' lengths meet the keywords by equality."""
    lengths = [r[0] for r in rules.select(F.length("keyword")).distinct().collect()]      # as many as the longest keyword has characters, at most
    sized = texts.withColumn("_n", F.explode(F.array(*[F.lit(n) for n in lengths]))).filter(F.length("_text") >= F.col("_n"))
    pieces = sized.select("_text", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("_text") - F.col("_n") + 1), lambda i: F.substr(F.col("_text"), i, F.col("_n"))))).alias("keyword"))
    return pieces.join(rules, "keyword").groupBy("_text").agg(F.min_by("label", F.struct("priority", "label")).alias("_label"))


def label(df: DataFrame, text: Column, rules: DataFrame, out: str, default: str | None = None, inline: int = INLINE) -> DataFrame:
    """``df`` with the label of the rule of least priority (ties: the smaller label) whose keyword ``text`` contains.

    A text that no rule fits, or null, gets ``default``.  Rules without a keyword or with an empty one fit nothing.
    Up to ``inline`` rules are a constant of the plan, so that rows are not moved; more are joined with the
    distinct texts.
    """
    rules = rules.select(F.col("priority").cast("long"), "keyword", "label").filter("keyword <> ''")
    held = rules.limit(inline + 1).collect()
    if not held:
        return df.withColumn(out, F.lit(default).cast("string"))
    if len(held) <= inline:
        held.sort(key=lambda r: (r["priority"] is not None, r["priority"] or 0, r["label"] or ""))
        return df.withColumn(out, F.coalesce(_inline(text, held), F.lit(default)))
    keyed = df.withColumn("_text", text)
    found = _joined(keyed.select("_text").filter("_text IS NOT NULL").distinct(), rules)
    return keyed.join(found, "_text", "left").withColumn(out, F.coalesce("_label", F.lit(default))).drop("_text", "_label")
