"""Interaction of filters: every order in which they can be applied, enumerated by a recursive query over mask cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from contestlake.functions.plan import durable
from contestlake.llm.common import SPACE

#: Fixed value: the failure conditions of the registered query, as (letter, what it looks at).
LETTERS = "ABCDE"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions that need nothing but the text itself."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > 3 * F.length(text), "D": text.rlike("[#$%&*|]")}


def masked(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """part, mask, good, toxic of every document; a bit of the mask is a filter that it fails, A the lowest.

    A null text counts as empty.  E: some smaller id has the same text; a row without id has no smaller one, and repeated
    rows do not fail by each other.  Several labels of an id count together.  Texts are told apart by SHA-256.
    """
    alone = failures(F.col(f"`{text}`"))
    bits = reduce(lambda a, b: a + b, [F.when(c, 1 << LETTERS.index(k)).otherwise(0) for k, c in alone.items()])
    slim = durable(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("part"), bits.alias("bits"),
                               F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("same")))
    # stored, so that the join's sides are both plain shuffles and a text with very many copies is split among tasks
    first = durable(slim.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("same", "first"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return slim.join(first, "same", "left").join(known, "doc_id", "left").select(
        "part", (F.col("bits") + F.when(copy, 16).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders(spark, letters: str = LETTERS) -> DataFrame:
    """prefix, step, letter, mask, kept, removed, redundant, only: what every mask cell meets at every step of every order.

    The recursion extends each prefix by each unused letter; every cell carries the bits applied so far, and each level
    emits what becomes of the cell at that step.  Its size depends on the number of filters alone.
    """
    listed = ", ".join(f"('{x}', {1 << k})" for k, x in enumerate(letters))
    return spark.sql(f"""
WITH RECURSIVE walk(prefix, step, letter, mask, applied, kept, removed, redundant, only) AS (
  SELECT '', 0, '', CAST(id AS INT), 0, 1, 0, 0, 0 FROM range({1 << len(letters)})
  UNION ALL
  SELECT concat(w.prefix, f.name), w.step + 1, f.name, w.mask, w.applied | f.bit, IF(w.mask & (w.applied | f.bit) = 0, 1, 0),
    IF(w.mask & f.bit <> 0 AND w.mask & w.applied = 0, 1, 0), IF(w.mask & f.bit <> 0 AND w.mask & w.applied <> 0, 1, 0), IF(w.mask = f.bit, 1, 0)
  FROM walk AS w JOIN (VALUES {listed}) AS f(name, bit) ON w.applied & f.bit = 0
)
SELECT prefix, step, letter, mask, kept, removed, redundant, only FROM walk WHERE step > 0""")


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and its counts for every order of the filters, zeros included.

    ``cells`` has part, mask, n and, of the same documents, good and toxic.  A step's counts depend on the letters up to it
    only, so they are summed by prefix and then joined to the orders that begin with it.
    """
    walk = durable(orders(cells.sparkSession, letters))
    n, good, toxic = (F.coalesce(F.col(c), F.lit(0)) for c in ("n", "good", "toxic"))
    # a part has at least one cell, so that zeros come from the sums
    sums = {"kept": n * F.col("kept"), "removed": n * F.col("removed"), "redundant": n * F.col("redundant"), "unique_fails": n * F.col("only"),
            "good_lost": good * F.col("removed"), "toxic_lost": toxic * F.col("removed")}
    every = cells.select("part").distinct().join(F.broadcast(walk.select("prefix", "step", "letter").distinct()), F.lit(True))
    met = cells.join(F.broadcast(walk), "mask").groupBy("part", "prefix").agg(*[F.sum(v).cast("long").alias(k) for k, v in sums.items()])
    steps = durable(every.join(met, ["part", "prefix"], "left").na.fill(0, list(sums)))
    # (k - step)! orders begin with a prefix
    following = F.factorial(F.lit(len(letters)) - F.col("step"))
    shares = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * following).cast("long").alias("shapley"))
    whole = walk.filter(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    whole = whole.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.lit(len(letters))), lambda k: F.substr("filter_order", F.lit(1), k))))
    return steps.join(F.broadcast(whole), "prefix").join(shares, ["part", "letter"]).select("part", "filter_order", "step", *sums, "shapley")


def interactions(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """``audit`` of the five filters over all documents, by language.  No document: no row."""
    cells = masked(docs, labels, text, doc_id, lang).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return audit(durable(cells))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), lows AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), bad AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
f AS (
  SELECT part, (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce(low < d.doc_id, false)::INT AS e,
    (good.doc_id IS NOT NULL)::INT AS good, (bad.doc_id IS NOT NULL)::INT AS toxic
  FROM d JOIN lows USING (t) LEFT JOIN good ON good.doc_id = d.doc_id LEFT JOIN bad ON bad.doc_id = d.doc_id
), m AS (SELECT part, a || '' || b || c || d || e AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS l(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM o, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
x AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails, fails[instr('ABCDE', letter)] = '1' AS hit,
    (before LIKE '%A%' AND fails[1] = '1') OR (before LIKE '%B%' AND fails[2] = '1') OR (before LIKE '%C%' AND fails[3] = '1') OR (before LIKE '%D%' AND fails[4] = '1') OR (before LIKE '%E%' AND fails[5] = '1') AS gone
  FROM m, s
), y AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN hit AND length(replace(fails, '0', '')) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM y"""
