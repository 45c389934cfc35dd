"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contestlake.functions.plan import durable
from contestlake.llm.common import SPACE

#: Rows of a (source, bin); rows are ordered in one such bin of each source only.
BIN_ROWS = 5_000
#: Weights of the sources in the order of their code points, repeating; most copies of a document.
WEIGHTS, MOST = (1, 2, 3), 3
#: Sources up to which their table is sent to every task; a row of it has nine numbers and a name.
SENT = 5_000


def size_of(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Prose has words of 4 to 12 characters with their space; other texts are half as likely to be drawn."""
    per_word = F.length(text) / F.greatest(size, F.lit(1))
    return F.when(per_word.between(4, 12), 1.0).otherwise(0.5)


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) that depends on the id alone."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def drawn(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weight: Column | None = None) -> DataFrame:
    """Columns of the sample for each row: doc_id, source, size, key.  Small keys are drawn first."""
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"),
                      (F.lit(None).cast("double") if weight is None else weight.cast("double")).alias("given"))
    out = out.withColumn("size", size_of(F.col("text")))
    w = F.coalesce("given", quality_weight(F.coalesce("text", F.lit("")), F.col("size")))
    return out.select("doc_id", "source", "size", (-F.log(uniform(F.col("doc_id"))) / w).alias("key"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Word targets of the sources (columns source, source_size): they share all words by weight.

    A target stops at ``most`` times its source's size and the rest is shared again by weight, until
    no target is above.  Each round is one aggregation that returns two numbers.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, not per document
    each = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    table = durable(sources.withColumn("weight", each))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * most
    level = None
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * level
        got = table.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        now = (total - got["used"]) / got["free"] if got["free"] else 0.0
        if now == level:
            break
        level = now
        if not got["free"]:
            break
    return table.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level))).drop("weight")


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """How much of each source the mix takes: a row per source with whole epochs and where the last one stops.

    ``rows`` are those of ``drawn``.  The words left after whole epochs go to the documents of smallest key as
    long as a document's middle lies within them.  Sizes are summed by key bins first, so only the rows of
    the bin where a source stops are ordered; rows of equal key, id and size are taken together.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    info = targets(sources, weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    info = info.withColumn("epochs", whole.cast("long")).withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))).withColumn(
        "bins", F.greatest(F.lit(1), F.ceil(F.col("n") / BIN_ROWS)))
    info = durable(info)
    binned = rows.join(sized(info.select(F.col("source").alias("s"), "bins", "rest")), F.col("source").eqNullSafe(F.col("s"))).withColumn("bin", bin_of())
    sums = durable(binned.groupBy("s", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")))
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    stops = sums.withColumn("upto", upto).filter("upto >= rest").groupBy("s").agg(F.min(F.struct("bin", "upto", "words")).alias("at"))
    stops = durable(stops.select(F.col("s").alias("s2"), F.col("at.bin").alias("stop_bin"), (F.col("at.upto") - F.col("at.words")).alias("offset")))
    edge = binned.join(sized(stops), F.col("source").eqNullSafe(F.col("s2")) & (F.col("bin") == F.col("stop_bin")))
    place = Window.partitionBy("s").orderBy("key", "doc_id", "size")
    together = Window.partitionBy("s", "key", "doc_id", "size")
    edge = edge.withColumn("group", F.sum("size").over(together)).withColumn(
        "before", F.col("offset") + F.sum("size").over(place.rangeBetween(Window.unboundedPreceding, 0)) - F.col("group"))
    last = edge.filter((F.col("before") < F.col("rest")) & (2 * F.col("before") + F.col("group") <= 2 * F.col("rest"))).groupBy("s").agg(
        F.max(F.struct("key", "doc_id", "size")).alias("last"))
    return durable(info.join(stops, F.col("source").eqNullSafe(F.col("s2")), "left").join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("source_"), F.col("source_size").alias("source_size_"), F.col("target").alias("target_"), F.col("epochs").alias("epochs_"),
        F.col("bins").alias("bins_"), F.col("stop_bin").alias("stop_bin_"), F.col("last").alias("last_")))


def bin_of(bins: str = "bins") -> Column:
    """Key bin, ascending with the key and of like size for keys of like weights."""
    return F.least(F.col(bins) - 1, F.floor((1 - F.exp(-F.col("key"))) * F.col(bins)))


def sized(info: DataFrame) -> DataFrame:
    """Sent to every task if the sources are few; otherwise the join is left to shuffle."""
    return F.broadcast(info) if info.count() <= SENT else info


def copies(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Rows with columns doc_id, source, size, key, and how often the mix takes each (``copies``)."""
    joined = rows.join(sized(info), F.col("source").eqNullSafe(F.col("source_")))
    bin_ = bin_of("bins_")
    upto = F.struct("key", "doc_id", "size") <= F.col("last_")
    part = F.when(F.col("size") >= 0, (bin_ < F.col("stop_bin_")) | ((bin_ == F.col("stop_bin_")) & F.coalesce(upto, F.lit(False))))
    return joined.withColumn("copies", F.col("epochs_") + F.coalesce(part, F.lit(False)).cast("long"))


def mixture(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weight: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    A null source is a source of its own, the last; a null text has size 0 and is never short of words; a
    missing id draws like empty text; repeated rows are drawn together.  Reruns agree.
    """
    rows = durable(drawn(docs, text, doc_id, source, weight))
    return copies(rows, plan(rows)).select("doc_id", "size", F.col("source_size_").alias("source_size"), F.col("target_").alias("target"),
                                           (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weight: Column | None = None) -> DataFrame:
    """The rows that the mix takes, as often as it takes them, with the columns of ``docs``."""
    rows = durable(drawn(docs, text, doc_id, source, weight))
    names = docs.columns
    given = F.lit(None).cast("double") if weight is None else weight
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), given.cast("double").alias("given"))
    keyed = keyed.select("row", F.col(f"row.`{doc_id}`").cast("long").alias("doc_id"), F.col(f"row.`{source}`").cast("string").alias("source"), "given",
                         size_of(F.col(f"row.`{text}`")).alias("size"))
    w = F.coalesce("given", quality_weight(F.coalesce(F.col(f"row.`{text}`"), F.lit("")), F.col("size")))
    keyed = keyed.withColumn("key", -F.log(uniform(F.col("doc_id"))) / w)
    taken = copies(keyed, plan(rows)).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


#: The same rows in SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         length(coalesce(text, '')) AS chars,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5E0) / 4503599627370496E0 AS u FROM documents),
k AS (SELECT *, -ln(u) / CASE WHEN CAST(chars AS DOUBLE) / greatest(size, 1) BETWEEN 4 AND 12 THEN 1E0 ELSE 0.5E0 END AS key FROM d),
s AS (SELECT source, sum(size) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM k GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
        coalesce(sum(3 * source_size) OVER o, 0) AS used, (sum(w) OVER ()) - coalesce(sum(w) OVER o, 0) AS free
      FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min((total - used) / CAST(free AS DOUBLE), used) FILTER (cap > w * ((total - used) / CAST(free AS DOUBLE))), 0E0) AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN cap <= w * level THEN CAST(cap AS DOUBLE) ELSE w * level END AS target FROM c, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, greatest(0E0, e.target - e.epochs * e.source_size) AS rest,
        sum(k.size) OVER p AS upto, sum(k.size) OVER g AS grp
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
      WINDOW p AS (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), g AS (PARTITION BY k.source, k.key, k.doc_id, k.size))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (epochs + CASE WHEN upto - grp < rest AND 2 * (upto - grp) + grp <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
