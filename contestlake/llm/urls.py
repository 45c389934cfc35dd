"""URL filter: rules by host and path, and for the rest a path-template tree with labelled purity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from contestlake.functions.plan import durable

#: The rules of the registered query, as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@dataclass(frozen=True)
class Settings:
    """Branches of a node with ``support`` labelled pages are put in order of their share of good ones, in bins
    of ``step``, and neighbours are merged while a test of two proportions does not tell them apart by ``z``
    standard errors.  A template is rejected if its smoothed purity is below ``purity``; ``prior`` pages of the
    host's share are added to it."""

    support: int = 20
    z: float = 3.0
    step: float = 0.005
    prior: float = 10.0
    purity: float = 0.5


def _behind(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """From behind the first :// up to /, ?, # or the end, with A to Z in lower case; else empty."""
    name = F.regexp_extract(_behind(url), r"^([^/?#]*)", 1)
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_behind(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as (rule, verdict), or null.  The rules are a short list of the caller's."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """Segments with their variable parts as wildcards: numbers {n}, long hexadecimal runs {x}."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-fA-F]{8}[0-9a-fA-F-]*", "{x}"), "[0-9]+", "{n}"))


def _tell_apart(a: Column, b: Column, z: float) -> Column:
    """Whether the good shares of two merged branches differ by more than ``z`` standard errors of their common share."""
    together = F.least(F.greatest((a["good"] + b["good"]) / (a["seen"] + b["seen"]), F.lit(0.02)), F.lit(0.98))
    error = F.sqrt(together * (1 - together) * (1 / a["seen"] + 1 / b["seen"]))
    return F.abs(a["good"] / a["seen"] - b["good"] / b["seen"]) > z * error


def merged(bins: Column, z: float) -> Column:
    """Bins of branches in order of their shares, as groups of neighbours that no test tells apart."""
    kind = "array<struct<top:int,seen:bigint,good:bigint,first:string,members:bigint>>"

    def take(groups, new):
        last = F.try_element_at(groups, F.lit(-1))
        apart = last.isNull() | _tell_apart(last, new, z)
        joined = F.struct(new["top"].alias("top"), (last["seen"] + new["seen"]).alias("seen"), (last["good"] + new["good"]).alias("good"),
                          F.least(last["first"], new["first"]).alias("first"), (last["members"] + new["members"]).alias("members"))
        before = F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0)))
        return F.when(apart, F.concat(groups, F.array(new))).otherwise(F.concat(before, F.array(joined))).cast(kind)

    return F.aggregate(bins.cast(kind), F.array().cast(kind), take)


def grow(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """host, shape, template, purity: the template of each distinct path shape of each host.

    ``pages`` has host, path and label (1 good, 0 bad, null unknown).  Pages are totalled by host and shape
    before anything else, so a host with a third of all pages is as many rows as it has shapes.  Then level
    by level, from the root, similar branches of a node are merged.  The group with the most labelled pages
    (ties: the lower share) and all branches of too few labelled pages are the node's wildcard ``*``; another
    group of several branches is named ``{x|*}`` by its smallest name.  A group's state is one row per bin.
    Levels end where no node holds enough labelled pages; what lies deeper is wildcards.
    """
    shapes = pages.select("host", segments(F.col("path")).alias("shape"), "label").groupBy("host", "shape").agg(
        F.count("label").alias("seen"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("good"))
    state = durable(shapes.withColumn("node", F.lit("")))
    level = 0
    while True:
        rows = state.withColumn("child", F.when(F.size("shape") > level, F.get("shape", F.lit(level))))
        children = durable(rows.filter("child IS NOT NULL").groupBy("host", "node", "child").agg(F.sum("seen").alias("seen"), F.sum("good").alias("good")))
        largest = children.groupBy("host", "node").agg(F.sum("seen").alias("seen")).agg(F.max("seen")).first()[0]
        if (largest or 0) < settings.support:
            break
        known = children.filter(F.col("seen") >= max(settings.support, 1)).withColumn("top", F.floor(F.col("good") / F.col("seen") / settings.step).cast("int"))
        bins = known.groupBy("host", "node", "top").agg(F.sum("seen").alias("seen"), F.sum("good").alias("good"), F.min("child").alias("first"), F.count("*").alias("members"))
        listed = F.array_sort(F.collect_list(F.struct("top", "seen", "good", "first", "members")))
        nodes = bins.groupBy("host", "node").agg(merged(listed, settings.z).alias("groups"))
        usual = F.array_max(F.transform("groups", lambda g: F.struct(g["seen"], -g["top"]))).getItem("col2")
        nodes = nodes.select("host", "node", "groups", (-usual).alias("usual"))
        # only branches outside the wildcard are listed
        own = F.get(F.filter("groups", lambda g: g["top"] >= F.col("top")), F.lit(0))
        apart = known.select("host", "node", "child", "top").join(nodes, ["host", "node"]).withColumn("own", own).filter("own.top <> usual").select(
            "host", "node", "child", F.when(F.col("own.members") > 1, F.concat(F.lit("{"), "own.first", F.lit("|*}"))).otherwise(F.col("child")).alias("name"))
        state = durable(rows.join(apart, ["host", "node", "child"], "left").withColumn(
            "node", F.when(F.col("child").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), F.coalesce("name", F.lit("*"))))).drop("child", "name"))
        level += 1
    state = state.withColumn("node", F.concat("node", F.repeat(F.lit("/*"), F.greatest(F.size("shape") - level, F.lit(0)))))
    total = state.agg(F.sum("seen").alias("seen"), F.sum("good").alias("good")).first()
    overall = ((total["good"] or 0) + 1) / ((total["seen"] or 0) + 2)
    by_host = state.groupBy("host").agg(((F.sum("good") + settings.prior * overall) / (F.sum("seen") + settings.prior)).alias("host_share"))
    by_template = state.groupBy("host", "node").agg(F.sum("seen").alias("t_seen"), F.sum("good").alias("t_good"))
    judged = by_template.join(by_host, "host").withColumn("purity", (F.col("t_good") + settings.prior * F.col("host_share")) / (F.col("t_seen") + settings.prior))
    return durable(state.join(judged.select("host", "node", "purity"), ["host", "node"]).select("host", "shape", F.col("node").alias("template"), "purity"))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, settings: Settings = Settings(), page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row.

    ``labels`` has page_id and label (1 good, 0 bad); several labels of a page count as the worst.  Pages
    without a host have a template of the empty host.  Without any label nothing but the rules blocks.
    """
    read = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"))
    parsed = read.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    if labels is None:
        known = parsed.withColumn("label", F.lit(None).cast("int"))
    else:
        worst = labels.filter("page_id IS NOT NULL AND label IS NOT NULL").groupBy("page_id").agg(F.min("label").alias("label"))
        known = parsed.join(worst, "page_id", "left")
    tree = grow(known, settings)
    shaped = parsed.withColumns({"shape": segments(F.col("path")), "by_rule": rule_of(F.col("host"), F.col("path"), rules)})
    return shaped.join(tree, ["host", "shape"]).select(
        "page_id", "host", "path", F.col("by_rule.rule").alias("rule"),
        F.coalesce("by_rule.verdict", F.when(F.col("purity") < settings.purity, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def document_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, label: a page's document is named by the last number of its path; a toxic or poor one is bad."""
    path = path_of(F.col("url"))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1).alias("number")).filter("number <> ''")
    bad = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.col("quality"), F.lit(1)) * (1 - F.coalesce(F.col("toxic"), F.lit(0)))).alias("label"))
    bad = bad.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    return named.join(bad, named["number"].cast("long") == bad["doc_id"]).select("page_id", "label")
