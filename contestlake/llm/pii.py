"""Personal data: base patterns, labelers that vote on candidates, and a span classifier; SQL functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from contestlake.functions.plan import durable, once

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  Possessive quantifiers and the look-behind only spare useless attempts: a match
# starts where a run of its characters starts, or where the match before it ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9])(?<![0-9][\x20-]))[0-9](?:[\x20-]?[0-9]){15,}+",  # shorter runs fail whatever their digits
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates, by kind: spelled-out addresses, IPv6, cards of 15 digits, national numbers.
FURTHER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9-])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9-])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9.-])",
}
#: Gazetteers: how a genuine span of each kind starts or ends.
KNOWN = {
    "email": r"(?i)\.(com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|it|nl|ch|at|us|ca|au|jp|cn|in|br)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^(?i)(?:2[0-9a-f]{3}|3[0-9a-f]{3}|fe80|fd[0-9a-f]{2}):",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|62)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
#: Context: words shortly before a genuine span, and before a number of another kind.
NEAR = {
    "email": r"(?i)(mail|contact|write|reach|kontakt|correo|courriel)",
    "ip": r"(?i)(\bip\b|server|host|address|login|adresse|serveur)",
    "card": r"(?i)(card|visa|master|amex|credit|karte|carte|tarjeta)",
    "phone": r"(?i)(phone|\btel|call|mobile|fax|telefon|cell|whatsapp)",
}
OTHERWISE = r"(?i)(version|release|isbn|issn|order|invoice|article|section|chapter|serial)"
BEFORE = 32
LABELERS = ("pattern", "gazetteer", "context", "form", "edges")
#: A further candidate is added from this probability on.
ADD = 0.8
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _located(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Matches with their code point positions: each is found together with what lies between it and the match before
    it, so that the lengths add up to its place, whatever the pattern looks at around it."""
    seen = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    whole = F.lit(rf"(?s)\G(.*?)({pattern})")
    pieces = F.when(seen, F.arrays_zip(F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"), F.regexp_extract_all(text, whole, F.lit(2)).alias("value"))).otherwise(
        F.array().cast("array<struct<gap:string,value:string>>"))

    def step(acc, m):
        start = acc["at"] + F.length(m["gap"])
        return F.transform(F.array(start), lambda p: F.struct(
            (p + F.length(m["value"])).cast("int").alias("at"),
            F.array_append(acc["out"], F.struct(p.cast("int").alias("start"), (p + F.length(m["value"])).cast("int").alias("end"), m["value"].alias("value"))).alias("out")))[0]

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    """What a base match must meet beyond its pattern."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _votes(kind: str, text: Column, s: Column, base: bool) -> Column:
    """One vote of each labeler: 1 for personal data, -1 against, 0 none."""
    value = s["value"]
    before = F.substr(text, F.greatest(F.lit(1), s["start"] - BEFORE + 1), F.least(s["start"], F.lit(BEFORE)))
    form = {
        "email": F.when(value.rlike(r"^[^@(\[]*[A-Za-z]"), 1).otherwise(-1),
        "ip": F.when(value.rlike(r"(?:^|\.)0[0-9]"), -1).otherwise(1),
        "card": F.when(value.rlike(r"^(?:[0-9]+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4,7})$"), 1).otherwise(-1),
        "phone": F.when(F.length(_digits(value)).between(10, 13), 1).otherwise(0),
    }[kind]
    around = F.concat(F.substr(text, s["start"], F.when(s["start"] > 0, 1).otherwise(0)), F.lit(" "), F.substr(text, s["end"] + 1, F.lit(1)))
    return F.array(
        F.lit(1 if base else -1),
        F.when(value.rlike(KNOWN[kind]), 1).otherwise(-1),
        F.when(before.rlike(OTHERWISE), -1).when(before.rlike(NEAR[kind]), 1).otherwise(0),
        form, F.when(around.rlike(r"[\p{L}0-9@]"), -1).otherwise(1))


def candidates(text: Column) -> Column:
    """Every base span and further candidate of a text: kind (from 0), start, end, base, votes, length class."""
    text = F.coalesce(text, F.lit(""))
    gate = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    parts = []
    for k, kind in enumerate(KINDS):
        for base, pattern, when in ((True, BASE[kind], gate.get(kind)), (False, FURTHER[kind], None)):
            spans = _located(text, pattern, when)
            parts.append(_voted(k, text, spans, base))
    return F.concat(*parts)


def _voted(k: int, text: Column, spans: Column, base: bool) -> Column:
    kind = KINDS[k]
    if base:
        spans = F.filter(spans, lambda s: _passes(kind, s["value"]))
    elif kind == "card":
        spans = F.filter(spans, lambda s: F.call_function("luhn_check", _digits(s["value"])))
    return F.transform(spans, lambda s: F.struct(
        F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"),
        _votes(kind, text, s, base).alias("votes"), F.least(F.lit(3), F.floor(F.length(s["value"]) / 12)).cast("int").alias("size")))


def located(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and ``found``: the candidates of each whole text."""
    return once(docs, {"found": candidates(F.col(text))}, keep)


# ---- reliabilities and the classifier, fitted on counts of vote patterns ----

def estimate(patterns: list[tuple[tuple, float]], rounds: int = 50) -> list[float]:
    """Probability of personal data for each (votes, count), by expectation-maximisation over the labelers'
    reliabilities.  A labeler's votes are taken as independent given the truth; at the start a vote is right
    four times out of five, which also is the prior of the reliabilities."""
    right = {1: (0.7, 0.1), 0: (0.2, 0.3), -1: (0.1, 0.6)}
    rate = [{v: list(right[v]) for v in right} for _ in LABELERS]
    share, out = 0.5, []
    for _ in range(rounds):
        out = []
        for votes, _n in patterns:
            yes, no = math.log(share), math.log(1 - share)
            for j, v in enumerate(votes):
                yes, no = yes + math.log(rate[j][v][0]), no + math.log(rate[j][v][1])
            out.append(1 / (1 + math.exp(max(-60.0, min(60.0, no - yes)))))
        total = sum(n for _, n in patterns)
        ones = sum(p * n for p, (_, n) in zip(out, patterns))
        share = (ones + 5) / (total + 10)
        for j in range(len(LABELERS)):
            for v in right:
                yes = sum(p * n for p, (votes, n) in zip(out, patterns) if votes[j] == v)
                no = sum((1 - p) * n for p, (votes, n) in zip(out, patterns) if votes[j] == v)
                rate[j][v] = [(yes + 10 * right[v][0]) / (ones + 10), (no + 10 * right[v][1]) / (total - ones + 10)]
    return out


@dataclass
class Model:
    """Weights of a logistic regression: intercept, kind, vote by labeler, length class."""

    intercept: float
    kind: list[float]
    vote: list[list[float]]
    size: list[float]

    def probability(self, s: Column) -> Column:
        total = F.lit(self.intercept) + F.element_at(F.array(*map(F.lit, self.kind)), s["kind"] + 1) + F.element_at(F.array(*map(F.lit, self.size)), s["size"] + 1)
        for j, weights in enumerate(self.vote):
            total = total + F.element_at(F.array(*map(F.lit, weights)), F.get(s["votes"], F.lit(j)) + 2)
        return 1 / (1 + F.exp(-total))


def fit(found: DataFrame) -> Model:
    """Count the vote patterns of all candidates, estimate which are personal data, and fit the classifier to that.

    The patterns that reach the driver are at most kinds x 3^labelers x length classes, whatever the data.
    """
    flat = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.size").agg(F.count("*").alias("n"))
    rows = sorted((r["kind"], tuple(r["votes"]), r["size"], float(r["n"])) for r in flat.collect())
    data = []
    for kind in range(len(KINDS)):
        mine = [r for r in rows if r[0] == kind]
        # a thousand candidates weigh as much as any number, so that rare patterns keep a say
        scale = min(1.0, 1000 / max(1.0, sum(r[3] for r in mine)))
        chances = estimate([(r[1], r[3] * scale) for r in mine])
        data += [(r, p, r[3] * scale) for r, p in zip(mine, chances)]
    model = Model(0.0, [0.0] * len(KINDS), [[0.0] * 3 for _ in LABELERS], [0.0] * 4)
    total = sum(n for *_, n in data) or 1.0
    for step in range(300):
        g0, gk, gv, gs = 0.0, [0.0] * len(KINDS), [[0.0] * 3 for _ in LABELERS], [0.0] * 4
        for (kind, votes, size, _), p, n in data:
            z = model.intercept + model.kind[kind] + model.size[size] + sum(model.vote[j][v + 1] for j, v in enumerate(votes))
            d = n / total * (1 / (1 + math.exp(max(-60.0, min(60.0, -z)))) - p)
            g0, gk[kind], gs[size] = g0 + d, gk[kind] + d, gs[size] + d
            for j, v in enumerate(votes):
                gv[j][v + 1] += d
        rate, keep = 2.0, 1 - 2e-3
        model = Model(model.intercept - rate * g0, [keep * a - rate * b for a, b in zip(model.kind, gk)],
                      [[keep * a - rate * b for a, b in zip(x, y)] for x, y in zip(model.vote, gv)], [keep * a - rate * b for a, b in zip(model.size, gs)])
    return model


def chosen(found: Column, model: Model, add: float = ADD) -> Column:
    """Base spans, and further candidates that the classifier accepts and that touch no base span; by kind, then start."""
    base = F.filter(found, lambda s: s["base"])
    more = F.filter(found, lambda s: ~s["base"] & (model.probability(s) >= add) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.array_sort(F.transform(F.concat(base, more), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans.

    A null text counts as empty and has no span; rows without id and repeated rows are read like any other.
    """
    found = durable(located(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"]))
    model = fit(found)
    base = F.array_sort(F.transform(F.filter("found", lambda s: s["base"]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))

    def count(k):
        return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == k))).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(chosen(F.col("found"), model)).alias("spans"))


def masked(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows with each span replaced by its kind in angle brackets, with the columns of ``docs``.

    Overlapping spans are replaced together, under the kind of the first.  A column ``length``, if there,
    becomes the new number of characters of the texts that changed.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("text"))
    model = fit(located(rows.select("text"), "text", []))
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    spans = F.array_sort(F.transform(chosen(F.col("found"), model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc, s):
        gap = F.substr("text", acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.element_at(marks, s["kind"] + 1))).otherwise(acc["out"]).alias("out"))

    new = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.length("text"))))
    read = once(located(rows, "text", ["row", "text"]), {"spans": spans}, ["row", "text"])
    read = read.withColumn("changed", F.size("spans") > 0).withColumn("new", F.when(F.col("changed"), new).otherwise(F.col("text")))
    kinds = dict(docs.dtypes)
    out = [F.col("new").alias(c) if c == text else
           F.when(F.col("changed"), F.length("new").cast(kinds[c])).otherwise(F.col(f"row.`{c}`")).alias(c) if c == length else F.col(f"row.`{c}`").alias(c) for c in names]
    return read.select(*out)
