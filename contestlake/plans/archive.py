"""Stored prediction documents of every schema version, priced again and grouped into events.

Old documents hold flat price maps and class probabilities under ``props``, and bets without outcome keys; later
ones hold quotes as rows and the probabilities on top.  One reading schema names the fields of both, so a single
parse gives one row type; the stored bets are not read, because they are made anew from prices and probabilities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contestlake.functions.plan import durable, once
from contestlake.operators import cards, pricing, upsert

PROBS = ["pa_ko", "pa_sub", "pa_dec", "pb_ko", "pb_sub", "pb_dec", "p_finish", "p_decision", *[f"p_r{i}" for i in range(1, 6)]]
_FIELDS = ", ".join(f"{c}: double" for c in PROBS)
DOCUMENT = (f"contest_id: bigint, event_date: string, event_name: string, a_name: string, b_name: string, is_long: int, p: double, {_FIELDS}, "
            f"props: struct<{_FIELDS}>, odds: map<string, map<string, double>>, "
            "quotes: array<struct<market: string, selection: string, side: string, method: string, rounds: array<int>, price: double>>")


def read(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest readable document of each contest as one row type, and the documents that cannot be read.

    ``docs`` needs doc (JSON text) and stored_at; equal times are told apart by the text.  A contest without an
    event name belongs to 'Unknown Event', one without a day to the day ''.
    """
    parsed = once(docs.select("doc", "stored_at"), {"d": F.from_json("doc", f"struct<{DOCUMENT}>")}, keep=["doc", "stored_at"])
    bad = F.col("d.contest_id").isNull()
    rows = upsert.newest(parsed.filter(~bad).withColumn("contest_id", F.col("d.contest_id")), ["contest_id"], [F.col("stored_at").desc(), F.col("doc").desc()])
    flat = rows.select(
        "contest_id", F.coalesce("d.event_date", F.lit("")).alias("event_date"), F.coalesce("d.event_name", F.lit("Unknown Event")).alias("event_name"),
        "d.a_name", "d.b_name", "d.is_long", "d.p", *[F.coalesce(f"d.{c}", f"d.props.{c}").alias(c) for c in PROBS], "d.odds", "d.quotes")
    return flat, parsed.filter(bad).select("doc", "stored_at")


def quotes(rows: DataFrame) -> DataFrame:
    """Quotes of both versions as rows; where a document has quote rows, its price maps are not read.

    An entry of an old map has no side of its own: moneyline names it in the selection.
    """
    none = F.lit(None)

    def entries(market: Column, prices: Column) -> Column:
        return F.transform(F.map_entries(prices), lambda e: F.struct(
            market.alias("market"), e["key"].alias("selection"), F.when((market == "moneyline") & e["key"].isin("A", "B"), e["key"]).alias("side"),
            none.cast("string").alias("method"), none.cast("array<int>").alias("rounds"), e["value"].alias("price")))

    old = F.flatten(F.transform(F.map_entries("odds"), lambda m: entries(m["key"], m["value"])))
    return rows.select("contest_id", F.inline(F.coalesce("quotes", old)))


def bets(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Bets of the stored prices in today's form: valued, gated, one per outcome set."""
    return pricing.dedup(pricing.gate(pricing.value(pricing.price(quotes(rows), rows)), buckets))


def events(docs: DataFrame, buckets: DataFrame, size: int = 500) -> DataFrame:
    """Events with their contests and recomputed bets, best first, in pages of at most ``size`` contests.

    Contests without a bet stay, with an empty list.  A contest has one bet per market and selection at most, so
    its list is bounded by the quotes of one document.
    """
    rows = durable(read(docs)[0])       # quotes, predictions and events read it
    fields = ["market", "selection", "our_prob", "price", "ev_pct", "kelly_pct", "outcome_keys", "is_value"]
    made = bets(rows, buckets).groupBy("contest_id").agg(F.sort_array(F.collect_list(F.struct("ev_pct", *[f for f in fields if f != "ev_pct"])), asc=False).alias("bets"))
    full = rows.join(made, "contest_id", "left").withColumns({
        "bets": F.coalesce("bets", F.array().cast(made.schema["bets"].dataType)), "event": F.struct("event_date", "event_name")})
    return cards.nested(full, "event", ["a_name", "b_name", "p", "bets"], size).select("event.*", "page", "n", "contests")
