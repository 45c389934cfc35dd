"""Stored documents of both schema versions become the same bets; odd documents are told apart."""

import json

import pytest

from contestlake.plans import archive

PROBS = {"pa_ko": 0.3, "pa_sub": 0.1, "pa_dec": 0.2, "pb_ko": 0.2, "pb_sub": 0.1, "pb_dec": 0.1, "p_finish": 0.7, "p_decision": 0.3,
         "p_r1": 0.3, "p_r2": 0.2, "p_r3": 0.2, "p_r4": 0.0, "p_r5": 0.0}
BUCKETS = "market_class string, edge_lo double, edge_hi double, roi_pct double, n bigint"


def top(contest, **more):
    return {"contest_id": contest, "event_date": "2020-01-01", "event_name": "Card", "a_name": "Ann Lee", "b_name": "Bo Roe", "is_long": 0, "p": 0.6, **more}


def old(contest, **more):
    odds = {"moneyline": {"A": 2.0, "B": 3.0}, "method": {"Ann Lee by KO/TKO": 5.0}}
    return top(contest, props=PROBS, odds=odds, bets=[{"market": "moneyline", "selection": "A", "ev_pct": 99.0}], **more)


def new(contest, **more):
    quote = lambda m, s, side, price: {"market": m, "selection": s, "side": side, "method": None, "rounds": None, "price": price}
    return top(contest, **PROBS, quotes=[quote("moneyline", "A", "A", 2.0), quote("moneyline", "B", "B", 3.0), quote("method", "Ann Lee by KO/TKO", None, 5.0)], **more)


def nested(spark, docs):
    rows = spark.createDataFrame([(d if d is None or isinstance(d, str) else json.dumps(d), k) for d, k in docs], "doc string, stored_at int")
    return rows, archive.events(rows, spark.createDataFrame([("method", -1.0, 1.0, 20.0, 50)], BUCKETS)).collect()


def test_versions_agree(spark):
    _, pages = nested(spark, [(old(1), 1), (new(2), 1)])
    one, two = pages[0]["contests"]
    assert (pages[0]["event_date"], pages[0]["event_name"], pages[0]["n"]) == ("2020-01-01", "Card", 2)
    assert one["bets"] == two["bets"] and len(one["bets"]) == 3
    best = one["bets"][0]
    assert (best["market"], best["outcome_keys"], best["is_value"]) == ("method", [f"A|KO|{r}" for r in range(1, 6)], 1) and best["ev_pct"] == pytest.approx(50.0)


def test_odd_documents(spark):
    docs = [(old(1, p_extra=3), 1), (new(1, a_extra="x"), 2), ({**top(1), "p": 0.9}, 0), ("{cut", 5), (None, 5), ("", 5), ({"event_name": "no id"}, 5),
            ({"contest_id": 3}, 1), ({**new(4), "quotes": []}, 1), ({**old(5), "event_name": None, "event_date": None}, 1), (old(6), 1), (old(6), 1)]
    rows, pages = nested(spark, docs)
    got = {(p["event_date"], p["event_name"], c["contest_id"]): len(c["bets"]) for p in pages for c in p["contests"]}
    assert got == {("2020-01-01", "Card", 1): 3, ("", "Unknown Event", 3): 0, ("2020-01-01", "Card", 4): 0, ("", "Unknown Event", 5): 3, ("2020-01-01", "Card", 6): 3}
    good, bad = archive.read(rows)
    assert good.count() == 5 and sorted(r["doc"] or "" for r in bad.collect()) == ["", "", json.dumps({"event_name": "no id"}), "{cut"]
    assert nested(spark, [])[1] == []


def test_pages(spark):
    rows = spark.createDataFrame([(json.dumps(new(k)), 1) for k in range(7)], "doc string, stored_at int")
    pages = archive.events(rows, spark.createDataFrame([], BUCKETS), size=3).collect()
    assert sum(p["n"] for p in pages) == 7 and max(p["n"] for p in pages) <= 3
