"""Results found for stored predictions, against trying every pair; odd rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from contestlake.functions import similarity
from contestlake.operators import outcomes

DAY = dt.date(2020, 1, 1)
FOUGHT = "contest_id int, dt date, red_name string, blue_name string, red_id int, blue_id int, winner_id int, method string, round int"
STORED = "prediction_id int, dt date, a_name string, b_name string, p double, is_completed boolean, live_winner string, live_method string, live_round int, stored_correct int"


def name_score(a, b, both):
    parts = [similarity.token_set(a, b), similarity.partial(a.split()[-1], b)]
    return max(parts + ([similarity.partial(a, b.split()[-1])] if both else []))


def best(pred, fought, both):
    """The best contest by looking at each one, and whether side A is red in it."""
    seen = []
    for c in fought:
        if abs((c[1] - pred[1]).days) > 3:
            continue
        s = max(min(name_score(pred[2], c[i], both), name_score(pred[3], c[j], both)) for i, j in ((2, 3), (3, 2)))
        if s >= 70.0:
            seen.append((-s, -c[1].toordinal(), c[0], name_score(pred[2], c[2], both) >= name_score(pred[2], c[3], both)))
    return min(seen)[2:] if seen else None


def test_match_equals_trying_every_pair(spark):
    rng = random.Random(3)
    first, last = ["anna", "bo", "carl", "dina", "emil"], ["leeson", "lee", "roemer", "roe", "marx", "marxen"]
    people = [f"{a} {b}" for a in first for b in last]

    def noise(n):
        i = rng.randrange(len(n))
        return rng.choice([n, n[:i] + n[i + 1:], " ".join(reversed(n.split())), n + " jr"]).strip()

    fought = [(k, DAY + dt.timedelta(rng.randrange(12)), *rng.sample(people, 2)) for k in range(60)]
    preds = [(k, c[1] + dt.timedelta(rng.randrange(-4, 5)), *rng.sample([noise(c[2]), noise(c[3])], 2)) for k, c in enumerate(fought)]
    c = spark.createDataFrame(fought, "contest_id int, dt date, red_name string, blue_name string")
    p = spark.createDataFrame(preds, "prediction_id int, dt date, a_name string, b_name string")
    for scorer in ("set", "set_left"):
        got = {r["prediction_id"]: (r["contest_id"], r["a_is_red"]) for r in outcomes.match(p, c, scorer=scorer).collect()}
        assert got == {q[0]: m for q in preds if (m := best(q, fought, scorer == "set"))} and len(got) > 30


def test_decided_and_past(spark):
    fought = spark.createDataFrame([
        (1, DAY, "Ann Leeson", "Bo Roemer", 11, 12, 12, "KO/TKO", 2), (2, DAY, "Cy Marx", "Di Zorn", 13, 14, None, "NC", 1),
        (3, DAY, "Ed Quill", "Flo Wurst", 15, 16, 15, None, 3)], FOUGHT)
    open_ = (False, None, None, None, None)
    preds = [(1, DAY, "Bo Römer", "Ann Leesen", 0.7, *open_), (2, DAY, "Cy Marx", "Di Zorn", 0.7, *open_), (3, DAY, "Ed Quill", "Flo Wurst", 0.5, *open_),
             (4, DAY, "Zig Zag", "Hum Drum", 0.3, True, "hum drum", "SUB", 1, 1), (5, DAY, "Zig Zag", "Hum Drum", 0.501, True, "Zig Zag", "DEC", 3, 1),
             (6, DAY, None, "", 0.3, *open_), (7, DAY + dt.timedelta(4), "Ann Leeson", "Bo Roemer", 0.3, *open_), (8, None, "Ann Leeson", "Bo Roemer", 0.3, *open_),
             (1, DAY, "Bo Römer", "Ann Leesen", 0.7, *open_)]
    rows = spark.createDataFrame(preds, STORED)
    totals = spark.createDataFrame([(1, 12, 30, None), (1, 11, 20, 2)], "contest_id int, entity_id int, sig int, td int")
    won = outcomes.decided(rows, fought, F.lit("2020-02-01").cast("date")).collect()
    assert [(r["prediction_id"], r["contest_id"], r["a_won"], r["method"]) for r in won] == [(1, 1, 1, "KO/TKO")] * 2
    assert outcomes.decided(rows, fought, F.lit("2020-01-01").cast("date")).count() == 0
    out = outcomes.past(rows, fought, totals, ["sig", "td"])
    got = {r["prediction_id"]: (r["contest_id"], r["actual_side"], r["actual_key"], r["pred_correct"], r["a_sig"], r["a_td"], r["b_sig"]) for r in out.collect()}
    assert out.count() == len(preds)
    assert got == {1: (1, "A", "A|KO|2", 1, 30, 0, 20), 2: (2, None, None, None, None, None, None), 3: (3, "A", None, None, None, None, None),
                   4: (None, "B", "B|SUB|1", 1, None, None, None), 5: (None, "A", "A|DEC|DEC", None, None, None, None),
                   6: (None,) * 7, 7: (None,) * 7, 8: (None,) * 7}
    per_day = {r["dt"]: (r["n_correct"], r["n_resolved"], r["accuracy_pct"]) for r in outcomes.event_accuracy(out).collect()}
    assert per_day[DAY] == (3, 3, 100.0) and per_day[None] == (0, 0, None)
    none = outcomes.past(rows.limit(0), fought, totals, ["sig"])
    assert none.count() == 0 and outcomes.past(rows, fought.limit(0), totals, ["sig"]).filter("contest_id IS NOT NULL").count() == 0


def test_equal_names_need_no_approximate_search(spark, monkeypatch):
    """A score of 100 ends the search; a prediction without a contest near its day is not looked for."""
    day = dt.date(2020, 5, 2)
    contests = spark.createDataFrame([(7, day, "Ann Lee", "Bo Roe")], "contest_id bigint, dt date, red_name string, blue_name string")
    asked = spark.createDataFrame([(1, day, "Roe, Bo", "ann lee jr"), (2, dt.date(2021, 1, 1), "Cy Doe", "Di Poe")], "prediction_id bigint, dt date, a_name string, b_name string")
    used, search = [], outcomes.fuzzy.name_pairs
    monkeypatch.setattr(outcomes.fuzzy, "name_pairs", lambda l, r, threshold, scorer: used.append(threshold) or search(l, r, threshold, scorer))
    found = outcomes.match(asked, contests).select("prediction_id", "contest_id", "score", "a_is_red").collect()
    assert [tuple(r) for r in found] == [(1, 7, 100.0, False)] and used == [100.0]
