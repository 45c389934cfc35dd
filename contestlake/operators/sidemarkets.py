"""Side-market quotes: reading labels, model probability, graded outcome, vig-free edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contestlake.functions import names, odds
from contestlake.functions.plan import once
from contestlake.operators import order

# fixed values: method words of the quote labels
METHODS = {"tko/ko": "KO_TKO", "submission": "SUB", "decision": "DEC", "unanimous decision": "UD", "split/majority decision": "SMD"}
ROUND_COLS = ["r1", "r2", "r3", "r4", "r5"]


def _grab(text: str, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def classify(quotes: DataFrame) -> DataFrame:
    """(contest_id, seq, label, red_name, blue_name) -> market and side; unknown labels get NULLs.

    'Any other result' is the opposite of the contest's previous known label.
    """
    q = once(quotes, {"_l": F.lower(F.trim("label"))})
    named = F.col("_l").contains(" wins ") | F.col("_l").endswith(" inside distance")
    q = once(q, {f"_{c}": F.when(named, names.last_token(F.col(f"{c}_name"))) for c in ("red", "blue")})

    def who(part: Column) -> Column:
        return F.when((F.col("_red") != "") & part.contains(F.col("_red")), "r").when((F.col("_blue") != "") & part.contains(F.col("_blue")), "b")

    l = F.col("_l")
    last = F.substring_index(l, " ", -1)
    digit = F.when(last.rlike(r"^\d$"), last)
    words = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    line = F.replace(_grab("_l", r"^(over|under)\s+([\d½]+)\s+rounds?$", 2), F.lit("½"), F.lit(".5"))
    is_total = l.startswith("over ") | l.startswith("under ")
    # plain string tests first: most labels never meet a pattern
    market = (
        F.when(l.isin("fight goes to decision", "fight doesn't go to decision"), "distance")
        .when(is_total, F.concat(F.lit("total_rounds_"), line))
        .when(l.startswith("fight starts round ") | l.startswith("fight won't start round "), F.concat(F.lit("starts_round_"), digit))
        .when(l.startswith("fight ends in round ") | l.startswith("fight doesn't end in round "), F.concat(F.lit("ends_round_"), digit))
        .when(l.contains(" wins by "), F.concat(who(F.substring_index(l, " wins by ", 1)), F.lit("_method_"), words[F.substring_index(l, " wins by ", -1)]))
        .when(l.endswith(" wins inside distance") | (l.startswith("not ") & l.endswith(" inside distance")), F.concat(who(l), F.lit("_inside_distance")))
        .when(l.contains(" wins in round "), F.concat(who(F.substring_index(l, " wins in round ", 1)), F.lit("_wins_round_"), digit)))
    negated = l.startswith("not ") | l.contains("doesn't") | l.contains("won't")
    side = F.when(is_total, F.substring_index(l, " ", 1)).when(negated, "no").otherwise("yes")
    q = once(q, {"_m": market, "_s": side})
    q = order.carry_last(q, ["contest_id"], "seq", "_m", "_before", positions=quotes.select("seq"))
    other = F.col("_l") == "any other result"
    return q.withColumns({"market": F.when(other, F.col("_before")).otherwise(F.col("_m")),
                          "side": F.when(other & F.col("_before").isNotNull(), "no").when(F.col("_m").isNotNull(), F.col("_s"))}).drop("_l", "_m", "_s", "_before", "_red", "_blue")


def market_class(market: Column) -> Column:
    return (F.when(market == "distance", "distance").when(market.startswith("total_rounds_"), "total_rounds")
            .when(market.startswith("starts_round_"), "starts_round").when(market.startswith("ends_round_"), "ends_round")
            .when(market.contains("_method_"), "method").when(market.endswith("_inside_distance"), "inside_distance")
            .when(market.contains("_wins_round_"), "wins_round").otherwise("other"))


def line_round(line: Column, compat: bool = True) -> Column:
    """Last round that counts as under the line; ``compat`` keeps the upward rounding of halves."""
    return F.floor(line + 0.5) if compat else F.floor(line)


def _parts(df: DataFrame, compat: bool) -> DataFrame:
    """Market class, its number, the method word and whether the red or blue letter means A."""
    # a failed cast costs an exception: only these classes have a number
    numbered = market_class(F.col("market")).isin("total_rounds", "starts_round", "ends_round", "wins_round")
    number = F.when(numbered, F.substring_index("market", "_", -1).try_cast("double"))
    is_a = (F.substring("market", 1, 1) == "r") == (F.col("a_is_red") == 1)
    return once(df, {"market_class": market_class(F.col("market")), "_num": number, "_under": line_round(number, compat),
                     "_word": F.substring_index("market", "_method_", -1), "_a": is_a})


def _pick(a: Column, b: Column) -> Column:
    return F.when(F.col("_a"), a).otherwise(b)


def price(quotes: DataFrame, classes: DataFrame, compat: bool = True, rounds_given_finish: bool = False) -> DataFrame:
    """Model probability and graded outcome per quote; both NULL when the model has no view.

    ``rounds_given_finish`` multiplies round shares by the finish probability where
    the market speaks of whole contests.
    """
    q = _parts(quotes.select("contest_id", "seq", "market", "side", "american").join(classes, "contest_id"), compat)
    rounds = [F.col(c) for c in ROUND_COLS]
    finish = F.col("pa_ko") + F.col("pa_sub") + F.col("pb_ko") + F.col("pb_sub")
    scale = finish if rounds_given_finish else F.lit(1.0)

    def mass(keep):
        return sum((F.when(keep(i), r).otherwise(F.lit(0.0)) for i, r in enumerate(rounds[1:], start=2)),
                   F.when(keep(1), rounds[0]).otherwise(F.lit(0.0))) * scale

    n = F.col("_num")
    early, at = mass(lambda i: n > i), mass(lambda i: n == i)
    at_given = F.element_at(F.array(*rounds), F.when(n.between(1, 5), n.cast("int")).otherwise(F.lit(1)))
    under = mass(lambda i: F.col("_under") >= i)
    side_finish = _pick(F.col("pa_ko") + F.col("pa_sub"), F.col("pb_ko") + F.col("pb_sub"))
    kind = F.col("_word")
    by_method = _pick(
        F.when(kind == "KO_TKO", F.col("pa_ko")).when(kind == "SUB", F.col("pa_sub")).when(kind == "DEC", F.col("pa_dec")),
        F.when(kind == "KO_TKO", F.col("pb_ko")).when(kind == "SUB", F.col("pb_sub")).when(kind == "DEC", F.col("pb_dec")))
    cls = F.col("market_class")
    yes = (F.when(cls == "distance", F.col("pa_dec") + F.col("pb_dec"))
           .when(cls == "total_rounds", F.greatest(F.lit(0.0), 1.0 - under))
           .when(cls == "starts_round", F.greatest(F.lit(0.0), 1.0 - early)).when(cls == "ends_round", at)
           .when(cls == "method", by_method).when(cls == "inside_distance", side_finish)
           .when((cls == "wins_round") & (finish >= 1e-6), side_finish * at_given))
    no = F.when(cls == "total_rounds", under).otherwise(1.0 - yes)
    positive = F.col("side").isin("yes", "over")

    decision = F.col("method_true").endswith("_DEC")
    ended = F.when(~decision, F.substring("round_true", 2, 1).try_cast("int"))
    letter = F.when(F.col("_a"), "A").otherwise("B")
    finished = F.col("method_true").isin("A_KO_TKO", "A_SUB", "B_KO_TKO", "B_SUB") & F.col("method_true").startswith(letter)
    hit = (F.when(cls == "distance", decision).when(cls == "total_rounds", decision | (ended > F.col("_under")))
           .when(cls == "starts_round", decision | (ended >= n)).when(cls == "ends_round", F.coalesce(ended == n, F.lit(False)))
           .when((cls == "method") & kind.isin("KO_TKO", "SUB", "DEC"), F.col("method_true") == F.concat_ws("_", letter, kind))
           .when(cls == "inside_distance", finished)
           .when(cls == "wins_round", F.coalesce(ended == n, F.lit(False)) & finished))
    return once(q, {"our_prob": F.when(positive, yes).otherwise(no),
                    "won": F.when(positive, hit).otherwise(~hit).cast("int")}).drop("_num", "_under", "_word", "_a")


def edges(priced: DataFrame) -> DataFrame:
    """Vig-free probability from the pair of a market, edge and unit P&L; lone quotes keep their raw price."""
    q = priced.filter("market IS NOT NULL").withColumn("_i", odds.american_to_implied(F.col("american")))
    # a window, as a join with the sums would price every quote twice
    pair = Window.partitionBy("contest_id", "market")
    q = q.withColumns({"_n": F.count("*").over(pair), "_s": F.sum("_i").over(pair)}).filter("contest_id IS NOT NULL AND our_prob IS NOT NULL AND won IS NOT NULL")
    q = q.withColumns({"price": odds.american_to_decimal(F.col("american")),
                       "fair": F.when(F.col("_n") >= 2, F.col("_i") / F.col("_s"))})
    return once(q, {"edge": F.col("our_prob") - F.coalesce("fair", "_i"), "single": (F.col("_n") < 2).cast("int"),
                    "pnl": F.when(F.col("won") == 1, F.col("price") - 1).otherwise(F.lit(-1.0))}).drop("_i", "_s", "_n")
