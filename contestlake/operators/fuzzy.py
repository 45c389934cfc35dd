"""Approximate name joins: exact keys first, then blocked candidates, then scores.

Blocking works on distinct name keys, never on rows, so a name shared by a third
of all rows is scored once.  ``by_pieces`` is complete for its threshold: two
strings within k inserts and deletes share one of k+1 pieces of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contestlake.functions import names, similarity
from contestlake.functions.plan import durable
from contestlake.operators import resolve


def sorted_tokens(key: Column) -> Column:
    return F.array_join(F.array_sort(F.split(key, " ")), " ")


def by_pieces(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct string pairs (l, r) that can reach ``threshold`` on 200 * LCS / (len l + len r).

    A right string of length n is cut into k+1 pieces, k being the most inserts
    and deletes the threshold allows with any admissible partner; a left string
    is probed with its substrings near each piece's place.
    """
    t = threshold / 100.0
    far = (1.0 - t) * (1.0 + (2.0 - t) / t)      # most edits per character of the right string
    r = right.select("r").distinct().withColumn("_n", F.length("r")).filter("_n > 0")
    k = F.least(F.floor(F.col("_n") * far + 1e-9), F.col("_n") - 1).cast("int")
    r = r.withColumn("_k", k)

    def cut(i):
        return F.floor(i * F.col("_n") / (F.col("_k") + 1)).cast("int")

    pieces = r.select("r", "_n", F.explode(F.transform(F.sequence(F.lit(0), F.col("_k")), lambda i: F.struct(
        i.alias("i"), F.substr(F.col("r"), cut(i) + 1, cut(i + 1) - cut(i)).alias("text")))).alias("p")).select("r", "_n", "p.*")
    l = left.select("l").distinct().withColumn("_m", F.length("l")).filter("_m > 0")
    sizes = F.sequence(F.ceil(F.col("_m") * (t / (2.0 - t)) - 1e-9).cast("int"), F.floor(F.col("_m") * ((2.0 - t) / t) + 1e-9).cast("int"))
    l = l.withColumn("_n", F.explode(sizes)).filter("_n > 0")
    l = l.withColumn("_k", F.least(F.floor(F.col("_n") * far + 1e-9), F.col("_n") - 1).cast("int"))
    l = l.select("*", F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("i"))
    start, size = cut(F.col("i")), cut(F.col("i") + 1) - cut(F.col("i"))
    l = l.withColumns({"_at": start, "_len": size}).select(
        "l", "_n", "i", F.explode(F.transform(F.sequence(F.greatest(F.lit(0), F.col("_at") - F.col("_k")), F.greatest(F.lit(0), F.least(
            F.col("_at") + F.col("_k"), F.col("_m") - F.col("_len")), F.col("_at") - F.col("_k"))),
            lambda s: F.substr(F.col("l"), s + 1, F.col("_len")))).alias("text"))
    return l.distinct().join(pieces, ["_n", "i", "text"]).select("l", "r").distinct()


def by_tokens(left: DataFrame, right: DataFrame, gates: list[str] | None = None) -> DataFrame:
    """Distinct key pairs that share a token (and equal gate columns)."""
    gates = gates or []
    a = left.select("l", *gates, F.explode(F.split("l", " ")).alias("t")).distinct()
    b = right.select("r", *gates, F.explode(F.split("r", " ")).alias("t")).distinct()
    return a.join(b, ["t", *gates]).select("l", "r", *gates).distinct()


def by_containment(left: DataFrame, right: DataFrame, gates: list[str] | None = None) -> DataFrame:
    """Distinct pairs (l, r) in which all tokens of one name are among those of the other (and equal gate columns).

    The contained name meets the other one by its rarest token only, so a token that all names hold makes no pairs.
    """
    gates = gates or []

    def tokens(df, name):
        return df.select(name, *gates, F.explode(F.array_distinct(F.split(name, " "))).alias("t")).distinct()

    def inside(a, b, small, large):
        held = tokens(b, large)
        often = held.groupBy("t", *gates).agg(F.count("*").alias("n"))
        rarest = tokens(a, small).join(often, ["t", *gates], "left").groupBy(small, *gates).agg(F.min_by("t", F.struct(F.coalesce("n", F.lit(0)), "t")).alias("t"))
        return rarest.join(held, ["t", *gates]).filter(F.size(F.array_except(F.split(small, " "), F.split(large, " "))) == 0).select("l", "r", *gates)

    return inside(left, right, "l", "r").unionByName(inside(right, left, "r", "l")).distinct()


def shortened(text: Column, removed: int) -> Column:
    """The texts that are left of ``text`` without ``removed`` characters."""
    out = F.array(text)
    for _ in range(removed):
        out = F.array_distinct(F.flatten(F.transform(out, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1, F.length(x))))))))
    return out


def by_edits(left: DataFrame, right: DataFrame, edits: int, gates: list[str] | None = None, l: str = "l", r: str = "r") -> DataFrame:
    """Rows of both sides whose texts ``l`` and ``r`` are at most ``edits`` inserts and deletes apart (and equal gate columns).

    They meet by a whole text that both can be cut to, so a beginning that all names share makes no pairs.
    """
    gates = gates or []
    cuts = [(a, n - a) for n in {edits, max(edits - 1, 0)} for a in range(n + 1)]      # fewer edits of the same parity are among them

    def forms(df, text, own):
        def cut(c):
            return F.transform(shortened(F.col(text), c[own]), lambda x: F.struct(F.lit(c[0]).alias("_cl"), F.lit(c[1]).alias("_cr"), x.alias("_text")))

        return df.select("*", F.inline(F.flatten(F.array(*map(cut, cuts)))))

    met = forms(left, l, 0).join(forms(right, r, 1), [*gates, "_cl", "_cr", "_text"])
    return met.drop("_cl", "_cr", "_text").distinct()


def by_few_edits_beside_common(left: DataFrame, right: DataFrame, gates: list[str]) -> DataFrame:
    """Distinct pairs (l, r) whose tokens, the common ones put first, are at most one insert or delete apart.

    One edit changes at most two tokens of a name, so it is enough to set apart every choice of up to two of them.
    """
    def split(df, name):
        t = F.array_sort(F.array_distinct(F.split(name, " ")))
        df = df.select(name, *gates, t.alias("_t")).distinct()
        n = F.size("_t")
        place = F.sequence(F.lit(0), n - 1)
        pairs = F.flatten(F.transform(place, lambda i: F.transform(F.filter(place, lambda j: j >= i), lambda j: F.array(i, j))))
        chosen = F.concat(F.array(F.array().cast("array<int>")), pairs)
        df = df.select(name, *gates, "_t", F.explode(chosen).alias("_i"))
        kept = F.filter("_t", lambda x, k: ~F.array_contains("_i", k))
        rest = F.filter("_t", lambda x, k: F.array_contains("_i", k))
        return df.select(name, *gates, F.array_join(kept, " ").alias("_head"), F.array_join(rest, " ").alias(f"_{name}"))

    return by_edits(split(left, "l"), split(right, "r"), 1, [*gates, "_head"], "_l", "_r").select("l", "r", *gates).distinct()


def _keys(df: DataFrame, column: str, out: str, shape=lambda k: k) -> DataFrame:
    return df.select(shape(names.name_key(F.col(column))).alias(out)).filter(F.col(out) != "").distinct()


def _best(scored: DataFrame, by: list[str], *tie: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), *tie)
    return scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def match_stubs(stubs: DataFrame, entities: DataFrame, threshold: float = 90.0) -> tuple[DataFrame, DataFrame]:
    """Best token-sort stub name per entity, then the birth-day gate among the stubs of that name.

    An entity's known birth day must agree within a day with exactly one of them; without one the name must
    belong to a single stub.  Several entities may take one stub.  An equal name scores 100 and cannot be
    beaten.  Others are looked for within one edit, then two, and those left in blocks of pieces: where k (k + 1)
    is below a name's length, no name further away scores as much as one within k edits.  Returns matches and the
    entities left for review.
    """
    s = stubs.select("stub_id", F.col("dob").alias("s_dob"), F.lower("name").alias("low"), sorted_tokens(names.name_key(F.col("name"))).alias("l"))
    e = entities.withColumn("r", sorted_tokens(names.name_key(F.col("full_name"))))
    known, asked = s.filter("l <> ''").select("l").distinct(), e.filter("r <> ''").select("r").distinct()
    equal = asked.join(known, F.col("l") == F.col("r")).withColumn("score", F.lit(100.0))
    rest = asked.join(known, F.col("l") == F.col("r"), "left_anti")
    found, rest = [], durable(rest)
    for k in (1, 2):
        asked = rest.filter(F.length("r") > k * (k + 1))
        found.append(durable(by_edits(known, asked, k)))
        rest = durable(rest.join(found[-1].select("r"), "r", "left_anti"))
    pairs = found[0].unionByName(found[1]).unionByName(by_pieces(known, rest, threshold))
    near = pairs.withColumn("score", similarity.ratio("l", "r")).filter(F.col("score") >= threshold)
    top = _best(equal.unionByName(near).join(s.select("l", "low").distinct(), "l"), ["r"], "low").select("r", "low", "score")
    found = e.join(top, "r").join(s.select("stub_id", "s_dob", "low"), "low")
    ok = F.when(F.col("dob").isNotNull(), F.coalesce(F.abs(F.date_diff("dob", "s_dob")) <= 1, F.lit(False))).otherwise(True)
    gated = found.filter(ok).groupBy("entity_id").agg(F.count("*").alias("n"), F.min("stub_id").alias("stub_id"), F.max("score").alias("score"))
    matched = gated.filter("n = 1").select("stub_id", "entity_id", "score")
    return matched, entities.join(matched.select("entity_id"), "entity_id", "left_anti")


def by_sorted_pieces(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (l, r) whose sorted tokens can reach ``threshold``."""
    a = left.select("l", sorted_tokens(F.col("l")).alias("_l")).distinct()
    b = right.select("r", sorted_tokens(F.col("r")).alias("_r")).distinct()
    near = by_pieces(a.select(F.col("_l").alias("l")), b.select(F.col("_r").alias("r")), threshold).withColumnsRenamed({"l": "_l", "r": "_r"})
    return near.join(a, "_l").join(b, "_r").select("l", "r").distinct()


def by_windows(short: DataFrame, long: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (l, r) in which l can reach ``threshold`` against a window of r, r being no shorter than l.

    Windows are the substrings of r as long as l, and shorter ones at its two ends, as the partial score takes them.
    Each distinct window is one text, however many names hold it, and meets l by its pieces.
    """
    t = threshold / 100.0
    ends = t / (2.0 - t)                # least length of a cut window, as a share of l
    l = short.select("l").distinct().filter("l <> ''")
    sizes = l.select(F.length("l").alias("_n")).distinct()          # one row per length of a name
    r = long.select("r").distinct().withColumn("_m", F.length("r")).filter("_m > 0")
    r = r.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_m")))).join(F.broadcast(sizes), "_n")
    least = F.ceil(F.col("_n") * ends - 1e-9).cast("int")
    starts = F.sequence(least - F.col("_n"), F.col("_m") - least)   # windows may begin before r and end behind it
    w = r.select("r", "_n", F.explode(F.transform(starts, lambda s: F.substr(
        F.col("r"), F.greatest(s, F.lit(0)) + 1, F.least(s + F.col("_n"), F.col("_m")) - F.greatest(s, F.lit(0))))).alias("w")).distinct()

    # both lengths are known, so the characters in common, the edits and the shift of a piece have exact bounds
    def bounds(df):
        df = df.withColumn("_c", F.ceil((F.col("_n") + F.col("_s")) * (t / 2.0) - 1e-9).cast("int"))
        return df.withColumns({"_k": F.least(F.col("_n") + F.col("_s") - 2 * F.col("_c"), F.col("_s") - 1), "_d": F.greatest("_n", "_s") - F.col("_c")})

    def cut(i):
        return F.floor(i * F.col("_s") / (F.col("_k") + 1)).cast("int")

    i = F.col("_i")
    held = bounds(w.select("w", "_n", F.length("w").alias("_s")).distinct())
    held = held.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k")))).select("w", "_n", "_s", "_i", F.substr(F.col("w"), cut(i) + 1, cut(i + 1) - cut(i)).alias("text"))
    asked = l.withColumn("_n", F.length("l"))
    asked = bounds(asked.withColumn("_s", F.explode(F.sequence(F.ceil(F.col("_n") * ends - 1e-9).cast("int"), F.col("_n")))).filter("_s > 0"))
    asked = asked.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k")))).withColumns({"_at": cut(i), "_len": cut(i + 1) - cut(i)})
    first, last = F.greatest(F.lit(0), F.col("_at") - F.col("_d")), F.least(F.col("_at") + F.col("_d"), F.col("_n") - F.col("_len"))
    asked = asked.withColumns({"_first": first, "_last": last}).filter("_first <= _last").select("l", "_n", "_s", "_i", F.explode(F.transform(
        F.sequence(F.col("_first"), F.col("_last")), lambda s: F.substr(F.col("l"), s + 1, F.col("_len")))).alias("text"))
    near = asked.distinct().join(held, ["_n", "_s", "_i", "text"]).select("l", "w", "_n").distinct()
    return near.filter(similarity.ratio("l", "w") >= threshold).join(w, ["w", "_n"]).select("l", "r").distinct()


def by_last_tokens(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (l, r) in which the last token of l can reach ``threshold`` against a window of r, or r against one of it."""
    a = left.select("l", F.element_at(F.split("l", " "), -1).alias("_l")).distinct()
    inside = by_windows(a.select(F.col("_l").alias("l")), right, threshold).withColumnRenamed("l", "_l")
    around = by_windows(right.select(F.col("r").alias("l")), a.select(F.col("_l").alias("r")), threshold).select(F.col("r").alias("_l"), F.col("l").alias("r"))
    return inside.unionByName(around).join(a, "_l").select("l", "r").distinct()


def flipped(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("r").alias("l"), F.col("l").alias("r"))


def name_pairs(left: DataFrame, right: DataFrame, threshold: float, scorer: str) -> DataFrame:
    """Pairs (l, r, score) of distinct names that reach ``threshold``.

    ``ratio`` and ``sort`` (token-sort) compare whole names; ``set`` is the best of token-set and of either
    last token against the other name, ``set_left`` leaves out the last token of the right name.  Blocks:
    pieces for whole names; for token sets, names without a common token score by their sorted tokens, so
    common tokens and pieces of sorted tokens are complete; a last token is looked for in all windows of the
    other name.  No pair is lost.
    """
    if scorer in ("ratio", "sort"):
        near, score = (by_pieces, similarity.ratio("l", "r")) if scorer == "ratio" else (by_sorted_pieces, similarity.token_sort_ratio("l", "r"))
        return near(left, right, threshold).withColumn("score", score).filter(F.col("score") >= threshold)
    # token sets score 100 where one holds the other
    sets = by_containment(left, right) if threshold >= 100 else by_tokens(left, right).unionByName(by_sorted_pieces(left, right, threshold))
    near = sets.unionByName(by_last_tokens(left, right, threshold))
    terms = [similarity.token_set_ratio("l", "r"), similarity.partial_ratio(names.last_token(F.col("l")), F.col("r"))]
    if scorer == "set":
        turned = by_last_tokens(right.withColumnRenamed("r", "l"), left.withColumnRenamed("l", "r"), threshold)
        near = near.unionByName(flipped(turned))
        terms.append(similarity.partial_ratio(F.col("l"), names.last_token(F.col("r"))))
    return near.distinct().withColumn("score", F.greatest(*terms)).filter(F.col("score") >= threshold)


def resolve_names(rows: DataFrame, entities: DataFrame, threshold: float = 88.0) -> DataFrame:
    """Cascade: same text ignoring case, same key, then token-set score within the same pool.

    A name of length n whose tokens are contained in another name's, hold them, or are one edit from them beside
    the common tokens, scores more than 1 - 1 / (n + 1) with it if n > 2, and with no other name; only names without such a
    partner meet all names with a common token.
    """
    e = entities.select("entity_id", "pool", F.lower("full_name").alias("_low"), names.name_key(F.col("full_name")).alias("_key"))
    r = rows.withColumns({"_low": F.lower("name"), "_key": names.name_key(F.col("name"))})
    one = e.groupBy("_low").agg(F.min("entity_id").alias("_e1"))
    two = e.groupBy("_key").agg(F.min("entity_id").alias("_e2"))
    exact = r.join(one, "_low", "left").join(two, "_key", "left").withColumn("entity_id", F.coalesce("_e1", "_e2"))
    done = exact.filter("entity_id IS NOT NULL").select("row_id", "entity_id", F.when(F.col("_e1").isNotNull(), 1).otherwise(2).alias("stage"), F.lit(100.0).alias("score"))
    rest = exact.filter("entity_id IS NULL").select("row_id", "pool", F.col("_key").alias("l"))
    dims = e.select("entity_id", "pool", F.col("_key").alias("r"))
    asked, known = durable(rest.filter("l <> ''").select("l", "pool").distinct()), durable(dims.filter("r <> ''").select("r", "pool").distinct())
    close = by_containment(asked, known, ["pool"]).unionByName(by_few_edits_beside_common(asked, known, ["pool"])).distinct()
    close = durable(close.withColumn("score", similarity.token_set_ratio("l", "r")))
    size = F.length(F.array_join(F.array_distinct(F.split("l", " ")), " "))
    asked = durable(asked.join(close.filter(F.col("score") > 100.0 * (1.0 - 1.0 / (size + 1.0)) + 1e-9).select("l", "pool"), ["l", "pool"], "left_anti"))
    # names without a common token score by their sorted tokens, so the two blocks lose no pair
    pieces = by_sorted_pieces(asked, known, threshold).join(asked, "l").join(known, ["r", "pool"])
    pairs = by_tokens(asked, known, ["pool"]).unionByName(pieces.select("l", "r", "pool")).distinct()
    pairs = pairs.withColumn("score", similarity.token_set_ratio("l", "r")).unionByName(close.join(asked, ["l", "pool"], "left_anti")).filter(F.col("score") >= threshold)
    fuzzy = _best(rest.join(pairs, ["l", "pool"]).join(dims, ["r", "pool"]), ["row_id"], "entity_id")
    return done.unionByName(fuzzy.select("row_id", "entity_id", F.lit(3).alias("stage"), "score"))


def match_pairs(left: DataFrame, right: DataFrame, threshold: float, days: int | None = None, scorer: str = "set") -> DataFrame:
    """Best right contest per left contest: max(min(straight), min(crossed)) of the two name scores.

    ``scorer`` as in ``name_pairs``; blocks are its blocks over distinct names, and the day window when given.
    Left needs left_id, a_name, b_name (, dt); right needs right_id, x_name, y_name (, dt).  A score of 100
    cannot be beaten: only rows without one are compared at ``threshold``, and with the days near them.
    """
    if threshold >= 100:
        return _match_pairs(left, right, threshold, days, scorer)
    first = durable(_match_pairs(left, right, 100.0, days, scorer))
    rest = left.join(first.select("left_id"), "left_id", "left_anti")
    if days is not None:
        rest = rest.join(resolve.days_around(right, days), "dt", "left_semi")
    rest = durable(rest)
    if rest.isEmpty():
        return first
    if days is not None:
        right = right.join(resolve.days_around(rest, days), "dt", "left_semi")
    return first.unionByName(_match_pairs(rest, right, threshold, days, scorer))


def _match_pairs(left: DataFrame, right: DataFrame, threshold: float, days: int | None, scorer: str) -> DataFrame:
    l = left.withColumns({"_a": names.name_key(F.col("a_name")), "_b": names.name_key(F.col("b_name"))})
    r = right.withColumns({"_x": names.name_key(F.col("x_name")), "_y": names.name_key(F.col("y_name"))})
    ln = durable(l.select(F.explode(F.array("_a", "_b")).alias("l")).filter("l <> ''").distinct())
    rn = durable(r.select(F.explode(F.array("_x", "_y")).alias("r")).filter("r <> ''").distinct())
    # names are scored once; both members of a match must reach the threshold
    score = name_pairs(ln, rn, threshold, scorer)
    cols = ["right_id", "_x", "_y"] + (["dt"] if days is not None else [])
    via = l.join(score.withColumnsRenamed({"l": "_a", "r": "_p", "score": "_s1"}), "_a")
    straight = r.select(*cols).withColumns({"_p": F.col("_x"), "_q": F.col("_y"), "flipped": F.lit(0)})
    crossed = r.select(*cols).withColumns({"_p": F.col("_y"), "_q": F.col("_x"), "flipped": F.lit(1)})
    both = straight.unionByName(crossed).drop("_x", "_y")
    if days is None:
        met = via.join(both, "_p")
    else:
        met = resolve.near_days(via, both, ["_p"], days).withColumnsRenamed({"r_right_id": "right_id", "r__q": "_q", "r_flipped": "flipped"})
    second = score.withColumnsRenamed({"l": "_b", "r": "_q", "score": "_s2"})
    scored = met.join(second, ["_b", "_q"]).withColumn("score", F.least("_s1", "_s2"))
    return _best(scored, ["left_id"], "right_id", "flipped").select("left_id", "right_id", "flipped", "score")


def best_key(rows: DataFrame, threshold: float = 60.0) -> DataFrame:
    """Best key of each row's price map for the target name."""
    long = rows.select("row_id", "target", F.explode("prices").alias("key", "price"))
    a, b = names.name_key(F.col("target")), names.name_key(F.col("key"))
    scored = long.withColumn("score", F.greatest(similarity.token_set_ratio(a, b), similarity.partial_ratio(names.last_token(a), b), similarity.partial_ratio(a, names.last_token(b))))
    return _best(scored.filter(F.col("score") >= threshold), ["row_id"], "key")


def side_of(text: Column, a: Column, b: Column, threshold: float = 65.0) -> Column:
    """A or B by the better of whole-name and last-name scores; a draw of scores stays open."""
    t = names.name_key(text)

    def score(n):
        return F.greatest(similarity.token_set_ratio(names.name_key(n), t), similarity.partial_ratio(names.last_token(n), t))

    sa, sb = score(a), score(b)
    return F.when((sa >= threshold) & (sa > sb), "A").when((sb >= threshold) & (sb > sa), "B")


def merge_schedule(schedule: DataFrame, predictions: DataFrame, threshold: float = 88.0) -> DataFrame:
    """Predictions plus the schedule entries that none of them matches in either order.

    An entry whose pair of name keys is among the predictions scores 100 and needs no search; only the
    others are compared approximately.
    """
    def keys(df):
        a, b = names.name_key(F.col("a_name")), names.name_key(F.col("b_name"))
        return df.withColumn("_pair", F.when((a != "") & (b != ""), resolve.pair_key(a, b)))

    rest = keys(schedule).join(keys(predictions).select("_pair").distinct(), "_pair", "left_anti").drop("_pair")
    hit = match_pairs(rest.selectExpr("scheduled_id AS left_id", "a_name", "b_name"), predictions.selectExpr("contest_id AS right_id", "a_name AS x_name", "b_name AS y_name"), threshold, scorer="ratio")
    open_rows = rest.join(hit.select(F.col("left_id").alias("scheduled_id")), "scheduled_id", "left_anti")
    return predictions.unionByName(open_rows, allowMissingColumns=True)
