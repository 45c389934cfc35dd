"""Raw files to the canonical tables: entities, events, contests, period statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contestlake.functions import parse
from contestlake.operators import cards, upsert

PAIRS = {"sig": "SIG.STR.", "total": "TOTAL STR.", "td": "TD", "head": "HEAD", "body": "BODY", "leg": "LEG", "dist": "DISTANCE", "clinch": "CLINCH", "ground": "GROUND"}
COUNTERS = ["kd", *[f"{p}_{x}" for p in PAIRS for x in ("l", "a")], "sub_att", "rev", "ctrl"]


def _q(c: str):
    return F.col(f"`{c}`")


def entities(raw: dict[str, DataFrame]) -> DataFrame:
    """Identity rows enriched with measures by their URL id."""
    who = raw["fighter_details"].select(parse.url_id(F.col("URL")).alias("entity_id"), F.nullif(F.trim(F.concat_ws(" ", "FIRST", "LAST")), F.lit("")).alias("full_name"),
                                        F.col("NICKNAME").alias("nickname")).filter("entity_id IS NOT NULL AND full_name IS NOT NULL")
    size = raw["fighter_tott"].select(parse.url_id(F.col("URL")).alias("entity_id"), parse.feet_inches_cm(F.col("HEIGHT")).alias("height_cm"),
                                      parse.inches_cm(F.col("REACH")).alias("reach_cm"), F.nullif("STANCE", F.lit("--")).alias("stance"), parse.any_date(F.col("DOB")).alias("dob"))
    return upsert.one_each(who, ["entity_id"]).join(upsert.one_each(size, ["entity_id"]), "entity_id", "left")


def events(raw: dict[str, DataFrame]) -> DataFrame:
    return upsert.one_each(raw["event_details"].select(parse.url_id(F.col("URL")).alias("event_id"), F.trim("EVENT").alias("event_name"), parse.any_date(F.col("DATE")).alias("dt"),
                                       F.col("LOCATION").alias("location"), parse.last_part(F.col("LOCATION")).alias("country")).filter(
        "event_id IS NOT NULL AND dt IS NOT NULL"), ["event_id"])


def contests(raw: dict[str, DataFrame], people: DataFrame, days: DataFrame) -> DataFrame:
    """Contests with both sides, winner, method and flags; names resolve by their squeezed text."""
    r = raw["fight_results"].withColumn("x", parse.split_pair(F.col("BOUT")))
    dims = people.groupBy(parse.squeeze(F.col("full_name")).alias("k")).agg(F.min("entity_id").alias("id"))
    r = r.withColumns({"_l": parse.squeeze(F.col("x.left")), "_r": parse.squeeze(F.col("x.right"))})
    r = r.join(dims.withColumnsRenamed({"k": "_l", "id": "red_id"}), "_l").join(dims.withColumnsRenamed({"k": "_r", "id": "blue_id"}), "_r")
    r = r.withColumn("event_name", F.trim("EVENT")).join(days.select("event_name", "event_id", "dt"), "event_name")
    return upsert.one_each(r.select(parse.url_id(F.col("URL")).alias("contest_id"), "event_id", "dt", "red_id", "blue_id", F.trim("WEIGHTCLASS").alias("pool"),
                    parse.winner_of(F.col("OUTCOME"), F.col("red_id"), F.col("blue_id")).alias("winner_id"), parse.outcome_method(F.col("METHOD")).alias("method"),
                    parse.first_int(F.col("ROUND")).alias("period_ended"), parse.clock_seconds(F.col("TIME")).alias("time_ended_sec"),
                    parse.is_title(F.col("WEIGHTCLASS")).alias("is_title"), parse.is_long_format(_q("TIME FORMAT")).alias("is_long"),
                    parse.squeeze(F.col("EVENT")).alias("event_key"), parse.squeeze(F.col("BOUT")).alias("bout_key")).filter("contest_id IS NOT NULL"), ["contest_id"])


def period_stats(raw: dict[str, DataFrame], fights: DataFrame, people: DataFrame) -> DataFrame:
    """Counters per period joined by (event, bout) and name, with the total as period 0."""
    s = raw["fight_stats"].withColumns({"event_key": parse.squeeze(F.col("EVENT")), "bout_key": parse.squeeze(F.col("BOUT")), "k": parse.squeeze(F.col("FIGHTER")),
                                        "period": parse.first_int(F.col("ROUND"))}).filter("period IS NOT NULL")
    for p, c in PAIRS.items():
        s = s.withColumn(f"_{p}", parse.landed_of_attempted(_q(c))).withColumns({f"{p}_l": F.col(f"_{p}.landed"), f"{p}_a": F.col(f"_{p}.attempted")})
    s = s.withColumns({"kd": parse.safe_int(F.col("KD")), "sub_att": parse.safe_int(_q("SUB.ATT")), "rev": parse.safe_int(_q("REV.")), "ctrl": parse.clock_seconds(F.col("CTRL"))})
    dims = people.groupBy(parse.squeeze(F.col("full_name")).alias("k")).agg(F.min("entity_id").alias("entity_id"))
    rows = s.join(fights.select("event_key", "bout_key", "contest_id"), ["event_key", "bout_key"]).join(dims, "k")
    return cards.with_totals(rows.select("contest_id", "entity_id", "period", *COUNTERS), ["contest_id", "entity_id"], COUNTERS)


def canonical(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All four tables of one raw folder."""
    people, days = entities(raw), events(raw)
    fights = contests(raw, people, days)
    return {"entities": people, "events": days, "contests": fights, "period_stats": period_stats(raw, fights, people)}


