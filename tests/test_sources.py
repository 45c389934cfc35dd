"""Files in and out, raw pages, and the canonical load."""

import datetime as dt

from contestlake.operators import upsert
from contestlake.plans import load
from contestlake.sources import pages, tables


def test_raw_set_and_load(spark, tmp_path):
    put = lambda n, t: (tmp_path / f"{n}.csv").write_text(t)
    put("event_details", 'EVENT,URL,DATE,LOCATION\nNight 1,http://x/e1,"July 4, 2020","Reno, Nevada, USA"\n')
    put("fighter_details", "FIRST,LAST,NICKNAME,URL\nAnn,Lee,,http://x/f1\nBo,Roe,B,http://x/f2\n")
    put("fighter_tott", 'FIGHTER,HEIGHT,WEIGHT,REACH,STANCE,DOB,URL\nAnn Lee,"5\' 6""",135,"66""",Switch,"Jan 2, 1990",http://x/f1\n')
    put("fight_results", "EVENT,BOUT,OUTCOME,WEIGHTCLASS,METHOD,ROUND,TIME,TIME FORMAT,REFEREE,DETAILS,URL\nNight 1,Ann Lee vs. Bo Roe,L/W,UFC Flyweight Title Bout,KO/TKO,2,1:30,5 Rnd (5-5-5-5-5),R,D,http://x/c1\n")
    put("fight_stats", "EVENT,BOUT,ROUND,FIGHTER,KD,SIG.STR.,SIG.STR. %,TOTAL STR.,TD,TD %,SUB.ATT,REV.,CTRL,HEAD,BODY,LEG,DISTANCE,CLINCH,GROUND\n"
        + "".join(f"Night 1,Ann Lee vs. Bo Roe,Round {r},{n},1,{r} of 9,1%,3 of 4,0 of 1,0%,0,0,0:10,1 of 2,1 of 2,1 of 2,1 of 2,1 of 2,1 of 2\n" for r in (1, 2) for n in ("Ann Lee", "Bo Roe")))
    raw = tables.read_raw(spark, str(tmp_path))
    assert raw["fight_details"].count() == 0
    got = load.canonical(raw)
    c = got["contests"].first()
    assert (c["winner_id"], c["method"], c["time_ended_sec"], c["is_title"], c["is_long"], c["dt"]) == ("f2", "KO/TKO", 90, True, True, dt.date(2020, 7, 4))
    total = got["period_stats"].filter("period = 0 AND entity_id = 'f1'").first()
    assert (total["sig_l"], total["sig_a"], total["ctrl"]) == (3, 18, 20) and got["period_stats"].count() == 6
    assert got["entities"].filter("entity_id = 'f1'").first()["height_cm"] == 167.6


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), 0.5), (2, dt.date(2021, 1, 1), 0.6)], "contest_id int, dt date, p double")
    tables.save_by_year(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).filter("year = 2021").count() == 1
    for _ in range(2):
        tables.append_record(df.limit(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    tables.save_report(df, str(tmp_path / "r"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    for stamp in ("a", "b"):
        tables.save_snapshot(df, str(tmp_path / "s"), stamp)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
    assert tables.load_or_empty(spark, str(tmp_path / "none"), df.schema).count() == 0
    assert tables.load_model(spark, str(tmp_path / "none")) is None


def test_pages(spark):
    html = ('<p>Height: 5\' 11"</p><b>Born</b><i>Reno, Nevada</i> record 12-3-1 <script>{"startDate": "2020-07-04T00:00"}</script>'
            '<td data-li="[5,1,77]"><span>+150</span></td><td data-li="[5,2,77]"><span>-200</span></td>')
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    r = pages.labelled(df, ["Height", "Born"]).first()
    assert (r["height"], r["born"]) == ("5' 11\"", "Reno, Nevada")
    assert tuple(pages.record(df).first())[1:] == (12, 3, 1)
    assert pages.event_date(df).first()["event_date"] == dt.date(2020, 7, 4)
    assert [(x["book"], x["side"], x["matchup"], x["price"]) for x in pages.price_cells(df).collect()] == [("5", "1", "77", "+150"), ("5", "2", "77", "-200")]


def test_matchups(spark):
    def row(side, matchup, *prices, who="a-b-7", more=""):
        cells = "".join(f'<td class="but-sg" data-li="[{k},{side},{matchup}]"><span>9</span><span id="oID{k}">{p}</span></td>' for k, p in enumerate(prices))
        return f'<tr{more}><a href="/fighters/{who}"> N{side} </a>{cells}</tr>'

    first = "<tbody>" + row(1, 9, "+500") + row(2, 9, "+500") + "</tbody>"
    body = (row(2, 1, "-200", "\u2212220") + row(1, 1, "+150", "+170", "+900", who="c-8/") + row(1, 2, "+100") + row(1, 3) + row(2, 3, "+100")
            + row(1, 1, "+1", more=' class="pr"') + "".join(row(s, 4, "+110") for s in (1, 2, 2)) + row(1, 5, "even") + row(2, 5, "+120") + '<tr><td class="but-sg" data-li="[1,1,6]"></td></tr>')
    head = "<h1>Night</h1><h2>On July\n 4, 2020, in Reno</h2>"
    df = spark.createDataFrame([(1, f"{head}{first}<tbody>{body}</tbody>"), (2, first), (3, ""), (4, None), (5, f"<meta content='March 1, 2021'>{first}<tbody></tbody>")], "page_id int, html string")
    assert [tuple(r) for r in pages.matchups(df).collect()] == [(1, 1, "N1", "8", 170.0, 3, "N2", "7", -210.0, 2)]
    assert {r["page_id"]: r["event_date"] for r in pages.event_date(df).collect()} == {1: dt.date(2020, 7, 4), 2: None, 3: None, 4: None, 5: dt.date(2021, 3, 1)}
    assert pages.matchups(df.limit(0)).count() == 0


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, stamp int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, stamp int")
    once = upsert.replace(old, new, ["k"], "stamp")
    twice = upsert.replace(once, new, ["k"], "stamp")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]
