"""Streams with state against loops over the same rows: several batches, late rows, rows out of order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from contestlake.operators import metrics
from contestlake.streaming import jobs

T0 = dt.datetime(2024, 1, 4)


def streamed(spark, folder, batches, schema):
    """A stream that reads one file per batch, in the given order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_grades(spark, tmp_path):
    h = lambda x: T0 + dt.timedelta(hours=x)
    batches = [
        [(h(0), 1, 10, 1, True), (h(0), 2, 20, 0, True), (h(0.5), 3, 30, 1, True), (h(1), 1, 11, 0, True)],
        [(h(2), 1, 100, 1, False), (h(1.5), 1, 101, 0, False), (h(8), 9, 90, 0, True)],                 # out of order within the delay
        [(h(7.2), 2, 21, 1, True), (h(12), 9, 91, 0, True), (h(9), 2, 200, 1, False)],                # 20 is beyond its span by now
        [(h(1), 3, 300, 1, False), (h(30), 9, 92, 0, True)],                                                 # too late for 30
        [(h(60), 9, 93, 0, True)],
    ]
    out = jobs.graded(streamed(spark, tmp_path / "in", batches, "ts timestamp, user long, id long, said long, is_open boolean"), "ts", "user", 4, "1 hour")
    got = {(r["key"], r["open_id"], r["settle_id"], r["grade"]) for r in jobs.drain(out, "test-grades").collect()}
    assert got == {(1, 10, 101, "lost"), (1, 11, 101, "won"), (2, 20, None, "ungraded"), (2, 21, 200, "won"), (3, 30, None, "ungraded"), (9, 90, None, "ungraded"), (9, 91, None, "ungraded"),
                   (9, 92, None, "ungraded")}


def test_drift_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted((T0 + dt.timedelta(minutes=rng.randrange(35 * 24 * 60)), k, rng.choice("ab") if k % 40 else "c", rng.randint(0, 1), rng.uniform(0.05, 0.95)) for k in range(900))
    batches = [rows[:150], rows[150:400], rows[400:700], rows[700:], [(T0 + dt.timedelta(days=60), 10_000, "z", 1, 0.5)]]
    for b in batches:
        rng.shuffle(b)
    schema = "ts timestamp, id long, pool string, label int, p double"
    got = jobs.drain(jobs.drift(streamed(spark, tmp_path / "in", batches, schema), "ts", "pool", "id", delay="2 days", before_rows=60), "test-drift").collect()
    table = spark.createDataFrame(rows, schema).withColumns({"dt": F.col("ts"), "contest_id": F.col("id")}).cache()
    assert len(got) > 12 and {r["pool"] for r in got} == {"a", "b", "c"}
    for r in got:
        end = r["start"] + dt.timedelta(days=7)
        want = metrics.drift(table.filter((F.col("pool") == r["pool"]) & (F.col("ts") < F.lit(end))), F.lit(end).cast("date"), recent_days=7, before_rows=60).first()
        assert (r["n_recent"], r["n_before"], r["alert"]) == (want["n_recent"], want["n_before"], want["alert"])
        for c in ("recent", "before", "delta"):
            assert r[c] == (None if want[c] is None else pytest.approx(want[c], abs=1e-9))
    assert any(r["delta"] is None for r in got) and any(r["delta"] is not None for r in got)


def test_schedule_table_rewrites_what_a_batch_touches(spark, tmp_path):
    rng = random.Random(3)
    batches = [[(rng.randrange(60) if n else k, f"event {rng.randrange(9)}", rng.random() < 0.2, rng.random() < 0.2, rng.random() < 0.3) for k in range(size)] for n, size in enumerate((50, 3, 40, 2, 1))]
    folder, want = str(tmp_path / "table"), {}
    table = jobs.ScheduleTable(spark, folder, "bigint", 8)
    schema = "scheduled_id long, event_name string, is_title boolean, is_long boolean, is_cancelled boolean"
    for n, rows in enumerate(batches):
        before = table.manifest(n - 1)
        for _ in range(2):  # a batch that runs again changes nothing
            table.merge(spark.createDataFrame(rows, schema), n)
        for key in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == key]
            old = want.get(key)
            flags = [any(r[k] for r in mine) or bool(old and old[k]) for k in (2, 3)]
            want[key] = (key, old[1] if old else min(r[1] for r in mine), *flags, any(r[4] for r in mine) if old else False, old[5] if old else n, n)
        after = table.manifest(n)
        assert {tuple(r) for r in table.rows(after).collect()} == set(want.values())
        assert sum(before.get(p) != v for p, v in after.items()) <= len({r[0] for r in rows})
    left = {(int(p.parent.name[2:]), int(p.name[5:])) for p in (tmp_path / "table/rows").glob("v=*/part=*")}
    assert left == {(v, p) for m in (3, 4) for p, v in table.manifest(m).items()}
    assert any(r[4] for r in want.values()) and len(left) < 8 * 5
