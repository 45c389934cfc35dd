"""Structured Streaming forms of the incremental steps.

Every job reads a file stream, keeps only watermark-bounded or per-entity state,
and writes to tables under the checkpoint folder.
"""

from __future__ import annotations

import bisect
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from contestlake.functions import probability as prob
from contestlake.functions.plan import checkpoint_folder
from contestlake.operators import ratings, upsert

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A row of the drift state: time in microseconds, id, loss.
ROW = np.dtype([("at", "i8"), ("id", "i8"), ("loss", "f8")])
#: So many contests are rated and returned at a time.
SLICE = 100_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def files(spark: SparkSession, folder: str, name: str, schema: StructType, per_batch: int = 64) -> DataFrame:
    """A stream of Parquet files with one name pattern in a folder, at most ``per_batch`` files at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_batch).parquet(folder)


def _fresh(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/progress"


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run what is available into an append-only table and read it back."""
    spark = stream.sparkSession
    table, progress = _fresh(spark, name)
    run = (stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", progress)
           .trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)


def drain_upsert(stream: DataFrame, name: str, keys: list[str], order: list[Column], mode: str = "append") -> DataFrame:
    """Merge every micro-batch into a versioned table: newest row per key wins.

    A batch writes version n+1 from version n, so a batch that is run again after a
    failure rewrites the same version.
    """
    spark = stream.sparkSession
    table, progress = _fresh(spark, name)
    last = [-1]

    def merge(batch: DataFrame, n: int) -> None:
        both = batch
        if n > 0:
            both = batch.sparkSession.read.schema(stream.schema).parquet(f"{table}/v={n - 1}").unionByName(batch)
        upsert.newest(both, keys, order).write.mode("overwrite").parquet(f"{table}/v={n}")
        last[0] = n

    run = (stream.writeStream.outputMode(mode).foreachBatch(merge).option("checkpointLocation", progress).trigger(availableNow=True).start())
    run.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{table}/v={last[0]}")


SCHEDULE = "scheduled_id {key}, event_name string, is_title boolean, is_long boolean, is_cancelled boolean, first_seen bigint, last_updated bigint"


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _delete(spark: SparkSession, path: str) -> None:
    store, where = _place(spark, path)
    store.delete(where, True)


def _exists(spark: SparkSession, path: str) -> bool:
    store, where = _place(spark, path)
    return store.exists(where)


class ScheduleTable:
    """A schedule kept in parts by a hash of its key, each with the version that wrote it last.

    A version's manifest lists the version of every part.  A batch rewrites the parts that it touches and no others; if it
    runs again after a failure it reads the same manifest and writes the same version.  Files that neither the new
    manifest nor the one before it names are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, key_type: str, parts: int = 16) -> None:
        self.spark, self.folder, self.parts, self.schema = spark, folder, parts, SCHEDULE.format(key=key_type)

    def manifest(self, version: int) -> dict[int, int]:
        """Version by part; at most ``parts`` rows."""
        if version < 0:
            return {}
        return {r["part"]: r["version"] for r in self.spark.read.schema("part int, version int").json(f"{self.folder}/manifest/v={version}").collect()}

    def rows(self, manifest: dict[int, int], parts=None) -> DataFrame:
        paths = [f"{self.folder}/rows/v={v}/part={p}" for p, v in sorted(manifest.items()) if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, version: int) -> None:
        """Upsert a batch (scheduled_id, event_name, is_title, is_long, is_cancelled) as this version."""
        part = F.pmod(F.xxhash64("scheduled_id"), F.lit(self.parts)).cast("int").alias("part")
        before = self.manifest(version - 1)
        touched = {r["part"] for r in batch.select(part).distinct().collect()}
        merged = upsert.upsert_schedule(self.rows(before, touched), batch, F.lit(version).cast("long")).drop("is_new")
        merged.select("*", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/rows/v={version}")
        now = before | {p: version for p in touched}
        self.spark.createDataFrame(sorted(now.items()), "part int, version int").coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/v={version}")
        # a rerun of this version reads the manifest before it; what only older ones name is done with
        old = f"{self.folder}/manifest/v={version - 2}"
        if version > 1 and _exists(self.spark, old):
            for p, v in self.manifest(version - 2).items():
                if before.get(p) != v:
                    _delete(self.spark, f"{self.folder}/rows/v={v}/part={p}")
            _delete(self.spark, old)


def schedule_table(stream: DataFrame, name: str, parts: int = 16) -> DataFrame:
    """Merge every micro-batch of scheduled contests into a ``ScheduleTable``; its rows after the last batch.

    first_seen and last_updated are numbers of batches.
    """
    spark = stream.sparkSession
    folder, progress = _fresh(spark, name)
    last, key_type = [-1], dict(stream.dtypes)["scheduled_id"]

    def merge(batch: DataFrame, n: int) -> None:
        ScheduleTable(batch.sparkSession, folder, key_type, parts).merge(batch, n)
        last[0] = n

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    table = ScheduleTable(spark, folder, key_type, parts)
    return table.rows(table.manifest(last[0]))


def dedup_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First arrival per key; state is dropped once the watermark passes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_prices(quotes: DataFrame, time: str, keys: list[str], price: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Latest price, exact median and count per key and tumbling window."""
    return (quotes.withWatermark(time, delay).groupBy(F.window(time, size).alias("w"), *keys).agg(
        F.max_by(price, time).alias("latest"), F.median(price).alias("median"), F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "latest", "median", "n"))


class DriftState(StatefulProcessor):
    """Drift of one pool: of every window not yet closed its count, loss and last rows, and a ring of the last rows before."""

    def __init__(self, window_us: int, before_rows: int, least: tuple[int, int], alert_at: float) -> None:
        self.window_us, self.before_rows, self.least, self.alert_at = window_us, before_rows, least, alert_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start bigint", "n bigint, total double, tail binary")
        self.ring = handle.getValueState("ring", "tail binary")

    def _last(self, *parts: np.ndarray) -> np.ndarray:
        return np.sort(np.concatenate(parts), order=["at", "id"])[-self.before_rows:]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            start = frame["at"].to_numpy() // self.window_us * self.window_us
            row = np.rec.fromarrays([frame["at"].to_numpy(), frame["id"].to_numpy(), frame["loss"].to_numpy()], dtype=ROW)
            for s in np.unique(start).tolist():
                mine = row[start == s]
                n, total, tail = (self.windows.getValue((s,)) if self.windows.containsKey((s,)) else (0, 0.0, b""))
                self.windows.updateValue((s,), (int(n) + len(mine), float(total) + float(mine["loss"].sum()), self._last(np.frombuffer(tail, ROW), mine).tobytes()))
                self.handle.registerTimer((s + self.window_us) // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # timers of one batch may come in any order; windows close in the order of time
        closed = sorted(k[0] for k in self.windows.keys() if (k[0] + self.window_us) // 1000 <= timerValues.getCurrentWatermarkInMs())
        for s in closed:
            n, total, tail = self.windows.getValue((s,))
            before = np.frombuffer(self.ring.get()[0], ROW) if self.ring.exists() else np.zeros(0, ROW)
            recent, older = total / n, float(before["loss"].mean()) if len(before) else None
            enough = n >= self.least[0] and len(before) >= self.least[1]
            yield pd.DataFrame({"pool": [key[0]], "start": [s], "n_recent": [n], "recent": [recent], "n_before": [len(before)], "before": pd.Series([older], dtype="float64"),
                                "delta": pd.Series([recent - older if enough else None], dtype="float64"), "alert": [int(enough and recent - older > self.alert_at)]})
            self.ring.update((self._last(before, np.frombuffer(tail, ROW)).tobytes(),))
            self.windows.removeKey((s,))

    def close(self) -> None:
        pass


def drift(scored: DataFrame, time: str, pool: str, key: str, size_days: int = 7, delay: str = "1 hour", before_rows: int = 200, min_recent: int = 10, min_before: int = 50,
          alert_at: float = 0.05) -> DataFrame:
    """Log-loss of each pool and tumbling window against the last rows before the window, as ``metrics.drift`` has it.

    A window is reported once, when the watermark passes its end.  State is at most ``before_rows`` rows for each open
    window and for the ring, however many rows a pool has.  Rows later than the watermark are left out.
    """
    scored.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    loss = prob.log_loss(F.col("label"), F.col("p"))
    rows = scored.withWatermark(time, delay).select(time, F.col(pool).cast("string").alias("pool"), F.unix_micros(time).alias("at"), F.col(key).cast("long").alias("id"), loss.alias("loss"))
    kept = DriftState(size_days * 86_400_000_000, before_rows, (min_recent, min_before), alert_at)
    out = rows.groupBy("pool").transformWithStateInPandas(kept, "pool string, start long, n_recent long, recent double, n_before long, before double, delta double, alert int", "Append", "EventTime")
    return out.withColumn("start", F.timestamp_micros("start"))


class GradeState(StatefulProcessor):
    """Open predictions and recent results of one key."""

    def __init__(self, span_us: int) -> None:
        self.span_us = span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "at bigint, id bigint, said bigint")
        self.results = handle.getListState("results", "at bigint, id bigint, said bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for state, is_open, wait in ((self.open, True, self.span_us), (self.results, False, 0)):
                part = frame[frame["is_open"] == is_open]
                fresh = list(zip(part["at"].tolist(), part["id"].tolist(), part["said"].tolist()))
                if fresh:
                    state.appendList(fresh)
                    for at in {(at + wait) // 1000 + 1 for at, *_ in fresh}:
                        self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.open.get()) if self.open.exists() else []
        results = sorted(self.results.get()) if self.results.exists() else []
        times = [r[0] for r in results]
        done, left = [], []
        for at, i, said in waiting:
            k = bisect.bisect_left(times, at)
            first = results[k] if k < len(results) and times[k] <= at + self.span_us else None
            if first is not None and first[0] < now:
                # nothing earlier can come any more
                done.append((key[0], i, first[1], "won" if said == first[2] else "lost"))
            elif first is None and at + self.span_us < now:
                done.append((key[0], i, None, "ungraded"))
            else:
                left.append((at, i, said))
        keep = [r for r in results if r[0] >= now - self.span_us]
        for state, rest, was in ((self.open, left, waiting), (self.results, keep, results)):
            if len(rest) < len(was):
                state.put(rest) if rest else state.clear()
        if done:
            out = pd.DataFrame(done, columns=["key", "open_id", "settle_id", "grade"])
            yield out.astype({"settle_id": "Int64"})

    def close(self) -> None:
        pass


def graded(stream: DataFrame, time: str, key: str, span_hours: int, delay: str) -> DataFrame:
    """A grade for every prediction: key, open_id, settle_id, grade.

    ``stream`` has predictions and results (``is_open`` tells them apart), with an ``id`` and what they ``said``.  The first
    result of the key from the prediction's time until ``span_hours`` later decides: won if both said the same, else lost.
    It is given when the watermark has passed the result, so that arrival order does not matter; without a result the
    prediction is ungraded when the watermark has passed its span.  State holds what the watermark leaves open.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.withWatermark(time, delay).select(time, F.col(key).cast("long").alias("key"), F.unix_micros(time).alias("at"), F.col("id").cast("long").alias("id"), F.col("said").cast("long").alias("said"), "is_open")
    return rows.groupBy("key").transformWithStateInPandas(GradeState(span_hours * 3_600_000_000), "key long, open_id long, settle_id long, grade string", "Append", "EventTime")


class RatingState(StatefulProcessor):
    """Ratings of one pool: a map from entity to its state, updated contest by contest."""

    def __init__(self, id_type: str) -> None:
        self.id_type = id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("ratings", f"entity_id {self.id_type}", "elo double, n bigint, mu double, phi double, sigma double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one pool's part of a micro-batch is ordered before it is folded; the source's files per batch bound it
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["dt", "contest_id"])
        known = {}
        for e in {*batch["a_id"].tolist(), *batch["b_id"].tolist()}:
            if self.states.containsKey((e,)):
                s = self.states.getValue((e,))
                known[e] = (s[0], int(s[1]), s[2], s[3], s[4])
        # contests leave Python's lists and the task slice by slice
        for start in range(0, len(batch), SLICE):
            part = batch.iloc[start:start + SLICE]
            ids = zip(*(part[c].tolist() for c in ("contest_id", "a_id", "b_id")), part["label"].astype(float).tolist())
            out = pd.DataFrame(ratings.fold(ids, known), columns=["contest_id", *ratings.RATINGS])
            out.insert(0, "pool", key[0])
            yield out
        for e, s in known.items():
            self.states.updateValue((e,), (float(s[0]), int(s[1]), float(s[2]), float(s[3]), float(s[4])))

    def close(self) -> None:
        pass


def rating_stream(contests: DataFrame) -> DataFrame:
    """Pre-contest ratings of a stream of contests (contest_id, dt, pool, a_id, b_id, label) in day order.

    Ids are whole numbers or text.
    """
    contests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = dict(contests.dtypes)
    schema = f"pool string, contest_id {kinds['contest_id']}, " + ", ".join(f"{c} double" for c in ratings.RATINGS)
    return contests.groupBy("pool").transformWithStateInPandas(RatingState(kinds["a_id"]), schema, "Append", "None")


def snapshots(rows: DataFrame, stamp: str, name: str) -> DataFrame:
    """Append-only snapshot table partitioned by its stamp."""
    spark = rows.sparkSession
    table, progress = _fresh(spark, name)
    run = (rows.withColumn("snapshot", F.lit(stamp)).writeStream.format("parquet").partitionBy("snapshot").option("path", table)
           .option("checkpointLocation", progress).trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.parquet(table)


