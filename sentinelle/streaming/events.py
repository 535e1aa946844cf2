"""Streams of observations: dedup within a watermark, windows, and per-type state.

The same transformations work on batches; a stream adds a watermark, which bounds what must be remembered. Rows later
than the watermark are left to the next batch correlation.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from sentinelle.operators.desk import Desk
from sentinelle.operators.desk import reports as in_order
from sentinelle.sources import readers

#: Microseconds by which a report may come late.
LATE = 48 * 3_600_000_000

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Files of events as they land; the rate limit stands for the queue's capacity."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "48 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, size: str = "6 hours", slide: str | None = None, late: str = "48 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "48 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def running_incidents(events: DataFrame, gap_seconds: int = 6 * 3600) -> DataFrame:
    """Incidents of each type and user as they grow: a new one opens after `gap_seconds` without a report.

    State is one row a key: when the last report came, how many the incident has, and its number.
    """

    def step(key, frames: Iterator[pd.DataFrame], state):
        last, n, number = state.get if state.exists else (0.0, 0, 0)
        for f in frames:
            for t in sorted(f["ts"].astype("int64") / 1e9 if f["ts"].dtype.kind != "M" else f["ts"].astype("datetime64[us]").astype("int64") / 1e6):
                if n == 0 or t - last > gap_seconds:
                    number, n = number + 1, 0
                last, n = max(last, t), n + 1
        state.update((float(last), int(n), int(number)))
        yield pd.DataFrame({"event_type": [key[0]], "user_id": [key[1]], "incident": [number], "reports": [n]})

    return events.groupBy("event_type", "user_id").applyInPandasWithState(step, "event_type string, user_id long, incident long, reports long", "last double, n long, number long", "update", "NoTimeout")


def bundle_items(spark: SparkSession, folder: str, now, memory: str = "14 days", files_per_batch: int = 8) -> DataFrame:
    """Items of bundles as their files land: those without a fault, each URL once for as long as `memory` lasts."""
    files = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(folder)
    items = readers.accepted(files, now).select("file", F.col("collectedAt").alias("at"), F.explode("items").alias("i"))
    good = items.where(readers.item_reason(F.col("i"), now).isNull()).select("file", "at", "i.*")
    return good.withWatermark("at", memory).dropDuplicatesWithinWatermark(["url"])


def observed(reports: DataFrame, name: str = "pipeline") -> DataFrame:
    """`reports`, counted as they pass, whatever is then done with them: see `Counters`."""
    of = lambda status: F.count_if(F.col("status") == status)
    return reports.observe(name, F.count(F.lit(1)).alias("processed"), of("Failed").alias("failed"), of("Duplicate").alias("duplicates"), of("HeldForCorroboration").alias("held"))


class Counters(StreamingQueryListener):
    """Sums of what `observed` counted in every micro-batch, and how many rows and milliseconds each one took."""

    def __init__(self, name: str = "pipeline"):
        self.name, self.totals, self.batches = name, {}, []

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        row = progress.observedMetrics.get(self.name)
        self.batches.append((progress.numInputRows, progress.batchDuration))
        for key, n in row.asDict().items() if row is not None else ():
            self.totals[key] = self.totals.get(key, 0) + n

    def onQueryStarted(self, event) -> None:  # noqa: N802
        """Nothing is counted yet."""

    def onQueryIdle(self, event) -> None:  # noqa: N802
        """Nothing has passed."""

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        """The sums stay."""


#: State in the RocksDB store, which map states and timers need.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "id long, incident long, score double, how string"


class DeskState(StatefulProcessor):
    """The desk of one type: an entry for each open incident and each held claim, of which a batch writes what it changed."""

    def __init__(self, window: int, late: int):
        self.window, self.late = window, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.incidents = handle.getMapState("incidents", "n long", "body binary")
        self.claims = handle.getMapState("claims", "id long", "body binary")
        self.clock = handle.getValueState("clock", "count long, newest long")

    def desk(self) -> tuple[Desk, int]:
        desk = Desk(self.window)
        desk.count, newest = self.clock.get() if self.clock.exists() else (0, None)
        for (n,), (body,) in self.incidents.iterator():
            desk.incidents[n] = pickle.loads(body)
            desk.opened.append((desk.incidents[n].first.occurred, -n))
        for (i,), (body,) in self.claims.iterator():
            desk.claims[i] = pickle.loads(body)
            desk.held.append((desk.claims[i].occurred, desk.claims[i].received, i))
        desk.opened.sort()
        desk.held.sort()
        return desk, newest

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        desk, newest = self.desk()
        before = set(desk.incidents), set(desk.claims)
        found = pd.concat(list(rows)).sort_values(["received", "id"])
        out, touched = [], set()
        for r in in_order(found):
            if newest is not None and r.occurred < newest - 2 * self.late:
                # What it could have met is forgotten: it is left to the next batch correlation.
                out.append((r.id, None, None, "late"))
                continue
            settled = desk.take(r)
            out += settled
            touched |= {incident for _, incident, _, _ in settled}
            newest = r.received if newest is None else max(newest, r.received)
        if newest is not None:
            out += [(i, None, None, "expired") for i, *_ in desk.forget(newest - 2 * self.late)]
            self.clock.update((desk.count, newest))
        for n, known in desk.incidents.items():
            if known.first.id in touched:
                self.incidents.updateValue((n,), (pickle.dumps(known),))
        for i in desk.claims.keys() - before[1]:
            self.claims.updateValue((i,), (pickle.dumps(desk.claims[i]),))
        for n in before[0] - desk.incidents.keys():
            self.incidents.removeKey((n,))
        for i in before[1] - desk.claims.keys():
            self.claims.removeKey((i,))
        self.wake(desk)
        yield self.rows(out)

    def wake(self, desk: Desk) -> None:
        """A timer for when the oldest claim can no longer be reached, should no report of its type come before."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if desk.held:
            self.handle.registerTimer((desk.held[0][0] + 2 * self.late + 2 * self.window) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        desk, _ = self.desk()
        before = set(desk.incidents), set(desk.claims)
        gone = desk.forget(timerValues.getCurrentWatermarkInMs() * 1000 - 2 * self.late)
        for n in before[0] - desk.incidents.keys():
            self.incidents.removeKey((n,))
        for i in before[1] - desk.claims.keys():
            self.claims.removeKey((i,))
        self.wake(desk)
        yield self.rows([(i, None, None, "expired") for i, *_ in gone])

    @staticmethod
    def rows(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["id", "incident", "score", "how"]).astype({"id": "int64", "incident": "Int64", "score": float, "how": object})

    def close(self) -> None:
        """Nothing is held beside the state."""


def correlated(reports: DataFrame, window: int, late: int = LATE) -> DataFrame:
    """Reports settled into incidents as they arrive: (id, incident, score, how), held claims once they are released.

    Reports of a micro-batch are taken in order of arrival; a source that delivers files in that order gives what
    `correlate.correlated` gives. What occurred more than twice `late` before the newest arrival is forgotten: claims
    among it come out as expired, also without another report once the watermark has passed, and reports from before
    it as late, to be settled by the next batch correlation. A report that was received more than `late` before the newest
    one of all types is behind the watermark, where Spark drops it.
    """
    reports.sparkSession.conf.set(*STORE)
    timed = reports.withColumn("_at", F.timestamp_micros("received")).withWatermark("_at", f"{late // 1_000_000} seconds")
    return timed.groupBy("event_type").transformWithStateInPandas(DeskState(window, late), _OUT, "Append", "EventTime")


def land(stream: DataFrame, folder: str, checkpoint: str, failed: str | None = None, reason: str = "reject_reason"):
    """Writes each micro-batch once: rows with a reason go to `failed`, the rest to `folder`, by batch number."""

    def batch(df: DataFrame, number: int) -> None:
        df.where(F.col(reason).isNull()).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if failed:
            df.where(F.col(reason).isNotNull()).write.mode("overwrite").parquet(f"{failed}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
