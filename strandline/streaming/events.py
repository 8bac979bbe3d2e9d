"""Streaming bars, sessions and holds over an event stream (ts, user_id, event_type, value)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The state store that timers and list states need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_bars(events: DataFrame, width: str = "1 day", slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Tumbling (or sliding) bars per event type; events later than the watermark are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    g = events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("high"), F.min("value").alias("low"), F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total", "high", "low", "open", "close")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Sessions per user: start, end, events and value."""
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    g = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def held_signals(events: DataFrame, threshold: float, hold: int) -> DataFrame:
    """A value above the threshold holds a user's signal for so many events; values within a hold are passed over.

    A trigger's events of a user are folded in order of time, however many Arrow batches they come in; an event that is
    late by a trigger counts when it arrives.
    """

    def run(key, batches, state: GroupState):
        left, out = state.get[0] if state.exists else 0, []
        b = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # what one user did within a trigger
        for v in b["value"]:
            out.append(left > 0 or v > threshold)
            left = left - 1 if left > 0 else (hold - 1 if v > threshold else 0)
        state.update((left,))
        yield pd.DataFrame({"user_id": b["user_id"].to_numpy(), "event_id": b["event_id"].to_numpy(), "held": out})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, held boolean", "rows int", "append", GroupStateTimeout.NoTimeout)


class OrderedHolds(StatefulProcessor):
    """Keeps a user's events until the watermark has passed them, then folds them in order of time.

    State per user: what waits (the events between the watermark and the newest) and how many rows the hold still lasts. One
    timer per user stands at the first event that waits.
    """

    def __init__(self, threshold: float, hold: int) -> None:
        self.threshold, self.hold = threshold, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, value double")
        self.left = handle.getValueState("left", "rows int")

    def _alarm(self, first: int) -> None:
        """Moves the user's timer to the first event that waits."""
        at = first // 1000  # timers are in milliseconds
        for old in list(self.handle.listTimers()):
            if old <= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for b in rows:
            us = pd.to_datetime(b["ts"]).astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(us.tolist(), b["event_id"].tolist(), [None if pd.isna(v) else float(v) for v in b["value"]], strict=True)))
            first = int(us.min()) if first is None else min(first, int(us.min()))
        if first is not None:
            self._alarm(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        waits = sorted((tuple(w) for w in self.waiting.get()), key=lambda w: w[:2])
        ready = [w for w in waits if w[0] <= watermark]
        rest = waits[len(ready) :]
        left, held = self.left.get()[0] if self.left.exists() else 0, []
        for _, _, v in ready:
            starts = left == 0 and v is not None and v > self.threshold
            held.append(left > 0 or starts)
            left = left - 1 if left > 0 else (self.hold - 1 if starts else 0)
        self.left.update((left,))
        if rest:
            self.waiting.put(rest)
            self._alarm(rest[0][0])
        else:
            self.waiting.clear()
        if ready:
            yield pd.DataFrame({"user_id": key[0], "event_id": [w[1] for w in ready], "held": held})

    def close(self) -> None:
        pass


def ordered_holds(events: DataFrame, threshold: float, hold: int, lateness: str = "1 day") -> DataFrame:
    """held_signals() by event time: an event counts at its place in time, whichever trigger brought it.

    Events are let go once the watermark (the newest time of the triggers before, less ``lateness``) reaches them; what comes behind
    events that were let go is left out, so what has been let go is what one batch over the same events gives. Ties in time go by event_id, null values
    never start a hold, events without a time are left out. State grows with the events of a user within the lateness. Needs the
    RocksDB state store (run_once(..., state_store=ROCKSDB), or the session's setting).
    """
    e = events.where("ts is not null").select("user_id", "event_id", "ts", F.col("value").cast("double").alias("value")).withWatermark("ts", lateness)
    return e.groupBy("user_id").transformWithStateInPandas(OrderedHolds(threshold, hold), "user_id long, event_id long, held boolean", "append", "eventTime")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", state_store: str | None = None) -> DataFrame:
    """The stream's result over all that is there now, as a view of that name. state_store: the provider for this query alone.

    The tasks write the rows as Parquet beside the checkpoint (``<checkpoint>-rows``, which must be as shared as that one), so the
    driver holds none of them. In append mode each trigger adds its rows, once even if it is run again; in complete mode, the
    only other one, a trigger's table takes the place of the one before.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"mode {mode!r} is neither append nor complete")
    spark, path = stream.sparkSession, f"{checkpoint.rstrip('/')}-rows"
    setting, conf = "spark.sql.streaming.stateStore.providerClass", spark.conf
    before = conf.get(setting, None)
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(path)  # where no trigger runs
    w = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.format("parquet").option("path", path) if mode == "append" else w.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
    if state_store is not None:
        conf.set(setting, state_store)
    try:
        q = w.start()
        q.awaitTermination()
    finally:
        if state_store is not None:
            conf.unset(setting) if before is None else conf.set(setting, before)
    if q.exception() is not None:
        raise q.exception()
    spark.read.schema(stream.schema).parquet(path).createOrReplaceTempView(name)
    return spark.table(name)
