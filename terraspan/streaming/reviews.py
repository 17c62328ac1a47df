"""The review queue as a state machine over a stream of events.

An event (candidate, event id, time, number, action) enqueues a candidate,
decides on it or archives it.  Events of a candidate take effect in order of
time, whatever order they come in: they wait in its state until the watermark
has passed them.  So a replay either meets its like among the waiting ones, or
is behind the watermark and late.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from terraspan.operators.review import DECISIONS

#: Actions besides the decisions, and why an event is refused.
ENQUEUED, ARCHIVED = "ENQUEUED", "ARCHIVED"
NOT_FOUND, EXISTS, CLOSED, UNKNOWN = "NOT_FOUND", "ALREADY_QUEUED", "ARCHIVED", "UNKNOWN_ACTION"
#: The setting without which Spark keeps no such state.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

STEP = "event_id string, ts timestamp, seq long, action string, from_status string, to_status string, accepted boolean, reason string, step long"


def refusal(status: str | None, action: str | None) -> str | None:
    """Why an action can't be taken in a status (None: not queued yet)."""
    if action not in (ENQUEUED, ARCHIVED, *DECISIONS):
        return UNKNOWN
    if action == ENQUEUED:
        return None if status is None else EXISTS
    return NOT_FOUND if status is None else CLOSED if status == ARCHIVED else None


class Review(StatefulProcessor):
    """Keeps a candidate's status and steps, and the events that wait."""

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, step long")
        self.waiting = handle.getListState("waiting", "event_id string, ts timestamp, seq long, action string, ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        have = {(r[0], r[4]) for r in self.waiting.get()}
        first, new = min((ms for _, ms in have), default=None), []
        for r in rows:
            if (r.event_id, r.ms) not in have:
                have.add((r.event_id, r.ms))
                new.append((r.event_id, r.ts, r.seq, r.action, r.ms))
        if new:
            self.waiting.appendList(new)
            soonest = min(r[4] for r in new)
            if first is None or soonest < first:  # one timer: the earliest waiting event's
                self.handle.registerTimer(soonest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in held if r[4] <= until), key=lambda r: (r[4], r[1], r[2], r[0]))
        if not due:
            return
        rest = [r for r in held if r[4] > until]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[4] for r in rest))
        else:
            self.waiting.clear()
        status, step = tuple(self.now.get()) if self.now.exists() else (None, 0)
        for event_id, ts, seq, action, _ in due:
            reason = refusal(status, action)
            to = status if reason else action
            step += not reason
            yield Row(candidate_id=key[0], event_id=event_id, ts=ts, seq=seq, action=action, from_status=status, to_status=to, accepted=reason is None, reason=reason, step=step)
            status = to
        if step:
            self.now.update((status, step))


def steps(events: DataFrame, delay: str = "1 hour", key: str = "candidate_id") -> DataFrame:
    """What becomes of each event of a stream (key, event_id, ts, seq, action),
    as soon as the watermark has passed it: its status before and after, or
    why it is refused.  Events without key, id or time are left out."""
    spark = events.sparkSession
    spark.conf.set(*STORE)
    kind = events.schema[key].dataType.simpleString()
    known = events.where(F.col(key).isNotNull() & F.col("event_id").isNotNull() & F.col("ts").isNotNull()).select(
        F.col(key).alias("candidate_id"), F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "action",
    ).withColumn("ms", F.unix_millis("ts"))
    return known.withWatermark("ts", delay).groupBy("candidate_id").transformWithState(
        Review(), f"candidate_id {kind}, {STEP}", outputMode="append", timeMode="eventTime"
    ).withColumnRenamed("candidate_id", key)


def keep_steps(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", key: str = "candidate_id") -> StreamingQuery:
    """Appends the steps to a Parquet log, exactly once, and stops when all
    present input is read; what is above the watermark waits for the next run."""
    return (
        steps(events, delay, key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def steps_of_log(events: DataFrame, key: str = "candidate_id") -> DataFrame:
    """The same for a finished log, by windows: a candidate is queued by its
    first ENQUEUED and closed by the first ARCHIVED behind that."""
    known = events.where(F.col(key).isNotNull() & F.col("event_id").isNotNull() & F.col("ts").isNotNull()).select(
        key, F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "action"
    ).dropDuplicates([key, "event_id", "ts"])
    order = W.partitionBy(key).orderBy(F.unix_millis("ts"), "ts", "seq", "event_id")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    df = known.withColumn("queued", F.coalesce(F.max(F.col("action") == ENQUEUED).over(before), F.lit(False)))
    df = df.withColumn("closed", F.coalesce(F.max((F.col("action") == ARCHIVED) & F.col("queued")).over(before), F.lit(False)))
    first = F.col("action") == ENQUEUED
    reason = F.when(~F.coalesce(F.col("action").isin(ENQUEUED, ARCHIVED, *DECISIONS), F.lit(False)), UNKNOWN).when(first & F.col("queued"), EXISTS)
    reason = reason.when(~first & ~F.col("queued"), NOT_FOUND).when(~first & F.col("closed"), CLOSED)
    df = df.withColumn("reason", reason)
    taken = F.when(F.col("reason").isNull(), F.col("action"))
    return df.select(
        key, "event_id", "ts", "seq", "action", F.last(taken, ignorenulls=True).over(before).alias("from_status"),
        F.last(taken, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("to_status"), F.col("reason").isNull().alias("accepted"), "reason",
        F.count(taken).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("step"),
    )
