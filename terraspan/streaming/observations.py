"""Streaming variants: audit append, daily windows, deduplication.

The same expressions as in batch; times without zone are read as UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terraspan.operators.review import DECISIONS


def read_events(spark: SparkSession, path: str, schema, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A stream of Parquet files with a watermark on ``ts``."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def daily_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events per day and kind; late rows within the watermark count."""
    g = events.groupBy(F.window(ts, "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("day"), kind, "n", "total")


def distinct_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event once, as far back as the watermark reaches."""
    return events.dropDuplicatesWithinWatermark([key])


def append_audit(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends new events to a Parquet log, exactly once, and stops when all
    present input is written."""
    return (
        events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def latest_decisions(events: DataFrame, key: str = "candidate_id") -> DataFrame:
    """The state of each candidate over a stream of decisions (key, ts, seq,
    decision): the last allowed one by time, whatever order they come in."""
    allowed = events.where(F.col("decision").isin(*DECISIONS))
    return allowed.groupBy(key).agg(F.max_by("decision", F.struct("ts", "seq")).alias("decision"), F.max("ts").alias("decided_at"), F.count(F.lit(1)).alias("decisions"))


def keep_decisions(events: DataFrame, path: str, checkpoint: str, key: str = "candidate_id") -> StreamingQuery:
    """Writes the candidates that a micro-batch changes, with their new state,
    to ``path``/batch=N, and stops when all present input is read.  A batch
    that runs again replaces its own folder, so states are kept exactly once."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    states = latest_decisions(events, key)
    return states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decided(spark: SparkSession, path: str, key: str = "candidate_id") -> DataFrame:
    """The newest state of each candidate that ``keep_decisions`` has written."""
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(*[F.max_by(c, "batch").alias(c) for c in fields])
