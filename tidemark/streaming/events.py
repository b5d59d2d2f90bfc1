"""Structured Streaming over the event table: windows, deduplication and per-key state machines."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.scratch import shared_dir


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream, event time in ``at``, ten minutes late at most."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "10 minutes")


def ticked(spark: SparkSession, sf_dir: str, after: str = "1 day") -> DataFrame:
    """:func:`stream` with one row more, of no user and no type, so long after the last event that every window before it
    closes: what append mode would hold back at the end of a table comes out."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = f"{shared_dir(spark)}/tidemark/tick-{uuid.uuid4().hex}"
    last = events.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).cast(events.schema["ts"].dataType).alias("ts"))
    last.select(*[F.col("ts") if c == "ts" else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns]).write.parquet(path)
    tick = spark.readStream.schema(events.schema).parquet(path)
    rows = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.unionByName(tick).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "10 minutes")


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return the sink's rows; sink and offsets in the shared folder.

    In update mode rows carry their ``epoch``, and :func:`newest` keeps the last of each key. In complete mode each epoch
    holds the whole result and the last one counts; nothing leaves the state, so it is for small results.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    last = 0

    def put(batch: DataFrame, epoch: int) -> None:
        nonlocal last
        last = epoch
        batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    rows = spark.read.schema(df.schema.add("epoch", "long")).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.filter(F.col("epoch") == last)
    return rows if mode == "update" else rows.drop("epoch")


def newest(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a key: what its last epoch said."""
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    last = F.max_by(F.struct(*rest), "epoch").alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    w = F.window("at", width)
    return events.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.window("at", width, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    s = events.groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"])


def admission(events: DataFrame, limit: int = 12, window_s: int = 3600) -> DataFrame:
    """Per user the count of admitted and held visits: at most ``limit`` admitted in any trailing window.

    The state of a user is at most ``limit`` times and two counts. A user without events for a day is forgotten.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, admitted, held = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0, 0)
        for at in sorted(pd.concat(frames)["s"]):
            kept = [t for t in kept if t > at - window_s]
            if len(kept) < limit:
                kept.append(int(at))
                admitted += 1
            else:
                held += 1
        state.update((kept, admitted, held))
        state.setTimeoutTimestamp(max(max(kept, default=0) * 1000 + 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "admitted": [admitted], "held": [held]})

    rows = events.select("user_id", "at", F.unix_seconds("at").alias("s"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, admitted bigint, held bigint", "kept array<bigint>, admitted bigint, held bigint", "update", GroupStateTimeout.EventTimeTimeout)
