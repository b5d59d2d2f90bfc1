"""Per-key state machines with timers on ``transformWithState``: back-off holds, remembered failures, route learning, watches
of content, job heartbeats.

Each processor folds the rows of its key in event-time order and keeps a small state: one value, in which a key's routes or
pages are a list, and a timer. What a key costs is its calls to the state, each answered by another process: one value is
read and written once a micro-batch, it tells whether a timer is set, and rows come and go as rows, not as a data frame a key.
A micro-batch of one key is sorted in its task; the trigger bounds it. Rows must not be later than the watermark. State lives
in RocksDB, so it may outgrow memory, and survives restarts from the checkpoint.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.scratch import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = "10 minutes"

# Fixed values, in seconds.
FIRST_STRIKE, STRIKE_MEMORY, MOST_RETRY_AFTER, COOLDOWN = 30, 1800, 3600, 900
FAILURE_MEMORY = 600
ROUTE_TTL, ROUTE_HALF_LIFE = 86_400, 43_200
ORPHAN_AFTER = 300


def in_order(rows: Iterator[Row]) -> list[Row]:
    """The rows of a key by time, ties by ``tie``, null last."""
    return sorted(rows, key=lambda r: (r.s, r.tie is None, r.tie))


class Backoff(StatefulProcessor):
    """Holds after refusals: input s, tie, why (limited, server or after), wait; output until, strikes, struck_at.

    A named delay is honoured up to an hour, a server error pauses the first strike's length, and each strike within half
    an hour of the last waits four times longer, up to a quarter of an hour. A hold is never shortened.
    """

    OUTPUT = "k bigint, until bigint, strikes int, struck_at bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("hold", "until bigint, strikes int, struck_at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        until, strikes, struck = self.state.get() or (0, 0, 0)
        for r in in_order(rows):
            if r.s - struck > STRIKE_MEMORY:
                strikes = 0
            if r.why == "after":
                wait = min(max(1, int(r.wait)), MOST_RETRY_AFTER)
            elif r.why == "server":
                wait = FIRST_STRIKE
            else:
                strikes, struck = strikes + 1, int(r.s)
                wait = min(FIRST_STRIKE * 4 ** (strikes - 1), COOLDOWN)
            until = max(until, int(r.s) + wait)
        self.state.update((until, strikes, struck))
        yield Row(k=key[0], until=until, strikes=strikes, struck_at=struck)

    def close(self) -> None:
        pass


class FailureMemory(StatefulProcessor):
    """Requests that a remembered failure answers: input s, tie, what (failed, passed or asked); output asked, answered.

    A failure is remembered for ten minutes or until a page came through; its timer clears the state.
    """

    OUTPUT = "k bigint, asked bigint, answered bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "at bigint, asked bigint, answered bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        at, asked, answered = self.memory.get() or (None, 0, 0)
        was = at  # a timer is set if and only if a failure is remembered
        for r in in_order(rows):
            if r.what == "failed":
                at = int(r.s)
            elif r.what == "passed":
                at = None
            else:
                asked += 1
                answered += at is not None and at > r.s - FAILURE_MEMORY
        self.memory.update((at, asked, answered))
        if at != was:
            if was is not None:
                self.handle.deleteTimer((was + FAILURE_MEMORY) * 1000)
            if at is not None:
                self.handle.registerTimer((at + FAILURE_MEMORY) * 1000)
        yield Row(k=key[0], asked=asked, answered=answered)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        _, asked, answered = self.memory.get()
        self.memory.update((None, asked, answered))
        yield from ()

    def close(self) -> None:
        pass


class Routes(StatefulProcessor):
    """What each route of a key is worth: input s, tie, route, feedback (useful, delivered or failed), ms.

    Successes halve every 12 hours and count again at once; a failure halves at most four of them and adds to the failures,
    which any other answer clears; latency moves by three tenths. A route not heard of for a day is forgotten.
    """

    OUTPUT = "k bigint, routes array<struct<route:string,successes:double,failures:double,ms:double>>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("routes", "known array<struct<route:string,successes:double,failures:double,ms:double,updated:bigint>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = {k: tuple(v) for k, *v in (self.state.get() or ([],))[0]}
        for r in in_order(rows):
            now = math.nan if r.ms is None else r.ms
            for stale in [k for k, v in known.items() if r.s - v[3] > ROUTE_TTL]:
                del known[stale]
            good, bad, ms, updated = known.get(r.route, (0.0, 0.0, now, r.s))
            decay = 0.5 ** ((r.s - updated) / ROUTE_HALF_LIFE)
            good = good * decay + (r.feedback == "useful")
            failed = r.feedback == "failed"
            bad = bad * decay + 1 if failed else 0.0
            known[r.route] = (min(good, 4.0) * 0.5 if failed else good, bad, ms * 0.7 + now * 0.3, r.s)
        self.state.update(([(k, *v) for k, v in known.items()],))
        yield Row(k=key[0], routes=[Row(route=k, successes=v[0], failures=v[1], ms=v[2]) for k, v in sorted(known.items())])

    def close(self) -> None:
        pass


class Watches(StatefulProcessor):
    """Pages of a site under watch: input s, tie, page, digest; output for each page its checks, changes and last change.
    The first sight of a page is no change."""

    OUTPUT = "k bigint, pages array<struct<page:string,checks:bigint,changes:bigint,changed_at:bigint>>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pages", "known array<struct<page:string,digest:bigint,checks:bigint,changes:bigint,changed_at:bigint>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = {k: tuple(v) for k, *v in (self.state.get() or ([],))[0]}
        for r in in_order(rows):
            digest, checks, changes, at = known.get(r.page, (None, 0, 0, None))
            changed = digest is not None and digest != r.digest
            known[r.page] = (int(r.digest), checks + 1, changes + changed, int(r.s) if changed else at)
        self.state.update(([(k, *v) for k, v in known.items()],))
        yield Row(k=key[0], pages=[Row(page=k, checks=v[1], changes=v[2], changed_at=v[3]) for k, v in sorted(known.items())])

    def close(self) -> None:
        pass


class Heartbeats(StatefulProcessor):
    """Jobs whose heartbeat stopped: input s, tie; output a row for each time that five minutes passed without one, told by
    the timer or by the beat that came too late."""

    OUTPUT = "k bigint, orphaned_at bigint, beats bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, beats bigint, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        at, beats, told = self.last.get() or (None, 0, False)
        if at is not None and not told:
            self.handle.deleteTimer(self.due(at))
        for r in in_order(rows):
            if at is not None and not told and r.s - at > ORPHAN_AFTER:
                yield Row(k=key[0], orphaned_at=at + ORPHAN_AFTER, beats=beats)
            at, beats, told = int(r.s), beats + 1, False
        self.handle.registerTimer(self.due(at))
        self.last.update((at, beats, told))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at, beats, told = self.last.get()
        self.last.update((at, beats, True))
        if not told:
            yield Row(k=key[0], orphaned_at=at + ORPHAN_AFTER, beats=beats)

    @staticmethod
    def due(at: int) -> int:
        """The first whole second of the watermark past the five minutes."""
        return (at + ORPHAN_AFTER + 1) * 1000

    def close(self) -> None:
        pass


def in_turns(rows: DataFrame, processor: StatefulProcessor, mode: str = "update", turns: int = 3) -> DataFrame:
    """The sink's rows with their ``epoch``, after a stream that was stopped and started again between ``turns`` stretches
    of event time. ``rows``: k (the key), at (a timestamp), s (its second), tie and what the processor reads."""
    spark: SparkSession = rows.sparkSession
    path = f"{shared_dir(spark)}/tidemark/state-{uuid.uuid4().hex}"
    cuts = rows.agg(F.percentile_approx("s", [k / turns for k in range(1, turns)], 1000).alias("q")).first()["q"] or []
    edges = [None, *cuts, None]
    had = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    try:
        for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            part = rows if low is None else rows.filter(F.col("s") >= low)
            (part if high is None else part.filter(F.col("s") < high)).write.parquet(f"{path}/in/turn={k}")
            seen = spark.readStream.schema(StructType([*rows.schema.fields, StructField("turn", IntegerType())])).parquet(f"{path}/in").drop("turn").withWatermark("at", WATERMARK)
            out = seen.groupBy("k").transformWithState(processor, processor.OUTPUT, mode, "eventTime")
            q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).foreachBatch(put).start()
            q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, had) if had else spark.conf.unset(PROVIDER)
    return spark.read.schema(f"{processor.OUTPUT}, epoch bigint").option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def latest(rows: DataFrame) -> DataFrame:
    """One row a key: what its last epoch said."""
    rest = [c for c in rows.columns if c not in ("k", "epoch")]
    return rows.groupBy("k").agg(F.max_by(F.struct(*rest), "epoch").alias("last")).select("k", "last.*")


