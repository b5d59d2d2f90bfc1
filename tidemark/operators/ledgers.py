"""Per-key folds over time whose past fades or composes, so that a hot key is not one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(events: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows of each key, with ``back`` = 1 for the newest. Spark keeps n rows a key in each task before
    it shuffles."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def ewma(events: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.3, tail: int = 128) -> DataFrame:
    """(key, ewma): s = (1 - alpha) s + alpha x, from the first value. A value that is ``tail`` events old weighs
    (1 - alpha) ** tail, below what a double resolves, so the newest ``tail`` events are all that count."""
    rows = newest(events.select(key, *order, value), key, order, tail)
    rows = rows.withColumn("first", F.col("back") == F.max("back").over(Window.partitionBy(key)))
    weight = F.pow(F.lit(1 - alpha), F.col("back") - 1) * F.when(F.col("first"), 1.0).otherwise(alpha)
    return rows.groupBy(key).agg(F.sum(weight * F.col(value)).alias("ewma"))


def engine_health(events: DataFrame, key: str, order: list[str], outcome: str, tail: int = 400) -> DataFrame:
    """(key, health): from 0.5, ``ok`` h * 0.7 + 0.3, ``useless`` h * 0.9, else h * 0.6. The start and what is more than
    ``tail`` events old weigh less than 0.9 ** tail."""
    rows = newest(events.select(key, *order, outcome), key, order, tail)
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), F.col(outcome).alias("x")))), lambda x: x["x"])
    fold = F.aggregate(listed, F.lit(0.5), lambda h, x: F.when(x == "ok", h * 0.7 + 0.3).when(x == "useless", h * 0.9).otherwise(h * 0.6))
    return rows.groupBy(key).agg(fold.alias("health"))


def session_health(events: DataFrame, key: str, at: str, tie: str, delta: Column, idle_s: int = 600, parts: int | None = None) -> DataFrame:
    """(key, health): from 100, +1 for each idle ``idle_s`` seconds up to 100, then ``delta``, within 0 and 100.

    Every event maps health by adding and clamping, and so does any run of events: (add, low, high). Runs are folded by
    ranges of time, of which there are some times the shuffle partitions, and a key's few runs are composed.
    """
    parts = parts or 4 * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = events.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    width = max(1, ((ends["b"] or 0) - (ends["a"] or 0)) // parts + 1)
    rows = events.select(key, F.col(at).alias("at"), F.col(tie).alias("tie"), delta.cast("double").alias("d"), F.floor((F.col(at) - F.lit(ends["a"] or 0)) / width).alias("part"))

    def clamp(x: Column, low: Column, high: Column) -> Column:
        return F.greatest(low, F.least(high, x))

    def then(m: Column, add: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
        return m["add"] + add, clamp(m["low"] + add, low, high), clamp(m["high"] + add, low, high)

    def as_map(add: Column, low: Column, high: Column, at: Column) -> Column:
        return F.struct(add.alias("add"), low.alias("low"), high.alias("high"), at.alias("at"))

    def step(m: Column, x: Column) -> Column:
        idle = F.coalesce(F.floor((x["at"] - m["at"]) / idle_s).cast("double"), F.lit(0.0))
        rested = as_map(*then(m, idle, F.lit(-1e9), F.lit(100.0)), x["at"])
        return F.get(F.transform(F.array(rested), lambda r: as_map(*then(r, x["d"], F.lit(0.0), F.lit(100.0)), r["at"])), F.lit(0))

    none = as_map(F.lit(0.0), F.lit(-1e9), F.lit(1e9), F.lit(None).cast("bigint"))
    runs = rows.groupBy(key, "part").agg(F.min("at").alias("first"), F.aggregate(F.array_sort(F.collect_list(F.struct("at", "tie", "d"))), none, step).alias("m"))
    listed = F.array_sort(F.collect_list(F.struct("part", "first", "m")))
    start = F.struct(F.lit(100.0).alias("h"), F.lit(None).cast("bigint").alias("at"))

    def join(s: Column, r: Column) -> Column:
        idle = F.coalesce(F.floor((r["first"] - s["at"]) / idle_s).cast("double"), F.lit(0.0))
        return F.struct(clamp(F.least(F.lit(100.0), s["h"] + idle) + r["m"]["add"], r["m"]["low"], r["m"]["high"]).alias("h"), r["m"]["at"].alias("at"))

    return runs.groupBy(key).agg(F.aggregate(listed, start, join, lambda s: s["h"]).alias("health"))


def upsert(versions: DataFrame, key: str, at: str, digest: str, keep: int = 20) -> DataFrame:
    """(key, at, digest, current): what a store holds after the rows are written in order of ``at``: the newest row of
    each key is current; a row is a version of its own where its digest differs from the one before; the ``keep``
    newest versions stay."""
    w = Window.partitionBy(key).orderBy(at)
    rows = versions.withColumn("_prev", F.lag(digest).over(w)).filter(F.col("_prev").isNull() | (F.col("_prev") != F.col(digest))).drop("_prev")
    back = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= keep).select(key, at, digest, (F.col("_n") == 1).alias("current"))


def growth(rounds: DataFrame, key: str, order: str, height: str, text: str, most: int = 40, quiet: int = 2) -> DataFrame:
    """(key, rounds, tried): when a page that is scrolled has settled. After ``quiet`` rounds without a new greatest height
    or text a "load more" is tried once, then the watch stops; at the latest at round ``most``, so no more rows of a key
    are read. ``rounds`` is null where it has not stopped."""
    w = Window.partitionBy(key).orderBy(order)
    rows = rounds.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    grew = (F.col(height) > F.coalesce(F.max(height).over(before), F.lit(0))) | (F.col(text) > F.coalesce(F.max(text).over(before), F.lit(0)))
    rows = rows.withColumn("_g", grew)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", "_g"))), lambda x: x["_g"])

    def state(n: Column, q: Column, tried: Column, stop: Column) -> Column:
        return F.struct(n.alias("n"), q.alias("q"), tried.alias("tried"), stop.alias("stop"))

    def step(s: Column, g: Column) -> Column:
        n, q = s["n"] + 1, F.when(g, 0).otherwise(s["q"] + 1)
        settled = (n < most) & (q >= quiet)
        again = settled & ~s["tried"]
        return F.when(s["stop"], s).otherwise(state(n, F.when(again, 0).otherwise(q), s["tried"] | again, (n >= most) | (settled & s["tried"])))

    out = rows.groupBy(key).agg(F.aggregate(listed, state(F.lit(0), F.lit(0), F.lit(False), F.lit(False)), step).alias("s"))
    return out.select(key, F.when(F.col("s.stop"), F.col("s.n")).alias("rounds"), F.col("s.tried").alias("tried"))
