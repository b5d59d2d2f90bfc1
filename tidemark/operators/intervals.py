"""Joins on time: points in spans, nearest points within a tolerance, overlapping spans; greedy separation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.blocks import numbered_by_jumps


def _slots(low: Column, high: Column, width: int) -> Column:
    """Numbers of the slots of ``width`` that [low, high] touches."""
    return F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))


def in_spans(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points joined to the spans [start, end) of their key that hold them. An equi-join on (key, slot of time): a span is
    copied to the slots that it touches, so ``width`` should be about the length of a span."""
    p = points.withColumn("_slot", F.floor(F.col(at) / width).cast("long"))
    s = spans.filter(F.col(start) < F.col(end)).withColumn("_slot", F.explode(_slots(F.col(start), F.col(end) - 1, width)))
    return p.join(s, [key, "_slot"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_slot")


def nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, left_at: str, right_id: str, right_at: str, within: int) -> DataFrame:
    """(left_id, right_id, gap): the row of the same key nearest in time, if any is at most ``within`` away; ties go to
    the earlier, then the smaller id. Slots are as wide as the tolerance, so three of them are looked at."""
    a = left.select(key, left_id, left_at, F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.floor(F.col(left_at) / within).cast("long") + i)).alias("_slot"))
    b = right.select(key, right_id, right_at, F.floor(F.col(right_at) / within).cast("long").alias("_slot"))
    gap = F.abs(F.col(left_at) - F.col(right_at))
    near = a.join(b, [key, "_slot"]).withColumn("gap", gap).filter(F.col("gap") <= within)
    return near.groupBy(left_id).agg(F.min(F.struct("gap", right_at, right_id)).alias("m")).select(left_id, F.col(f"m.{right_id}").alias(right_id), "m.gap")


def overlapping(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of half-open spans of one key that overlap. Each pair is kept in the slot where the later of the two
    starts, so that none comes twice."""
    x = a.filter(F.col(a_span[0]) < F.col(a_span[1])).withColumn("_slot", F.explode(_slots(F.col(a_span[0]), F.col(a_span[1]) - 1, width)))
    y = b.filter(F.col(b_span[0]) < F.col(b_span[1])).withColumn("_slot", F.explode(_slots(F.col(b_span[0]), F.col(b_span[1]) - 1, width)))
    meet = (F.col(a_span[0]) < F.col(b_span[1])) & (F.col(b_span[0]) < F.col(a_span[1]))
    here = F.floor(F.greatest(F.col(a_span[0]), F.col(b_span[0])) / width) == F.col("_slot")
    return x.join(y, [key, "_slot"]).filter(meet & here).drop("_slot")


def apart(ranked: DataFrame, key: str, rank: str, at: str, least: int, keep: int) -> DataFrame:
    """(key, at, place): down a short ranked list, each item that is at least ``least`` from all taken before, ``keep``
    at most. Lists are a page of results long."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(rank, at))), lambda x: x[at])
    zero = F.slice(listed, 1, 0)

    def step(acc: Column, x: Column) -> Column:
        return F.when((F.size(acc) < keep) & ~F.exists(acc, lambda t: F.abs(t - x) < least), F.concat(acc, F.array(x))).otherwise(acc)

    taken = ranked.groupBy(key).agg(F.aggregate(listed, zero, step).alias("t"))
    return taken.select(key, F.posexplode("t").alias("place", at)).withColumn("place", F.col("place") + 1)


def passages(cues: DataFrame, keys: list[str], start: str, end: str, text: str, tie: str, window: int) -> DataFrame:
    """(keys, start, end, n, text): cues in order, cut where one starts ``window`` or more after its passage does. ``keys``
    name a chapter: a passage never crosses one. Where a passage ends is looked up in the starts, and passages follow by
    doubled jumps, so a chapter of any length takes time in proportion."""
    w = Window.partitionBy(*keys).orderBy(start, tie, end, text)
    rows = cues.select(F.struct(*keys).alias("_key"), *keys, start, end, text, (F.row_number().over(w) - 1).alias("_pos"))
    by_start = Window.partitionBy("_key").orderBy(start)
    within, just_out = F.max("_pos").over(by_start.rangeBetween(Window.currentRow, window)), F.count(F.lit(1)).over(by_start.rangeBetween(window, window))
    rows = numbered_by_jumps(rows.withColumn("_to", (within - just_out + 1).cast("int")), "_key", "_pos", "_to", "_passage")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", text))), lambda x: x[text]), " ")
    out = rows.groupBy(*keys, "_passage").agg(F.min(start).alias("_a"), F.max(end).alias("_b"), F.count(F.lit(1)).cast("int").alias("n"), said.alias("_t"))
    return out.select(*keys, F.col("_a").alias(start), F.col("_b").alias(end), "n", F.col("_t").alias(text))


def fresh_lines(cues: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, order, text): rolling captions without the lines that each cue repeats from the end of the one before; cues
    with nothing new are left out."""
    lines = F.split(text, "\n")
    rows = cues.select(key, order, lines.alias("_now"), F.lag(lines).over(Window.partitionBy(key).orderBy(order)).alias("_was"))
    was = F.coalesce("_was", F.array().cast("array<string>"))
    tries = F.sequence(F.lit(0), F.least(F.size("_now"), F.size(was)))
    same = F.filter(tries, lambda n: F.slice(was, F.size(was) - n + 1, n) == F.slice("_now", F.lit(1), n))
    at = F.array_max(same)
    out = rows.select(key, order, F.array_join(F.slice("_now", at + 1, F.size("_now")), "\n").alias(text))
    return out.filter(F.col(text) != "")


def strongest_boxes(boxes: DataFrame, key: str, box: str, score: str, limit: float) -> DataFrame:
    """(key, box): down the boxes of one picture by score, then left to right, then top down, each that overlaps none
    taken before by more than ``limit``. ``box`` is a struct of id, x1, y1, x2, y2."""
    from tidemark.operators.retrieval import iou

    b = F.col(box)
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), (b["x1"] + b["x2"]).alias("cx"), (b["y1"] + b["y2"]).alias("cy"), b.alias("b")))), lambda x: x["b"])

    def over(a: Column, x: Column) -> Column:
        return iou(*[a[c] for c in ("x1", "y1", "x2", "y2")], *[x[c] for c in ("x1", "y1", "x2", "y2")]) > limit

    taken = F.aggregate(listed, F.slice(listed, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda a: over(a, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return boxes.groupBy(key).agg(taken.alias("t")).select(key, F.explode("t").alias(box))
