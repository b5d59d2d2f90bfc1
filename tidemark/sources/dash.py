"""DASH manifests and storyboards as rows: segment times from timelines, cells of tiled pictures by arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ATTR = "_timescale long, _startNumber long, _media string, _duration long"
#: What is read of a manifest; attributes begin with ``_``.
MPD = (
    f"Period array<struct<AdaptationSet: array<struct<_mimeType: string, _lang: string, SegmentTemplate: struct<{', '.join(a.replace(' ', ': ', 1) for a in _ATTR.split(', '))}, "
    "SegmentTimeline: struct<S: array<struct<_t: long, _d: long, _r: long>>>>>>>>"
)


def segments(manifests: DataFrame, key: str, body: str, mime: str = "video") -> DataFrame:
    """(key, place, uri, start, seconds): the segments of the first set of a kind that a timeline lists.

    An entry stands for ``r`` + 1 segments of ``d`` units; where it names no time it goes on where the last one ended.
    Entries are summed before they are multiplied out, so a manifest takes time in proportion to its segments. A negative
    repeat count, "to the end", counts as one segment. Markup that is no manifest has no rows.
    """
    tree = manifests.select(key, F.from_xml(body, MPD).alias("x"))
    sets = tree.select(key, F.explode("x.Period").alias("p")).select(key, F.explode("p.AdaptationSet").alias("s")).filter(F.coalesce("s._mimeType", F.lit(mime)).startswith(mime))
    first = sets.select(key, F.col("s.SegmentTemplate").alias("t")).filter("t.SegmentTimeline is not null").groupBy(key).agg(F.first("t").alias("t"))
    entry = first.select(key, "t", F.posexplode("t.SegmentTimeline.S").alias("k", "e"))
    n = F.greatest(F.coalesce("e._r", F.lit(0)), F.lit(0)) + 1
    entry = entry.select(key, "t", "k", F.col("e._d").alias("d"), F.col("e._t").alias("at"), n.alias("n"))
    w = Window.partitionBy(key).orderBy("k")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # each named time opens a run; within it entries follow one another
    entry = entry.withColumn("run", F.sum(F.when(F.col("at").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    of_run = Window.partitionBy(key, "run").orderBy("k")
    began = F.coalesce(F.first("at").over(of_run), F.lit(0)) + F.coalesce(F.sum(F.col("d") * F.col("n")).over(of_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    entry = entry.withColumn("began", began).withColumn("number", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = entry.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    time, place, scale = F.col("began") + F.col("i") * F.col("d"), F.col("number") + F.col("i"), F.coalesce("t._timescale", F.lit(1))
    uri = F.replace(F.replace(F.coalesce("t._media", F.lit("")), F.lit("$Number$"), (F.coalesce("t._startNumber", F.lit(1)) + place).cast("string")), F.lit("$Time$"), time.cast("string"))
    return rows.select(key, place.alias("place"), uri.alias("uri"), (time / scale).alias("start"), (F.col("d") / scale).alias("seconds"))


def storyboard(specs: DataFrame, key: str, spec: str, seconds: str) -> DataFrame:
    """(key, place, t, sheet, x, y, w, h): the frames of a storyboard given as a template and its levels.

    The spec is ``template|w#h#count#cols#rows#interval_ms#name#signature|...``, smallest level first, and the last is read:
    ``$L`` is its number, ``$N`` its name with ``$M`` the sheet's. Without an interval frames are spread over ``seconds``.
    Boxes are shares of the sheet. A spec with missing or zero counts has no rows.
    """
    parts = F.split(spec, r"\|")
    f = F.split(F.element_at(parts, -1), "#")

    def number(i: int, kind: str = "long") -> Column:
        v = F.get(f, F.lit(i)).try_cast(kind)
        return F.when(v > 0, v)

    rows = specs.select(key, F.get(parts, F.lit(0)).alias("template"), (F.size(parts) - 2).alias("level"), number(2).alias("n"), number(3).alias("cols"), number(4).alias("rows"), number(5, "double").alias("ms"), F.get(f, F.lit(6)).alias("name"), F.get(f, F.lit(7)).alias("sign"), F.col(seconds).alias("whole"), (F.size(parts) > 1).alias("ok"))
    rows = rows.withColumn("every", F.coalesce(F.col("ms") / 1000, F.col("whole") / F.col("n"))).filter("ok and n is not null and cols is not null and rows is not null and sign is not null and every is not null")
    rows = rows.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    per, cell = F.col("cols") * F.col("rows"), F.col("place") % (F.col("cols") * F.col("rows"))
    name = F.replace("name", F.lit("$M"), F.floor(F.col("place") / per).cast("string"))
    sheet = F.replace(F.replace("template", F.lit("$L"), F.col("level").cast("string")), F.lit("$N"), name)
    signed = F.when(F.col("sign") == "", sheet).otherwise(F.concat(sheet, F.when(F.contains(sheet, F.lit("?")), "&").otherwise("?"), F.lit("sigh="), "sign"))
    x, y = (cell % F.col("cols")) / F.col("cols"), F.floor(cell / F.col("cols")) / F.col("rows")
    return rows.select(key, "place", (F.col("place") * F.col("every")).alias("t"), signed.alias("sheet"), x.alias("x"), y.alias("y"), (1 / F.col("cols")).alias("w"), (1 / F.col("rows")).alias("h"))
