"""HLS playlists as rows: segments with their times, subtitle tracks, and what protects a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A segment: its duration, further tags, its address.
SEGMENT = r"(?m)^#EXTINF:\s*([0-9.]+)[^\n]*\n(?:\s*(?:#[^\n]*)?\n)*([^#\s][^\n]*?)\s*$"


def _attribute(line: Column, name: str) -> Column:
    found = F.regexp_extract(line, rf'(?:[:,]\s*){name}=(?:"([^"]*)"|[^",]*)', 0)
    value = F.regexp_replace(F.regexp_replace(found, r"^[:,]\s*[^=]*=", ""), '"', "")
    return F.when(found != "", value)


def hls_segments(playlists: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, uri, start, seconds): media segments in order; times add up from 0."""
    text = F.replace(body, F.lit("\r"), F.lit(""))
    spans = F.transform(F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(1)), lambda s: F.coalesce(s.try_cast("double"), F.lit(0.0)))
    rows = playlists.select(key, spans.alias("s"), F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(2)).alias("u"))
    rows = rows.select(key, F.posexplode(F.arrays_zip("s", "u")).alias("place", "x")).select(key, "place", F.col("x.u").alias("uri"), F.col("x.s").alias("seconds"))
    before = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(key, "place", "uri", F.coalesce(F.sum("seconds").over(before), F.lit(0.0)).alias("start"), "seconds")


def hls_subtitles(playlists: DataFrame, key: str, body: str) -> DataFrame:
    """(key, language, name, uri) of each subtitle rendition that has an address."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("#EXT-X-MEDIA:") & (_attribute(x, "TYPE") == "SUBTITLES"))
    rows = playlists.select(key, F.explode(lines).alias("x"))
    return rows.select(key, _attribute(F.col("x"), "LANGUAGE").alias("language"), _attribute(F.col("x"), "NAME").alias("name"), _attribute(F.col("x"), "URI").alias("uri")).filter("uri is not null")


def hls_protection(body: Column) -> Column:
    """Method and key format of the first key that protects the stream; null where none does."""
    keys = F.filter(F.split(body, r"\r?\n"), lambda x: x.rlike("^#EXT-X-(?:SESSION-)?KEY:") & (F.coalesce(_attribute(x, "METHOD"), F.lit("NONE")) != "NONE"))
    first = F.get(keys, F.lit(0))
    return F.concat_ws(" ", _attribute(first, "METHOD"), _attribute(first, "KEYFORMAT"))
