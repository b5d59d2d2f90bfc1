"""Stored site files to rows: sitemaps, feeds, robots.txt, llms.txt and captions. Small files, many of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

TIME = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})"


def sitemap_urls(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, url, lastmod): entries of urlset and index files alike, tolerant of namespaces."""
    entry = F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?s)<(?:\w+:)?(?:url|sitemap)>(.*?)</(?:\w+:)?(?:url|sitemap)>"), F.lit(1)))
    e = files.select(key, entry.alias("e"))
    loc = F.trim(F.regexp_extract("e", r"(?s)<(?:\w+:)?loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</", 1))
    mod = F.trim(F.regexp_extract("e", r"(?s)<(?:\w+:)?lastmod>\s*(.*?)\s*</", 1))
    return e.select(key, F.replace(loc, F.lit("&amp;"), F.lit("&")).alias("url"), T.sitemap_time(mod).alias("lastmod")).filter("url <> ''")


def feed_items(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, url, title, published) of RSS items and Atom entries; an http guid stands for a missing link."""
    e = files.select(key, F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?s)<(?:item|entry)[ >](.*?)</(?:item|entry)>"), F.lit(1))).alias("e"))

    def tag(name: str):
        return F.trim(F.regexp_extract("e", rf"(?s)<{name}[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1))

    href = F.regexp_extract("e", r"<link[^>]*href=[\"']([^\"']+)", 1)
    url = F.coalesce(F.when(tag("link") != "", tag("link")), F.when(href != "", href), F.when(tag("guid").startswith("http"), tag("guid")))
    return e.select(key, url.alias("url"), tag("title").alias("title"), F.coalesce(F.when(tag("pubDate") != "", tag("pubDate")), tag("published")).alias("published")).filter("url is not null")


def robots_rules(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, agent, allow, pattern): consecutive agent lines share the rules that follow them."""
    lines = F.transform(F.split(F.regexp_replace(F.col(body), r"#[^\n]*", ""), r"\r?\n"), F.trim)
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("open"), F.array().cast("array<struct<agent:string,allow:boolean,pattern:string>>").alias("out"))

    def step(acc, line):
        field, value = F.lower(F.trim(F.substring_index(line, ":", 1))), F.trim(F.regexp_replace(line, r"^[^:]*:", ""))
        agents = F.when(field == "user-agent", F.concat(F.when(acc["open"], acc["agents"]).otherwise(F.array().cast("array<string>")), F.array(F.lower(value)))).otherwise(acc["agents"])
        rules = F.transform(acc["agents"], lambda a: F.struct(a.alias("agent"), (field == "allow").alias("allow"), value.alias("pattern")))
        out = F.when(field.isin("allow", "disallow") & (value != ""), F.concat(acc["out"], rules)).otherwise(acc["out"])
        return F.struct(agents.alias("agents"), F.when(line == "", acc["open"]).otherwise(field == "user-agent").alias("open"), out.alias("out"))

    return files.select(key, F.inline(F.aggregate(lines, start, step, lambda a: a["out"])))


def robots_allowed(urls: DataFrame, rules: DataFrame, key: str, path: str, agent: str) -> DataFrame:
    """Adds ``allowed``: the group of the longest agent name within ours, else ``*``; longest pattern wins, ties allow."""
    named = rules.withColumn("fits", F.when(F.contains(F.lit(agent.lower()), F.col("agent")), F.length("agent")).when(F.col("agent") == "*", 0)).filter("fits is not null")
    best = named.groupBy(key).agg(F.max("fits").alias("best"))
    own = named.join(best, key).filter("fits = best")
    quoted = F.regexp_replace(F.col("pattern"), r"([.+?^(){}\[\]|\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.replace(quoted, F.lit("*"), F.lit(".*")), r"\$$", r"\$"))
    own = own.select(key, "allow", "pattern", regex.alias("regex"))
    j = urls.join(own, key, "left").withColumn("hit", F.regexp_like(F.col(path), F.col("regex")))
    return j.groupBy(key, path).agg(F.coalesce(F.max_by("allow", F.when(F.col("hit"), F.struct(F.length("pattern"), "allow"))), F.lit(True)).alias("allowed"))


def llms_links(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, label, url) of markdown links, first of each URL."""
    e = files.select(key, F.posexplode(F.regexp_extract_all(F.col(body), F.lit(r"\[[^\]]+\]\(https?://[^)\s]+\)"), F.lit(0))).alias("pos", "m"))
    e = e.select(key, "pos", F.regexp_extract("m", r"^\[([^\]]+)\]", 1).alias("label"), F.regexp_extract("m", r"\]\(([^)]+)\)$", 1).alias("url"))
    return e.groupBy(key, "url").agg(F.min_by("label", "pos").alias("label"))


def caption_cues(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, start, end, text) of VTT and SRT cues, in seconds, tags stripped."""
    cue = rf"(?m)^{TIME}[ \t]+-->[ \t]+{TIME}[^\n]*\n((?:[^\n]+\n?)*)"
    e = files.select(key, F.explode(F.regexp_extract_all(F.regexp_replace(F.col(body), "\r", ""), F.lit(cue), F.lit(0))).alias("c"))

    def seconds(first: int):
        part = [F.regexp_extract("c", cue, first + i) for i in range(4)]
        return F.coalesce(F.when(part[0] != "", part[0]).cast("double"), F.lit(0.0)) * 3600 + part[1].cast("double") * 60 + part[2].cast("double") + part[3].cast("double") / 1000

    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("c", cue, 9), "<[^>]+>", ""), r"\s+", " "))
    return e.select(key, seconds(1).alias("start"), seconds(5).alias("end"), text.alias("text"))
