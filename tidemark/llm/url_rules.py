"""URL filter: stated host and path rules first, then association rules mined from labels. Native.

``FPGrowth`` mines combinations of URL tokens together with a label token; rules that end in the bad label
and pass the support, confidence and lift floors, and that no shorter rule already implies, form an inverted
index from token to rule. A URL is bad if all tokens of a rule are among its own.

A null URL, or one without ``://``, has empty host and path, no tokens, and is allowed unless a rule says
otherwise. Judging depends on the URL alone, so repeated URLs are judged once, null URLs take no part in the join
back, and a hot host or URL is no hot key.
Labels that are null count as good; pages without a label take no part in mining; an empty table, or one
without labels, mines no rule. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, pick

#: Fixed values: (verdict, host, start of path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BAD = "label=bad"
#: Index rows up to this many are broadcast; more join by shuffle.
BROADCAST_INDEX = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; '' if there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<verdict,rule> of the longest rule that fits, or null. The list is stated configuration."""
    fits = []
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        here = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(here, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))))
    return F.coalesce(*fits)


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels by place, path words (numbers as one token), extension, query keys, fragment."""
    host, path = url_host(url), url_path(url)
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.filter(F.split(F.lower(path), r"[/._-]+"), lambda x: x != "")
    words = F.transform(words, lambda x: F.concat(F.lit("p:"), F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)))
    query = F.regexp_extract(url, r"(?s)://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.lower(F.substring_index(x, "=", 1))))
    frag = F.when(F.contains(url, F.lit("#")), F.array(F.lit("f:#"))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(labels, words, keys, frag)))


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_lift: float = 1.2) -> DataFrame:
    """(rule, tokens, confidence, support, lift) from rows (url, bad). A rule stays if its confidence less two
    standard errors is above the share of bad URLs, so that chance finds in few URLs go. Frequent sets are at most
    1/min_support times the subsets of one URL's tokens, however many rows there are."""
    spark = labelled.sparkSession
    items = labelled.select(F.concat(url_tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    items = items.filter(F.size("items") > 0)
    schema = "rule bigint, tokens array<string>, confidence double, support double, lift double"
    items = materialize(items, "url-items")
    if items.isEmpty():
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).filter(F.col("lift") >= min_lift)
    n = F.col("support") * float(items.count()) / F.col("confidence")
    lower = F.col("confidence") - 2 * F.sqrt(F.col("confidence") * (1 - F.col("confidence")) / n) - 1 / n
    found = found.filter(lower > F.col("confidence") / F.col("lift"))
    found = found.select(F.xxhash64(F.array_sort("antecedent")).alias("rule"), F.array_sort("antecedent").alias("tokens"), "confidence", "support", "lift")
    found = materialize(found, "url-rules")
    # a rule falls if a shorter one whose tokens it contains is as confident: found by the index itself
    post = found.select("rule", F.size("tokens").alias("n"), "confidence", F.explode("tokens").alias("token"))
    a, b = post.alias("a"), post.alias("b")
    inside = a.join(b, F.col("a.token") == F.col("b.token")).filter((F.col("a.n") < F.col("b.n")) & (F.col("a.confidence") >= F.col("b.confidence")))
    implied = inside.groupBy(F.col("b.rule").alias("rule"), F.col("a.rule").alias("by"), F.col("a.n").alias("n")).agg(F.count(F.lit(1)).alias("m")).filter("m = n").select("rule").distinct()
    return found.join(implied, "rule", "left_anti")


def judge_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, id_col="page_id", url_col="url", **mining) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, mined (a mined rule calls the URL bad)."""
    rows = pick(pages, id=id_col, url=url_col)
    mined = materialize(mine_rules(labelled, **mining), "url-pruned")
    index = mined.select("rule", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    if index.count() <= BROADCAST_INDEX:
        index = F.broadcast(index)
    tokens = rows.select("url").filter("url is not null").distinct().select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    hit = tokens.join(index, "token").groupBy("url", "rule", "n").agg(F.count(F.lit(1)).alias("m")).filter("m = n")
    bad = materialize(hit.select("url").distinct().withColumn("mined", F.lit(True)), "url-bad")
    rows = rows.withColumn("_i", F.monotonically_increasing_id())
    judged = join_hot(materialize(rows.filter("url is not null"), "url-rows"), bad, "url", "_i", "left").select("id", "url", "mined")
    out = judged.unionByName(rows.filter("url is null").select("id", "url", F.lit(None).cast("boolean").alias("mined")))
    out = out.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    said = rule_of(F.col("host"), F.col("path"), rules)
    mined_bad = F.coalesce("mined", F.lit(False))
    return out.select(
        "id", "host", "path", said["rule"].alias("rule"), F.coalesce(said["verdict"], F.when(mined_bad, "block").otherwise("allow")).alias("verdict"), mined_bad.alias("mined")
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs with the label of the document whose number the URL ends in; bad is toxic or low quality."""
    number = F.try_to_number(F.regexp_extract(url_path(pages["url"]), r"([0-9]{1,18})(?:\.[a-z]+)?/?$", 1), F.lit("9" * 18)).cast("long")
    p = pages.select(pages["url"], number.alias("n"))
    y = labels.select(labels["doc_id"].alias("n"), (F.coalesce(labels["toxic"] == 1, F.lit(False)) | F.coalesce(labels["quality"] == 0, F.lit(False))).alias("bad"))
    return p.join(y, "n").select("url", "bad")


def op5_url_rules(spark, sf_dir: str) -> DataFrame:
    """All pages through :func:`judge_urls`, mined from the labels of the documents that URLs name; an empty table gives
    no rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_urls(pages, labelled_urls(pages, labels)).withColumnRenamed("id", "page_id")
