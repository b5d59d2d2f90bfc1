"""Content verdicts as expressions over the text: integrity, optimisation, page kind, percentile bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.functions import urls as U

# Thresholds of the published heuristics.
MIN_WORDS, MIN_CHARS = 50, 300
WORD_LEN = (3.0, 10.0)
MIN_ALPHA, MAX_SYMBOLS, MAX_BIGRAM = 0.8, 0.1, 0.2


def top_bigram(ws: Column) -> Column:
    """Share of words in the commonest adjacent pair; 0 under 100 words. Pairs are hashed,
    and the sorted hashes make runs to measure."""
    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    pairs = F.array_sort(F.zip_with(F.slice(hashes, 1, F.size(ws) - 1), F.slice(hashes, 2, F.size(ws) - 1), lambda a, b: F.xxhash64(a, b)))

    def longest(hs: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(acc: Column, x: Column) -> Column:
            run = F.when(x == acc["last"], acc["run"] + 1).otherwise(1)
            return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

        return F.aggregate(hs, start, step, lambda a: a["best"])

    return F.when(F.size(ws) < 2 * MIN_WORDS, 0.0).otherwise(longest(pairs) * 2.0 / F.size(ws))


def assess(docs: DataFrame, text: str = "text", html_bytes: str | None = None) -> DataFrame:
    """Adds ``reasons`` and ``verdict`` (partial if cut off, full if nothing is wrong, else thin). Whole texts are judged."""
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    df = docs.withColumn("_body", body).withColumn("_w", T.spaced(F.col("_body")))
    n = F.size("_w")
    letters = F.length(F.array_join("_w", ""))
    foreign = F.length(F.regexp_replace("_body", r"[^\p{L}]|[A-Za-z]", ""))
    spaceless = (n * 20 < F.length("_body")) & (foreign * 2 > F.length("_body"))
    floor = F.when(spaceless, MIN_CHARS // 3).otherwise(MIN_CHARS)
    thin = (n < MIN_WORDS) & (F.length("_body") < floor)
    mean = letters / F.greatest(n, F.lit(1))
    alpha = F.size(F.filter("_w", lambda w: w.rlike(r"\p{L}"))) / F.greatest(n, F.lit(1))
    marks = (F.length("_body") - F.length(F.regexp_replace("_body", "[#…]", ""))) + (F.length("_body") - F.length(F.regexp_replace("_body", r"\.\.\.", ""))) / 3
    odd = (~spaceless & ~mean.between(*WORD_LEN)) | (alpha < MIN_ALPHA) | (marks / F.greatest(n, F.lit(1)) > MAX_SYMBOLS)
    cut = F.col("_body").endswith("…") | F.col("_body").endswith("...")
    found = [F.when(thin, "thin_text"), F.when((n > 0) & odd, "not_prose"), F.when(top_bigram(F.col("_w")) > MAX_BIGRAM, "repetitive"), F.when(cut, "truncated")]
    if html_bytes:
        found.append(F.when((F.col(html_bytes) >= 20_000) & (F.octet_length("_body") / F.col(html_bytes) < 0.05), "low_text_ratio"))
    out = df.withColumn("reasons", F.array_compact(F.array(*found)))
    verdict = F.when(F.array_contains("reasons", "truncated"), "partial").when(F.size("reasons") == 0, "full").otherwise("thin")
    return out.withColumn("verdict", verdict).drop("_body", "_w")


def optimisation(anchors: Column, affiliate: Column, headings: Column, echo: Column, n_words: Column) -> Column:
    """struct<level,traits>: signs of pages written for engines; two traits make it high."""
    dense = n_words >= 200
    traits = F.array_compact(F.array(
        F.when(dense & (affiliate >= 3) & (affiliate * 1000.0 / F.greatest(n_words, F.lit(1)) > 5), "affiliate_heavy"),
        F.when((headings >= 3) & (echo > 0.95), "headings_echo_the_body"),
        F.when(dense & (anchors * 100.0 / F.greatest(n_words, F.lit(1)) > 4), "link_dense"),
    ))
    return F.struct(F.when(F.size(traits) >= 2, "high").otherwise("ordinary").alias("level"), traits.alias("traits"))


def percentile_bands(rows: DataFrame, group: str, value: str, bins: int = 20) -> DataFrame:
    """(group, bin, n, total, percentile, band): mid-rank percentile of each bin of [0, 1] values.

    Below 30 observations there is no percentile; the band is wide below 200 and narrow from there on.
    """
    b = F.least(F.floor(F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0)) * bins), F.lit(bins - 1)).cast("int")
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    below = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = counts.withColumn("total", F.sum("n").over(w)).withColumn("below", below)
    pct = F.when(F.col("total") >= 30, F.round((F.col("below") + F.col("n") / 2) / F.col("total"), 6))
    band = F.when(F.col("total") < 30, "refused").when(F.col("total") < 200, "wide").otherwise("narrow")
    return out.select(group, "bin", "n", "total", pct.alias("percentile"), band.alias("band"))


#: Page kinds by what the text says; our own phrases, few and plain, in order of precedence.
KINDS = [
    ("not_found", ["page not found", "404 not found", "no longer exists"]),
    ("site_error", ["internal server error", "service unavailable"]),
    ("paywall", ["subscribe to continue", "subscribers only"]),
    ("login", ["log in to continue", "sign in to continue"]),
    ("consent", ["accept cookies to continue"]),
]


def page_kind(status: Column, text: Column) -> Column:
    """Label of a fetched page: by status first, then by phrases in short texts, then empty or none."""
    low, short = F.lower(F.coalesce(text, F.lit(""))), F.length(F.coalesce(text, F.lit(""))) < 2000
    out = F.when(status.isin(404, 410), "not_found").when(status == 429, "rate_limited").when(status.isin(401, 403), "refused").when(status >= 500, "site_error")
    for kind, phrases in KINDS:
        says = F.lit(False)
        for p in phrases:
            says = says | F.contains(low, F.lit(p))
        out = out.when(short & says, kind)
    return out.when(F.length(F.trim(low)) == 0, "empty").otherwise("none")


def structured_verdict(x: Column) -> Column:
    """empty, ok, truncated (brackets still open) or malformed JSON. The parser stops behind the first value, so brackets
    outside strings must also be as many closed as opened."""
    bare = F.regexp_replace(x, r'"(?:[^"\\]|\\.)*"', "")
    opened, closed = F.regexp_count(bare, F.lit(r"[{\[]")), F.regexp_count(bare, F.lit(r"[}\]]"))
    valid = F.try_parse_json(x).isNotNull() & (opened == closed)
    return F.when(F.trim(x) == "", "empty").when(valid, "ok").when(opened > closed, "truncated").otherwise("malformed")


def response_verdict(status: Column, text_len: Column, asked: Column, landed: Column, wall: Column, elapsed_ms: Column, typical_ms: Column) -> Column:
    """ok, rate_limited or blocked: what a response means for the session that asked. ``asked`` and ``landed`` are
    paths; a deep one that lands on the root, and a success of under 200 characters, are blocks; so slow an answer
    that it is 8 times the usual and over 5 s asks for a pause."""
    slow = (typical_ms > 0) & (elapsed_ms > typical_ms * 8) & (elapsed_ms > 5000)
    return (
        F.when(wall | status.isin(401, 403, 407), "blocked").when((status == 429) | status.between(500, 599), "rate_limited")
        .when(status.between(200, 299) & (text_len < 200), "blocked").when(U.is_deep(asked) & U.is_root(landed), "blocked").when(slow, "rate_limited").otherwise("ok")
    )
