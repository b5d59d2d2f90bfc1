"""Where in a recording or a text something is said: posting lists over a term dictionary, coverage and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T

# Words that say nothing about a moment, English and Spanish.
EMPTY_WORDS = (
    "the of and or in on at to is are was it an for with by as that this where when what el la los las un una de del en que se es al lo con por para como donde cuando su"
).split()
WORD, LONG, LEAST_COVER = r"[\p{L}\p{N}]+", 4, 0.5
BEFORE, AFTER = 60, 140


def query_words(query: Column) -> Column:
    """The distinct folded words of two letters and more, without those that every sentence has; if it has no others, those."""
    every = F.filter(F.regexp_extract_all(T.fold(query), F.lit(f"({WORD})"), F.lit(1)), lambda w: F.length(w) >= 2)
    telling = F.filter(every, lambda w: ~w.isin(EMPTY_WORDS))
    return F.array_sort(F.array_distinct(F.when(F.size(telling) > 0, telling).otherwise(every)))


def stem(word: Column) -> Column:
    """What words that find each other share: a long word its first letters, a short one itself."""
    return F.when(F.length(word) >= LONG, F.substring(word, 1, LONG)).otherwise(word)


def same_word(have: Column, want: Column) -> Column:
    """Equal, or both long and one the other with an ending."""
    long = (F.length(have) >= LONG) & (F.length(want) >= LONG)
    return (have == want) | (long & (have.startswith(want) | want.startswith(have)))


def postings(passages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, word, at): each folded word of a passage with the character where it first stands."""
    pieces = F.regexp_extract_all(T.fold(F.col(text)), F.lit(rf"({WORD}|[^\p{{L}}\p{{N}}]+)"), F.lit(1))
    rows = passages.select(*keys, F.posexplode(pieces).alias("_k", "word"))
    before = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("word")).over(before), F.lit(0))).filter(F.col("word").rlike(rf"^{WORD}"))
    return rows.groupBy(*keys, "word").agg(F.min("at").cast("int").alias("at"))


def moments(passages: DataFrame, queries: DataFrame, within: str, place: str, text: str, query: str) -> DataFrame:
    """(within, place, score, snippet): passages of a recording that hold at least half of the words of its query.

    ``passages``: (within, place, text), places unique in a recording; ``queries``: (within, query). Query words meet the
    recording's dictionary, its distinct words, on their first letters, and the words found meet the posting lists; no
    passage without such a word is looked at. The snippet starts 60 characters before the first word found.
    """
    lists = postings(passages, [within, place], text)
    words = lists.select(within, "word").distinct().withColumn("_stem", stem(F.col("word")))
    wanted = queries.select(within, F.explode(query_words(F.col(query))).alias("want"))
    n = queries.select(within, F.size(query_words(F.col(query))).alias("_n"))
    found = wanted.withColumn("_stem", stem(F.col("want"))).join(words, [within, "_stem"]).filter(same_word(F.col("word"), F.col("want"))).select(within, "want", "word")
    per = lists.join(found, [within, "word"]).groupBy(within, place).agg(F.count_distinct("want").alias("_found"), F.min("at").alias("_at"))
    hits = per.join(n, within).withColumn("score", F.col("_found") / F.col("_n")).filter(F.col("score") >= LEAST_COVER)
    low, whole = F.greatest(F.col("_at") - BEFORE, F.lit(0)), F.length(text)
    high = F.least(F.col("_at") + AFTER, whole)
    plain = F.trim(F.regexp_replace(F.substring(F.col(text), low + 1, high - low), r"\s+", " "))
    snippet = F.concat(F.when(low > 0, "…").otherwise(""), plain, F.when(high < whole, "…").otherwise(""))
    return hits.join(passages, [within, place]).select(within, place, "score", snippet.alias("snippet"))
