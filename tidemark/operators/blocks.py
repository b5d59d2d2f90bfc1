"""Texts as blocks: markdown blocks, heading paths, pages of bounded tokens, BM25 inside a page in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.operators.retrieval import B, K1

FENCE = r"^\s*```"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line): a row a line; null text has none."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def markdown_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, first, text): blank lines part blocks, but not inside a fence, which is one block with its marks."""
    w = Window.partitionBy(key).orderBy("pos")
    before = F.coalesce(F.sum(F.col("line").rlike(FENCE).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines(docs, key, text).withColumn("inside", before % 2 == 1)
    rows = rows.withColumn("blank", (F.trim("line") == "") & ~F.col("inside"))
    starts = ~F.col("blank") & F.coalesce(F.lag("blank").over(w), F.lit(True))
    rows = rows.withColumn("block", F.sum(starts.cast("int")).over(w).cast("long")).filter("not blank")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(key, "block").agg(F.min("pos").alias("first"), joined.alias("text"))


def heading_path(blocks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Adds ``path``: the headings above a block, outermost first; a heading ends those of its own level and deeper."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    level = F.when(F.col(text).rlike(r"^#{1,6}\s"), F.length(F.regexp_extract(text, r"^#{1,6}", 0)))
    rows = blocks.withColumn("_level", level).withColumn("_title", F.trim(F.regexp_replace(F.substring_index(F.col(text), "\n", 1), r"^#{1,6}\s+", "")))
    kept = []
    for n in range(1, 7):
        last = F.last(F.when(F.col("_level") == n, F.struct(F.col(order).alias("at"), F.col("_title").alias("title"))), ignorenulls=True).over(w)
        ended = F.coalesce(F.last(F.when(F.col("_level") < n, F.col(order)), ignorenulls=True).over(w), F.lit(-1))
        kept.append(F.when(last["at"] > ended, last["title"]))
    return rows.withColumn("path", F.array_join(F.array_compact(F.array(*kept)), " > ")).drop("_level", "_title")


def numbered_by_jumps(rows: DataFrame, key: str, pos: str, follows: str, out: str) -> DataFrame:
    """Adds ``out``: which stretch a row is in, from 0, where the stretch of row ``pos`` (0, 1, ...) ends before row
    ``follows``.

    The starts are what is reached from row 0 by the jumps. They are found by doubling: jumps of 1, 2, 4, ... stretches are
    applied to all starts so far, so a text takes the logarithm of its stretches in passes over its jumps.
    """
    end = F.col("n")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(pos, follows))), lambda x: x[follows].cast("int"))
    per = rows.groupBy(key).agg(listed.alias("jumps"), F.count(F.lit(1)).cast("int").alias("n")).withColumn("jumps", F.concat("jumps", F.array("n")))
    first = F.struct(F.col("jumps").alias("j"), F.array(F.lit(0)).alias("r"))

    def twice(acc: Column, _: Column) -> Column:
        reached = F.filter(F.transform(acc["r"], lambda x: F.get(acc["j"], x)), lambda x: x < end)
        return F.struct(F.transform(acc["j"], lambda x: F.get(acc["j"], x)).alias("j"), F.concat(acc["r"], reached).alias("r"))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(end + 1)).cast("int"))
    starts = per.select(key, F.explode(F.aggregate(rounds, first, twice, lambda a: a["r"])).alias(pos), F.lit(1).alias("_start"))
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.join(starts, [key, pos], "left").withColumn(out, (F.sum(F.coalesce("_start", F.lit(0))).over(w) - 1).cast("int")).drop("_start")


def page_numbers(blocks: DataFrame, key: str, pos: str, cost: str, budget: int) -> DataFrame:
    """Adds ``page`` to blocks ``pos`` = 0, 1, ...: one that no longer fits opens the next page; one of its own may exceed.

    A page from block i ends before the last block whose running cost is within the budget of i's, found in the sums.
    """
    w = Window.partitionBy(key).orderBy(pos)
    before = F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    own = blocks.select(key, pos, before.alias("_sum"), cost)
    end = own.groupBy(key).agg((F.max(pos) + 1).cast(own.schema[pos].dataType).alias(pos), F.max(F.col("_sum") + F.col(cost)).alias("_sum"))
    every = own.select(key, pos, "_sum").unionByName(end)
    within = Window.partitionBy(key).orderBy("_sum").rangeBetween(Window.currentRow, budget)
    last = F.max(pos).over(Window.partitionBy(key))
    jumps = every.withColumn("_to", F.greatest(F.max(pos).over(within), F.col(pos) + 1)).withColumn("_last", last).filter(F.col(pos) < F.col("_last")).select(key, pos, "_to")
    return numbered_by_jumps(blocks.join(jumps, [key, pos]), key, pos, "_to", "page").drop("_to")


def verbatim_pages(docs: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, page, text): whole lines up to ``budget`` estimated tokens a page; the pages joined are the text, byte for
    byte."""
    parts = F.filter(F.split(F.col(text), r"(?<=\n)"), lambda x: x != "")
    rows = docs.select(key, F.posexplode(parts).alias("pos", "line")).withColumn("cost", T.token_estimate(F.col("line")))
    each = page_numbers(rows, key, "pos", "cost", budget)
    return each.groupBy(key, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("text"))


def best_blocks(blocks: DataFrame, terms: list[str], keep: int, key: str, order: str, text: str) -> DataFrame:
    """(key, order, score): the ``keep`` best blocks of each page by BM25 among its own blocks, to be read in document
    order; a page where no block holds a term, or that has no more blocks than ``keep``, stays whole. Ties go to the
    earlier block."""
    page = Window.partitionBy(key)
    low = T.ascii_lower(F.col(text))
    wanted = sorted(set(terms))
    hits = F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9])(?:{'|'.join(wanted)})(?![a-z0-9])"), F.lit(0))

    def count(term: str) -> Column:
        return F.size(F.filter("_hits", lambda x: x == term))

    rows = blocks.select(key, order, F.regexp_count(low, F.lit("[a-z0-9]+")).alias("_len"), hits.alias("_hits"))
    rows = rows.select(key, order, "_len", *[count(t).alias(f"_tf{i}") for i, t in enumerate(wanted)])
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(page)).withColumn("_avg", F.greatest(F.avg("_len").over(page), F.lit(1.0)))
    score = F.lit(0.0)
    for i, t in enumerate(wanted):
        tf, df = F.col(f"_tf{i}"), F.count_if(F.col(f"_tf{i}") > 0).over(page)
        score = score + terms.count(t) * F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    rows = rows.withColumn("score", F.round(score, 9))
    rank = F.row_number().over(page.orderBy(F.desc("score"), order))
    rows = rows.withColumn("_rank", rank).withColumn("_best", F.max("score").over(page))
    return rows.filter((F.col("_rank") <= keep) | (F.col("_best") == 0) | (F.col("_n") <= keep)).select(key, order, "score")


def is_content(words: Column, linked: Column, before: Column, before_linked: Column, after: Column) -> Column:
    """Whether a block is content by the published shallow-text tree: its own words and link density and its neighbours'."""
    plain, linky = (words > 16) | (after > 15) | (before > 4), (words > 40) | (after > 17)
    return (linked <= 0.333333) & F.when(before_linked <= 0.555556, plain).otherwise(linky)


def judged_blocks(pages: DataFrame, key: str, blocks: str) -> DataFrame:
    """(key, blocks): array<struct<text,linked,words,content>> from array<struct<text,linked>>. A page's blocks are one
    array, so neighbours are looked up without a shuffle; blocks without words go first; past either end is nothing."""
    counted = F.transform(blocks, lambda b: F.struct(b["text"].alias("text"), b["linked"].cast("double").alias("linked"), T.script_words(b["text"]).alias("words")))
    rows = pages.select(key, F.filter(counted, lambda b: b["words"] > 0).alias("_b"))

    def judge(b: Column, i: Column) -> Column:
        prev, after = F.when(i > 0, F.get("_b", i - 1)), F.get("_b", i + 1)
        content = is_content(b["words"], b["linked"], F.coalesce(prev["words"], F.lit(0)), F.coalesce(prev["linked"], F.lit(0.0)), F.coalesce(after["words"], F.lit(0)))
        return F.struct(b["text"].alias("text"), b["linked"].alias("linked"), b["words"].alias("words"), content.alias("content"))

    return rows.select(key, F.transform("_b", judge).alias("blocks"))


def main_text(pages: DataFrame, key: str, blocks: str, least: int = 400) -> DataFrame:
    """(key, main): the content blocks, one a line; all blocks where under ``least`` characters are left of them and they
    are none, or less than a third of a page of at most ten times ``least``."""
    b = judged_blocks(pages, key, blocks)
    kept = F.array_join(F.transform(F.filter("blocks", lambda x: x["content"]), lambda x: x["text"]), "\n")
    full = F.array_join(F.transform("blocks", lambda x: x["text"]), "\n")
    both = b.select(key, kept.alias("kept"), full.alias("full"))
    poor = (F.length("kept") < least) & ((F.length("kept") == 0) | ((F.length("full") >= 3 * F.length("kept")) & (F.length("full") <= 10 * least)))
    return both.select(key, F.when(poor, F.col("full")).otherwise(F.col("kept")).alias("main"))
