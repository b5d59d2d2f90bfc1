"""Texts handed out in pages of bounded tokens, cut at blocks, with cursors that resume anywhere.

Blocks, their costs and heading paths are rows that Spark makes; a text's blocks then meet in one row, a bounded group, where
each page is found by a search in the running costs. A page looks at the blocks that it returns and at no others.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import blocks as B

#: With fewer tokens left, or less than a quarter of the budget, a page ends at its last whole block.
LEAST_FILL = 16
WIDE = 0x2E80


def tokens(s: str) -> int:
    """As :func:`tidemark.functions.text.token_estimate`."""
    wide = 0 if s.isascii() else sum(ord(c) > WIDE for c in s)
    return -(-(len(s) - wide) // 4) + wide + wide // 4


def chars_within(s: str, quarters: int) -> int:
    """How many first characters cost so many quarter tokens: one a narrow character, five a wide one."""
    if s.isascii():
        return max(0, min(len(s), quarters))
    for n, c in enumerate(s):
        quarters -= 5 if ord(c) > WIDE else 1
        if quarters < 0:
            return n
    return len(s)


def fence_of(block: str) -> str:
    """The marks that open a fenced block, else nothing."""
    head = block.lstrip().split("\n", 1)[0].strip()
    run = len(head) - len(head.lstrip(head[:1])) if head[:1] in ("`", "~") and head else 0
    return head[:run] if run >= 3 else ""


def soft_cut(rest: str, limit: int) -> int:
    """After the last sentence, line or word that ends within ``limit`` characters, else there."""
    if len(rest) <= limit:
        return len(rest)
    for mark in (". ", "\n", " "):
        at = rest.rfind(mark, 0, limit)
        if at >= 0:
            return at + len(mark)
    return limit


class Text:
    """One text's blocks, with what they cost before each."""

    def __init__(self, blocks: list[str], costs: list[int], paths: list[str]):
        self.blocks, self.costs, self.paths = blocks, costs, paths
        self.sums = [0]
        for c in costs:
            self.sums.append(self.sums[-1] + c)

    def preamble(self, at: int, budget: int, overlap: int) -> str:
        """Where a page sits, and the tail of the one before, a quarter of the budget at most."""
        if at == 0:
            return ""
        low, room = at, budget // 4
        while low > max(0, at - overlap) and self.sums[at] - self.sums[low - 1] <= room:
            low -= 1
        under = f' under "{self.paths[at]}"' if self.paths[at] else ""
        if low == at:
            return f"*(continuing{under})*\n\n"
        return f"*(continuing{under}; everything above the rule repeats the end of the previous page)*\n\n" + "\n\n".join(self.blocks[low:at]) + "\n\n---\n\n"

    def fill(self, at: int, off: int, budget: int, prefix: str) -> tuple[str, int, int, int]:
        """(page, next block, next offset, blocks returned)."""
        out, used, got = [prefix] if prefix else [], tokens(prefix), 0
        n = len(self.blocks)
        if off:  # what is left of a block, its fence opened again
            rest, fence = self.blocks[at][off:], fence_of(self.blocks[at])
            head = self.blocks[at].split("\n", 1)[0].strip() if fence else ""
            cost = tokens(rest) + tokens(head)
            if used + cost <= budget:
                out.append(f"{head}\n{rest}" if head else rest)
                used, got, at, off = used + cost, 1, at + 1, 0
        if not off:
            end = max(at, bisect_right(self.sums, self.sums[at] + budget - used, at) - 1)
            out += self.blocks[at:end]
            used, got, at = used + self.sums[end] - self.sums[at], got + end - at, end
        room = budget - used
        if at < n and room > 0 and (got == 0 or (room >= LEAST_FILL and room * 4 >= budget)):
            whole = self.blocks[at]
            rest, fence = whole[off:], fence_of(whole)
            head = whole.split("\n", 1)[0].strip() if off and fence else ""
            limit = max(chars_within(rest, max(0, room * 4 - (len(fence) + len(head) + 2 if fence else 0) - 6)), int(got == 0))
            cut = soft_cut(rest, limit)
            if got:  # only after a whole row, line, sentence or word
                cut = rest.rfind("\n", 0, limit) + 1 if fence or whole.lstrip().startswith("|") else 0 if cut == limit < len(rest) else cut
            if cut > 0:
                part = rest[:cut].rstrip()
                out.append((f"{head}\n" if head else "") + part + (f"\n{fence}" if fence and cut < len(rest) else ""))
                off, got = off + cut, got + 1
        return "\n\n".join(out), at, off, got

    def pages(self, at: int, off: int, budget: int, overlap: int) -> Iterator[tuple]:
        """(block, offset, page, next block, next offset, blocks) from a place on."""
        if at >= len(self.blocks):
            at = off = 0
        while at < len(self.blocks):
            before = "" if off else self.preamble(at, budget, overlap)
            page, block, place, got = self.fill(at, off, budget, before)
            if not got and before:  # no room beside the preamble: progress comes first
                page, block, place, got = self.fill(at, off, budget, "")
            if block < len(self.blocks) and place >= len(self.blocks[block]):
                block, place = block + 1, 0
            yield at, off, page, block, place, got
            if not got:
                return
            at, off = block, place


PAGE = "page int, block int, offset int, content string, tokens bigint, next_block int, next_offset int, blocks int, stale boolean"

#: Characters of pages that make a batch.
BATCH = 4 << 20


def take(blocks: DataFrame, key: str, budget: int, overlap: int = 0, cursors: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Pages of texts given as blocks (key, block, text, path, digest): a row a page, ``next_block`` null after the last.

    ``cursors`` (key, block, offset, digest) says where a text goes on; one whose digest is no longer the text's starts
    over and is called stale. Without, all texts start at their beginning. ``most``: so many pages of each.
    """
    one = F.struct("block", "text", "path", F.col("digest").cast("string").alias("digest"))
    per = blocks.select(key, one.alias("b")).groupBy(key).agg(F.array_sort(F.collect_list("b"), lambda x, y: x["block"] - y["block"]).alias("b"))
    texts = per.select(key, F.transform("b", lambda x: x["text"]).alias("texts"), F.transform("b", lambda x: x["path"]).alias("paths"), F.get("b", F.lit(0))["digest"].alias("digest"))
    return take_listed(texts, key, budget, overlap, cursors, most)


def take_listed(texts: DataFrame, key: str, budget: int, overlap: int = 0, cursors: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """As :func:`take`, of texts as rows (key, texts and paths: an entry a block, digest). Nothing is shuffled for them;
    ``paths`` may be null."""
    kind = texts.schema[key].dataType.simpleString()
    cost = F.transform("texts", T.token_estimate)
    rows = texts.filter(F.size("texts") > 0).select(key, "texts", cost.alias("costs"), "paths", F.col("digest").cast("string").alias("digest"))
    if cursors is None:
        rows = rows.withColumns({"_at": F.lit(0), "_off": F.lit(0), "_was": F.lit(None).cast("string")})
    else:
        rows = rows.join(cursors.select(key, F.col("block").cast("int").alias("_at"), F.col("offset").cast("int").alias("_off"), F.col("digest").cast("string").alias("_was")), key)

    def run(batches):
        import pyarrow as pa

        types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        names = [key, *[c.split()[0] for c in PAGE.split(", ")]]

        def made(batch, out):
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *[pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]], names=names)

        for batch in batches:
            out, size = [], 0
            for row in zip(*batch.columns, strict=True):
                i, texts, costs, paths, digest, at, off, was = (x.as_py() for x in row)
                stale = was is not None and was != digest
                at, off = (0, 0) if stale else (at, off)
                text = Text(texts, costs, [p or "" for p in paths] if paths else [""] * len(texts))
                for k, (b, o, page, nb, no, got) in enumerate(text.pages(at, off, budget, overlap)):
                    over = nb >= len(text.blocks)
                    out.append((i, k, b, o, page, tokens(page), None if over else nb, None if over else no, got, stale))
                    size += len(page) + 100
                    if size > BATCH:
                        yield made(batch, out)
                        out, size = [], 0
                    if most and k + 1 >= most:
                        break
            if out:
                yield made(batch, out)

    return rows.mapInArrow(run, f"{key} {kind}, {PAGE}")


def text_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block from 0, text, path, digest) of markdown texts, for :func:`take`."""
    b = B.heading_path(B.markdown_blocks(docs, key, text), key, "block", "text")
    return b.withColumn("block", (F.col("block") - 1).cast("int")).join(docs.select(key, F.md5(text).alias("digest")), key).select(key, "block", "text", "path", "digest")
