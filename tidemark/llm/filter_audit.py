"""Filter interaction audit: five filters in all 120 orders, with exact duplicates found in radix text tries.

One scan judges each text by the four filters of its own and keeps what the fifth needs: a slim row for each document
(id, part, failures, digest), and, once for each distinct text of a task's stretch, the text with its least id. Texts
are dealt by adaptive prefixes: a prefix that holds too many bytes gives way to one four times as long, until its texts
part or end. Ranges of these prefixes go to tasks, each of which inserts its whole texts into a compressed radix trie
whose terminals hold the least id; the traversal names the texts that several rows have. Slim rows meet those by digest
and are reduced to counts by part and mask of failures, from which all orders follow by arithmetic on 32 masks.

So a text that a third of all rows hold travels once from each stretch, and no task sees its rows together.

Null and empty texts are one text; null sources and empty ones are one part; null ids come after all others, so a row of
null id is a duplicate of any other with its text, and are in no label; rows that repeat an id and text count each and are no
duplicates of one another. Of labels that repeat an id, one with quality or toxic of 1 counts. Empty tables give no
rows, very long texts are read whole, further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, materialize, pick, scratch, small_batches, tidy
from .decontaminate import slices

FILTERS = "ABCDE"
BIT = {c: 1 << i for i, c in enumerate(FILTERS)}
MIN_WORDS = 200
SIGNS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
#: Bytes of the prefixes that texts are dealt by: each where the one before is too common.
LENGTHS = [8 * 4**k for k in range(16)]
#: Bytes of distinct texts that a task holds while it scans, and about those that it inserts into a trie.
HELD, TRIE_BYTES = 64_000_000, 64_000_000


def failures(raw: bytes, chars: int) -> int:
    """Mask of the filters A to D that a text fails. ``bytes.split`` parts at the six ASCII blanks."""
    words = raw.split()
    few = len(words) < MIN_WORDS
    dull = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 2 * chars
    return few * BIT["A"] | dull * BIT["B"] | loud * BIT["C"] | (SIGNS.search(raw) is not None) * BIT["D"]


def least(a, b):
    """The lesser id; null is greater than all."""
    return b if a is None else a if b is None else min(a, b)


def prefix_keys(raw: bytes) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(raw[:n]) - (1 << 63) for n in LENGTHS if n < len(raw)]


def scanned(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(slim rows: id, part, mask, digest; texts: digest, text, low, n, prefixes, size), both written by one scan."""
    import pyarrow as pa

    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    names = ["is_text", "id", "part", "mask", "digest", "text", "n", "prefixes", "size"]

    def run(batches):
        types = [pa.bool_(), None, pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        seen: dict[bytes, list] = {}
        held = 0

        def made(id_type, *columns):
            types[1] = id_type
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def flush(id_type):
            rows = [(t, *v) for t, v in seen.items()]
            seen.clear()
            for low in range(0, len(rows), 500):
                some = rows[low : low + 500]
                none = [None] * len(some)
                yield made(id_type, [True] * len(some), [r[1] for r in some], none, none, [r[3] for r in some], [r[0] for r in some], [r[2] for r in some], [prefix_keys(r[0]) for r in some], [len(r[0]) for r in some])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in slices(batch, 1):
                ids, masks, digests = part.column(0).to_pylist(), [], []
                for i, text in zip(ids, part.column(1), strict=True):
                    text = text.as_py() or ""
                    raw = text.encode()
                    masks.append(failures(raw, len(text)))
                    known = seen.get(raw)
                    if known is None:
                        seen[raw] = known = [i, 0, hashlib.sha256(raw).digest()]
                        held += len(raw) + 200
                    known[0], known[1] = least(known[0], i), known[1] + 1
                    digests.append(known[2])
                none = [None] * len(ids)
                yield made(id_type, [False] * len(ids), ids, [s or "" for s in part.column(2).to_pylist()], masks, digests, none, none, none, none)
                if held > HELD:
                    yield from flush(id_type)
                    held = 0
        if id_type is not None:
            yield from flush(id_type)

    small_batches(spark)
    schema = f"is_text boolean, id {kind}, part string, mask int, digest binary, text binary, n bigint, prefixes array<bigint>, size bigint"
    path = scratch(spark, "audit-scan")
    pick(docs, id=id_col, t=text_col, s=source_col).mapInArrow(tidy(run), schema).write.option("compression", "zstd").partitionBy("is_text").parquet(path)
    both = spark.read.schema(schema).parquet(path)
    return both.filter("not is_text").select("id", "part", "mask", "digest"), both.filter("is_text").select("digest", "text", F.col("id").alias("low"), "n", "prefixes", "size")


class Node:
    """An edge's label, the nodes below by next byte, and at a terminal (least id, rows, digest)."""

    __slots__ = ("end", "label", "next")

    def __init__(self, label: bytes):
        self.label, self.next, self.end = label, {}, None


def common_length(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` shares with ``b`` from ``at``, by halving: comparisons run over whole slices."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, raw: bytes, low, n: int, digest: bytes) -> None:
        node, at = self.root, 0
        while at < len(raw):
            below = node.next.get(raw[at])
            if below is None:
                below = node.next[raw[at]] = Node(raw[at:])
                node, at = below, len(raw)
                break
            same = len(below.label) if raw.startswith(below.label, at) else common_length(below.label, raw, at)
            if same < len(below.label):
                middle = node.next[raw[at]] = Node(below.label[:same])
                below.label = below.label[same:]
                middle.next[below.label[0]] = below
                below = middle
            node, at = below, at + same
        node.end = (low, n, digest) if node.end is None else (least(node.end[0], low), node.end[1] + n, digest)

    def terminals(self):
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.end is not None:
                yield node.end
            stack.extend(node.next.values())


def shared_texts(texts: DataFrame) -> DataFrame:
    """(digest, low) of the texts that more than one row has: prefix ranges, one trie a task."""
    spark, kind = texts.sparkSession, texts.schema["low"].dataType.simpleString()
    total = texts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TRIE_BYTES)
    weights = texts.select("size", F.posexplode("prefixes").alias("level", "p")).groupBy("level", "p").agg(F.sum("size").alias("b"))
    # at most 4 x parts of a level, and those of the deep levels only where texts share so long a beginning
    heavy = frozenset((r["level"], r["p"]) for r in weights.filter(F.col("b") > max(1, total // (4 * parts))).select("level", "p").collect())

    @F.pandas_udf("int")
    def taken(prefixes: pd.Series) -> pd.Series:
        out = []
        for row in prefixes:
            k = 0
            while k < len(row) and (k, row[k]) in heavy:
                k += 1
            out.append(LENGTHS[k])
        return pd.Series(out, dtype="int32")

    def run(batches):
        import pyarrow as pa

        trie, id_type = Trie(), None
        for batch in batches:
            id_type = batch.schema.field(2).type
            for digest, text, low, n in zip(*(batch.column(k) for k in range(4)), strict=True):
                trie.insert(text.as_py(), low.as_py(), n.as_py(), digest.as_py())
        if id_type is not None:
            some = [e for e in trie.terminals() if e[1] > 1]
            yield pa.RecordBatch.from_arrays([pa.array([e[2] for e in some], pa.binary()), pa.array([e[0] for e in some], id_type)], names=["digest", "low"])

    keyed = texts.withColumn("key", F.substring("text", F.lit(1), taken("prefixes"))).select("digest", "text", "low", "n", "key")
    return keyed.repartitionByRange(parts, "key").mapInArrow(tidy(run), f"digest binary, low {kind}")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", source_col="source", label_id="doc_id") -> DataFrame:
    """part, mask (of failures), n, good, toxic: rows, those of quality 1 and those of toxic 1."""
    slim, texts = scanned(docs, id_col, text_col, source_col)
    twice = materialize(shared_texts(texts), "audit-shared")
    slim = materialize(slim.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("rows")), "audit-slim")
    met = join_hot(slim, twice, "digest", "id", "left", hot=hot_keys(slim, "digest"))
    again = F.coalesce(F.col("id") > F.col("low"), F.col("id").isNull() & F.col("low").isNotNull())
    judged = materialize(met.select("id", "part", "digest", F.when(again, F.col("mask") + BIT["E"]).otherwise(F.col("mask")).alias("mask"), "rows"), "audit-judged")
    marks = labels.select(labels[label_id].alias("id"), labels["quality"].alias("q"), labels["toxic"].alias("t")).groupBy("id").agg(
        F.max(F.when(F.col("q") == 1, 1).otherwise(0)).alias("q"), F.max(F.when(F.col("t") == 1, 1).otherwise(0)).alias("t")
    )
    marks = materialize(marks.filter("id is not null and (q = 1 or t = 1)"), "audit-marks")
    marked = join_hot(judged.filter("id is not null"), marks, "id", "digest", keys=judged.filter("id is not null").select("id"))
    every = judged.select("part", "mask", F.col("rows").alias("n"), F.lit(0).cast("bigint").alias("g"), F.lit(0).cast("bigint").alias("t"))
    every = every.unionAll(marked.select("part", "mask", F.lit(0).cast("bigint"), F.col("rows") * F.col("q"), F.col("rows") * F.col("t")))
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("g").alias("good"), F.sum("t").alias("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, the step's filter, the filters before it) of all orders."""
    return [("".join(o), k + 1, BIT[c], sum(BIT[x] for x in o[:k])) for o in permutations(FILTERS) for k, c in enumerate(o)]


def audit(counts: DataFrame) -> DataFrame:
    """Every part, order and step, from the at most 32 masks of a part."""
    of_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    each = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("bit"), F.lit(x).alias("before")) for o, k, b, x in steps()])
    rows = of_part.select("part", "m", F.explode(each).alias("s"))
    bit, before = F.col("s.bit"), F.col("s.before")

    def total(where, value=lambda x: x["n"]):
        return F.aggregate(F.filter("m", where), F.lit(0).cast("bigint"), lambda a, x: a + value(x))

    def fails(x):
        return x["mask"].bitwiseAND(bit) != 0

    def open_(x):
        return x["mask"].bitwiseAND(before) == 0

    return rows.select(
        "part", "s.filter_order", "s.step",
        total(lambda x: open_(x) & ~fails(x)).alias("kept"),
        total(lambda x: open_(x) & fails(x)).alias("removed"),
        total(lambda x: ~open_(x) & fails(x)).alias("redundant"),
        total(lambda x: x["mask"] == bit).alias("unique_fails"),
        total(lambda x: open_(x) & fails(x), lambda x: x["good"]).alias("good_lost"),
        total(lambda x: open_(x) & fails(x), lambda x: x["toxic"]).alias("toxic_lost"),
        # of k failing filters each comes first in 120 / k orders
        total(fails, lambda x: x["n"] * (F.lit(120) / F.bit_count(x["mask"])).cast("bigint")).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All documents: null text is empty, null source is the part ''; an empty table gives no rows."""
    return audit(failure_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), f AS (
  SELECT doc_id, part,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t)
             OR (doc_id IS NULL AND min(doc_id) OVER (PARTITION BY t) IS NOT NULL) THEN 16 ELSE 0 END AS mask
  FROM w
), l AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS q, max((coalesce(toxic, 0) = 1)::INT) AS t FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(q, 0)) AS g, sum(coalesce(t, 0)) AS t, 120 // greatest(bit_count(mask), 1) AS turns
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask
), b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, bit)),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM b a, b b, b c, b d, b e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, k::INT AS step, bits[k] AS bit, list_sum(bits[1:k - 1])::INT AS before FROM o, range(1, 6) r(k)
)
SELECT part, filter_order, step,
  sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & coalesce(before, 0) <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN g ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN t ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & bit <> 0 THEN n * turns ELSE 0 END)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step, bit, before
"""
