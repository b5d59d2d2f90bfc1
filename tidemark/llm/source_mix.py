"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. Native.

Each source's words, documents in ``doc_id`` order, form one stream that is cut into equal blocks. A source's
target becomes an exact quota of blocks. A binary tree over the output shards splits the vector of quotas:
at each node the left half's share of every source is one multivariate-hypergeometric draw, so shards get
equal block counts and sources keep exact quotas. Blocks then take a keyed random permutation of their
source's index range (swap-or-not, a bijection on any range), and each shard draws its leaf's count of them, a
disjoint interval of the permuted order; a quota above one pass continues with a new permutation. Within its shard
a block stands where a random key sorts it. The mix is written shard by shard in that order.

The number of shards follows the words of the mix (``SHARD_WORDS``), so a shard fits one task at any scale; drawn blocks find
their shard by a join with the leaves, whose rows are sources x shards, so no row grows with the shards. Sources
are a list that an operator weighs, ``MAX_SOURCES`` at most; more are an error.

Null text has size 0: no block holds it, and only the form in whole documents keeps it, once. A null source is a
source of its own, ordered last; repeated rows count each, ties by size; an empty table gives an empty result; very
long texts are many blocks; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_hash, exclusive_prefix, materialize, ordered_bucket, pick, quantile_bounds

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 20
ATTEMPTS = 48
MAX_REPEAT = 3
#: Sources at most; their table is broadcast and their quotas are one array per node of the tree.
MAX_SOURCES = 10_000
#: Words to a shard, about, and to a task's share of the blocks before they are cut.
SHARD_WORDS = 4_000_000
LEAST_SHARDS = 16


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit_random(*key: Column) -> Column:
    """Uniform on (0, 1), a function of its key alone."""
    bits = F.xxhash64(*key).bitwiseAND(F.lit((1 << 52) - 1))
    return (bits.cast("double") + 0.5) / float(1 << 52)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, shifted by 8 so that small n are as exact."""
    y = n + 9.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    product = F.lit(1.0)
    for k in range(1, 9):
        product = product * (n + float(k))
    return series - F.log(product)


def hypergeometric(good: Column, total: Column, draws: Column, *key: Column) -> Column:
    """One draw of how many of ``good`` among ``total`` items fall into ``draws``, by ratio of uniforms.

    Work is the same at any size: a fixed number of attempts, of which each succeeds with a chance above 1/2.
    """
    def of(v: Column) -> Column:
        g, t, d, mean, mode, width = (v[k] for k in ("g", "t", "d", "mean", "mode", "width"))

        def log_weight(x: Column) -> Column:
            parts = F.array(x, g - x, d - x, t - g - d + x)
            return -F.aggregate(F.transform(parts, log_factorial), F.lit(0.0), lambda a, y: a + y)

        def attempt(k: Column) -> Column:
            u = unit_random(*key, k, F.lit(0))
            z = F.floor(mean + 0.5 + width * (unit_random(*key, k, F.lit(1)) - 0.5) / u).cast("double")
            tried = F.struct(u.alias("u"), z.alias("x"), ((z >= v["low"]) & (z <= v["high"])).alias("ok"))
            keep = lambda a: F.when(a["ok"] & (2 * F.log(a["u"]) <= log_weight(F.when(a["ok"], a["x"]).otherwise(mode)) - v["top"]), a["x"])
            return let(tried, keep)

        tries = F.filter(F.transform(F.sequence(F.lit(1), F.lit(ATTEMPTS)), attempt), lambda x: x.isNotNull())
        return F.when(v["low"] >= v["high"], v["low"]).otherwise(F.coalesce(F.get(tries, F.lit(0)), mode)).cast("long")

    def shaped(v: Column) -> Column:
        g, t, d = v["g"], v["t"], v["d"]
        low, high, mean = F.greatest(F.lit(0.0), d - (t - g)), F.least(g, d), d * g / t
        var = mean * (1 - g / t) * (t - d) / F.greatest(t - 1, F.lit(1.0))
        mode = F.least(F.greatest(F.floor((d + 1) * (g + 1) / (t + 2)).cast("double"), low), high)
        width = 2 * math.sqrt(2 / math.e) * F.sqrt(var + 0.5) + (3 - 2 * math.sqrt(3 / math.e))
        return F.struct(g.alias("g"), t.alias("t"), d.alias("d"), low.alias("low"), high.alias("high"), mean.alias("mean"), mode.alias("mode"), width.alias("width"))

    def topped(v: Column) -> Column:
        parts = F.array(v["mode"], v["g"] - v["mode"], v["d"] - v["mode"], v["t"] - v["g"] - v["d"] + v["mode"])
        return v.withField("top", -F.aggregate(F.transform(parts, log_factorial), F.lit(0.0), lambda a, y: a + y))

    asked = F.struct(good.cast("double").alias("g"), F.greatest(total.cast("double"), F.lit(1.0)).alias("t"), draws.cast("double").alias("d"))
    return let(let(let(asked, shaped), topped), of)


def split_node(quota: Column, node: Column, seed: int) -> Column:
    """The left child's share of each source: a multivariate-hypergeometric draw of half the blocks."""
    total = F.aggregate(quota, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(
        total.alias("rest"), F.floor(total / 2).cast("long").alias("open"), F.array().cast("array<bigint>").alias("out"), F.lit(0).alias("i")
    )

    def step(acc: Column, q: Column) -> Column:
        def with_draw(x: Column) -> Column:
            return F.struct(
                (acc["rest"] - q).alias("rest"), (acc["open"] - x).alias("open"), F.concat(acc["out"], F.array(x)).alias("out"), (acc["i"] + 1).alias("i")
            )

        return let(hypergeometric(q, acc["rest"], acc["open"], F.lit(seed), node, acc["i"]), with_draw)

    return F.aggregate(quota, start, step, lambda a: a["out"])


def source_targets(sizes: DataFrame, weights: list[float], block: int) -> DataFrame:
    """One row per source: size, target by capped re-sharing, block length, block count and block quota.

    The re-sharing ends where every open source has the same target per weight, so it is found in one sweep
    over the sources in the order in which they reach their caps.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    cap = F.lit(float(MAX_REPEAT)) * F.col("source_size")
    per = per.withColumn("w", weight).withColumn("cap", cap).withColumn("reach", cap / F.col("w"))
    whole = Window.orderBy("reach", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("reach", "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level).withColumn("capped", F.col("level") > F.col("reach"))
    open_level = F.min(F.when(~F.col("capped"), F.struct("reach", "rank", "level"))).over(whole)["level"]
    per = per.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(open_level * F.col("w")))
    # 1,024 blocks of at most ``block`` words in a small source, a million of at most 64 times as many in a large one
    b = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / 1024)), F.least(F.lit(64 * block), F.floor(F.col("source_size") / (1 << 20)))).cast("long")
    per = per.withColumn("block", b).withColumn("n_blocks", F.ceil(F.col("source_size") / b).cast("long"))
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long")
    return per.withColumn("quota", quota).select("source", "rank", "source_size", "target", "block", "n_blocks", "quota")


def leaves(per_source: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, shard, first, end): the interval of a source's permuted blocks that each shard draws, empty ones left out.
    One row for each source and shard; the tree is split level by level, each written."""
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    quotas = F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"])
    nodes = per_source.agg(quotas.alias("q")).select(F.lit(1).cast("long").alias("node"), "q")
    for _ in range(int(math.log2(shards))):
        nodes = nodes.withColumn("left", split_node(F.col("q"), F.col("node"), seed))
        right = F.zip_with("q", "left", lambda a, b: a - b)
        child = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q"))))
        nodes = materialize(nodes.select(child.alias("c")).select("c.node", "c.q"), "mix-nodes")
    leaf = nodes.select((F.col("node") - shards).alias("shard"), F.posexplode("q").alias("rank", "n"))
    leaf = leaf.withColumn("end", F.sum("n").over(Window.partitionBy("rank").orderBy("shard")))
    return leaf.select("rank", F.col("shard").cast("int").alias("shard"), (F.col("end") - F.col("n")).alias("first"), "end", "n")


def shard_intervals(per_source: DataFrame, shards: int, seed: int) -> DataFrame:
    """Per source rank, the ``shards`` upper ends of the shards' intervals of its permuted blocks, as a report."""
    listed = leaves(per_source, shards, seed).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("shard", "end"))).alias("e"))
    return listed.select("rank", F.transform("e", lambda x: x["end"]).alias("ends"))


def in_shards(draws: DataFrame, per_source: DataFrame, shards: int, seed: int) -> DataFrame:
    """``draws`` (rank, quota, at, ...) with the shard whose leaf holds ``at``.

    A source's permuted order is cut into as many equal bins as there are shards; a leaf of average length reaches into two.
    Draws and leaves meet by bin, so a drawn row costs the same however many shards there are, and a bin holds an average
    shard's share of its source.
    """
    def of(at: Column) -> Column:
        return F.floor(at * F.lit(shards) / F.col("quota")).cast("long")

    leaf = leaves(per_source, shards, seed).filter("n > 0").join(F.broadcast(per_source.select("rank", "quota")), "rank")  # MAX_SOURCES rows at most
    leaf = leaf.select("rank", "shard", "first", "end", F.explode(F.sequence(of(F.col("first")), of(F.col("end") - 1))).alias("bin"))
    met = draws.withColumn("bin", of(F.col("at"))).join(leaf, ["rank", "bin"])
    return met.filter((F.col("first") <= F.col("at")) & (F.col("at") < F.col("end"))).drop("bin", "first", "end")


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A keyed permutation of [0, n): swap-or-not rounds folded over the round numbers."""

    def turn(x: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        high = F.greatest(x, mate)
        swap = F.xxhash64(*key, r, high).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mate).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), turn)


def plan_mix(docs: DataFrame, weights: list[float], id_col="doc_id", text_col="text", source_col="source", block: int = 64, shards: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents, draws).

    documents: id, source, size, offset (words of the source's stream before it), source_size, target.
    draws: one row per drawn block and document in it: shard, order_key (the block's place in its shard), source,
    offset, epoch, words, first (the document begins in this block). A shard's blocks of a source are as many as
    its leaf of the tree says.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = pick(docs, id=id_col, t=text_col, source=source_col)
    sizes = inner.select("id", "source", F.coalesce(F.regexp_count("t", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("t").alias("h"))
    sizes = materialize(sizes, "mix-sizes")
    bucket = ordered_bucket(F.col("id"), *quantile_bounds(sizes, "id", parts), by_hash(F.col("h")))
    placed = exclusive_prefix(sizes.withColumn("bucket", bucket), "size", "offset", ["source"], "bucket", [F.col("id"), F.col("h"), F.col("size")])
    per = materialize(source_targets(sizes, weights, block), "mix-sources")
    of_all = per.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quota") * F.col("block")).alias("words")).first()
    if of_all["n"] > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: weigh groups of them")
    words = of_all["words"] or 0
    shards = shards or max(LEAST_SHARDS, 1 << math.ceil(math.log2(max(1, words / SHARD_WORDS))))
    plan = F.broadcast(per)  # MAX_SOURCES rows at most
    placed = materialize(
        placed.alias("d").join(plan.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.id", "d.source", "d.size", "d.h", "d.offset", "s.rank", "s.source_size", "s.target", "s.block", "s.n_blocks", "s.quota"),
        "mix-docs",
    )
    some = placed.filter((F.col("size") > 0) & (F.col("quota") > 0)).select("source", "rank", "size", "offset", "block", "n_blocks", "quota")
    some = some.repartition(max(parts, words // SHARD_WORDS))  # cutting multiplies rows: not in as few tasks as their bytes need
    first, last = F.floor(F.col("offset") / F.col("block")), F.floor((F.col("offset") + F.col("size") - 1) / F.col("block"))
    cut = some.withColumn("b", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    begin, end = F.greatest("offset", F.col("b") * F.col("block")), F.least(F.col("offset") + F.col("size"), (F.col("b") + 1) * F.col("block"))
    cut = cut.select("source", "rank", "offset", "quota", "n_blocks", "b", (end - begin).alias("words"), (begin == F.col("offset")).alias("begins"))
    passes = F.floor((F.col("quota") - 1) / F.col("n_blocks")).cast("long")
    cut = cut.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), passes)))
    at = F.col("epoch") * F.col("n_blocks") + permuted(F.col("b"), F.col("n_blocks"), F.lit(seed), F.col("rank"), F.col("epoch"))
    draws = in_shards(cut.withColumn("at", at).filter(F.col("at") < F.col("quota")), per, shards, seed)
    key = F.xxhash64(F.lit(seed), F.col("rank"), F.col("at"), F.lit(0))
    draws = draws.select("shard", key.alias("order_key"), "source", "offset", "epoch", "words", F.col("begins").alias("first"))
    return placed.select("id", "h", "source", "size", "offset", "source_size", "target"), draws


def mixed_blocks(draws: DataFrame) -> DataFrame:
    """The mix itself: the draws, and ``pos``, the place of each in its shard. A shard is one bounded group."""
    w = Window.partitionBy("shard").orderBy("order_key", "source", "offset", "epoch")
    return draws.withColumn("pos", F.row_number().over(w).cast("long") - 1)


def taken_words(docs: DataFrame, weights: list[float], **how) -> DataFrame:
    """Per input row: id, size, source_size, target, taken (words of it in all shards of the mix), shard_words (words
    by shard, ``shard:words`` joined by commas), first_shard and first_pos (where the mix first takes of it)."""
    placed, draws = plan_mix(docs, weights, **how)
    mix = mixed_blocks(draws)
    by_shard = mix.groupBy("source", "offset", "shard").agg(F.sum("words").alias("words"), F.min("pos").alias("pos"))
    listed = F.array_sort(F.collect_list(F.struct("shard", "words")))
    place = F.min(F.struct("shard", "pos"))
    taken = by_shard.groupBy("source", "offset").agg(F.sum("words").alias("taken"), listed.alias("l"), place.alias("place"))
    text = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["words"].cast("string"))), ",")
    taken = taken.select("source", "offset", "taken", text.alias("shard_words"), F.col("place.shard").alias("first_shard"), F.col("place.pos").alias("first_pos"))
    p, t = placed.alias("p"), taken.alias("t")
    same = F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.offset") == F.col("t.offset")) & (F.col("p.size") > 0)
    return p.join(t, same, "left").select(
        "p.id", "p.size", "p.source_size", "p.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("t.shard_words", F.lit("")).alias("shard_words"), "t.first_shard", "t.first_pos",
    )


def mixed_documents(docs: DataFrame, weights: list[float], id_col="doc_id", text_col="text", source_col="source", seed: int = 7, **how) -> DataFrame:
    """The mix in whole documents: each row as often as the block that it begins in is drawn, in that block's shard and
    place, so that the result's partitions hold shards in their local order.

    Rows without words take nothing of any quota and stay once, in shard 0. Columns are those of ``docs``. Rows are
    matched by id, source and text hash; repeated rows of all three share their copies in some order.
    """
    placed, draws = plan_mix(docs, weights, id_col, text_col, source_col, seed=seed, **how)
    places = draws.filter("first").groupBy("source", "offset").agg(F.collect_list(F.struct("shard", "order_key")).alias("at"))  # MAX_REPEAT at most
    p, t = placed.alias("p"), places.alias("t")
    same = F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.offset") == F.col("t.offset")) & (F.col("p.size") > 0)
    once = F.array(F.struct(F.lit(0).alias("shard"), F.xxhash64("p.id", "p.h").alias("order_key")))
    per = p.join(t, same, "left").select(F.col("p.id").alias("_k"), F.col("p.h").alias("_h"), F.col("p.source").alias("_s"), F.col("p.offset").alias("_o"), F.when(F.col("p.size") == 0, once).otherwise(F.col("t.at")).alias("_at"))
    w = Window.partitionBy("_k", "_h", "_s")
    per = per.withColumn("_i", F.row_number().over(w.orderBy("_o"))).filter("_at is not null").drop("_o")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_k"), F.xxhash64(docs[text_col]).alias("_h"), docs[source_col].alias("_s"))
    whole = whole.withColumn("_i", F.row_number().over(w.orderBy(F.xxhash64("_row"))))
    a, b = whole.alias("a"), per.alias("b")
    cond = F.lit(True)
    for c in ("_k", "_h", "_s", "_i"):
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = a.join(b, cond).select("a._row", F.explode("b._at").alias("_p")).select("_row", "_p.shard", "_p.order_key")
    out = out.repartition("shard").sortWithinPartitions("shard", "order_key", F.xxhash64("_row"))
    return out.select("_row.*")


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    """All documents, weights 1, 2, 3 by source; null text has size 0, an empty table gives no rows."""
    out = taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1, 2, 3])
    return out.withColumnRenamed("id", "doc_id")
