"""Helpers shared by the training-data operators: scratch tables, distributed order, input shaping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Unset in a local session: make one; elsewhere an
    error, as a folder of one machine loses what the others write."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; :func:`release` removes those handed out so far."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Remove scratch tables whose consumers have been written."""
    while _SCRATCH:
        delete_path(spark, _SCRATCH.pop())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder, read back. Survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Hand freed memory back to the system: Python workers live on from task to task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def tidy(run):
    """A function over Arrow or pandas batches that trims when its task is done."""

    def inner(batches):
        yield from run(batches)
        trim()

    return inner


#: Session settings for batches of whole texts, and the defaults that they replace.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000")}


def small_batches(spark: SparkSession) -> None:
    """Fewer rows to a batch, as texts can be long, unless the session has its own setting.

    Spark reads it when the job runs, after the operator has returned its DataFrame, so it stays set.
    """
    for key, (default, value) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the wanted columns, under inner names, so further columns of any name cannot clash."""
    return df.select(*[df[c].alias(a) for a, c in cols.items()])


def quantile_bounds(df: DataFrame, col: str, parts: int) -> tuple[list[int], list[int]]:
    """(at most ``parts - 1`` ascending cut points of an integer column, values that fill a whole part or more).

    One small row comes to the driver.
    """
    if parts < 2:
        return [], []
    q = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(col, q, 10_000).alias("q")).first()
    cuts = row["q"] or []
    return sorted(set(cuts)), sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})


def range_bucket(col: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the value, by binary search: contiguous ranges in order; null is range -1."""
    if not bounds:
        return F.when(col.isNull(), -1).otherwise(0)
    arr = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to one literal
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        open_, here = acc["low"] < acc["high"], F.get(arr, mid) <= col
        return F.struct(F.when(open_ & here, mid + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~here, mid).otherwise(acc["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.when(col.isNull(), -1).otherwise(F.aggregate(steps, start, halve, lambda a: a["low"]))


def by_hash(tie: Column) -> Column:
    """0 to 63 by the top bits of a hash, in its order."""
    return (F.shiftright(tie, 58) + 32).cast("long")


def ordered_bucket(value: Column, bounds: list[int], hot: list[int], fine: Column, n_fine: int = 64) -> Column:
    """A bucket monotone in (value, fine), nulls first. Rows of null and of each value in ``hot`` are dealt to buckets by
    ``fine`` (0 to ``n_fine`` - 1); a hot value is a bound, so its rows come first in its range."""
    crowded = value.isNull() | value.isin(hot) if hot else value.isNull()
    return (range_bucket(value, bounds).cast("long") + 1) * (n_fine + 1) + F.when(crowded, fine.cast("long")).otherwise(F.lit(n_fine).cast("long"))


#: A key is hot if it has more rows than this and than a quarter of a task's even share.
HOT_ROWS = 1000


def hot_keys(keys: DataFrame, key: str) -> DataFrame:
    """Keys of so many rows, written: at most four times the shuffle partitions of them."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(HOT_ROWS, keys.count() // (4 * parts))
    return materialize(keys.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least).select(key), "hot-keys")


def join_hot(left: DataFrame, right: DataFrame, key: str, tie: str, how: str = "inner", spread: int = 32, keys: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """``left.join(right, key, how)`` where ``right`` has one row a key and ``left`` may hold one key very often.
    ``keys``: a frame with the keys of ``left`` that is cheaper to read. ``hot``: its :func:`hot_keys`, where known.

    Hot keys are few, so the list of them is broadcast; their rows on the left are dealt to ``spread`` tasks by a hash
    of ``tie``, and on the right are copied to each of those.
    """
    if hot is None:
        hot = hot_keys(left if keys is None else keys, key)
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    a = left.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(tie), F.lit(spread)).cast("int")).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return a.join(b, [key, "_salt"], how).drop("_salt")


def exclusive_prefix(df: DataFrame, value: str, out: str, keys: list[str], bucket: str, order: list[Column]) -> DataFrame:
    """``out`` = sum of ``value`` over earlier rows of the same ``keys``, in (bucket, order) order.

    No group is gathered in one task: rows are summed within (keys, bucket), bucket totals (one row per
    key and bucket) are prefix-summed, and the two are added. ``bucket`` must be monotone in the order.
    """
    w_in = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    w_bk = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_tot"))
    totals = totals.withColumn("_base", F.coalesce(F.sum("_tot").over(w_bk), F.lit(0))).drop("_tot")
    inner = df.withColumn("_in", F.coalesce(F.sum(value).over(w_in), F.lit(0)))
    a, b = inner.alias("a"), totals.alias("b")
    cond = F.lit(True)
    for k in [*keys, bucket]:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, cond).select("a.*", (F.col("a._in") + F.col("b._base")).alias(out)).drop("_in")
