"""Near-duplicates by simhash bands, leaders, boilerplate and site templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.hashing import bands, hamming, similarity
from tidemark.scratch import written

MAX_BITS = 3


def near_pairs(prints: DataFrame, key: str = "id", hash_col: str = "simhash", bits: int = MAX_BITS) -> DataFrame:
    """(left_id, right_id, distance) of keys whose simhashes differ in at most ``bits`` bits; 0 matches nothing.

    Of six blocks of a hash three are untouched by three bits, so an equi-join on (choice of blocks, value) loses none.
    Keys have about 32 bits, so chance meetings stay rare among billions of hashes. ``prints`` is read more than once:
    give a written table.
    Equal hashes are one vertex: copies are not multiplied out, each joins the least key of its hash.
    """
    if bits > MAX_BITS:
        raise ValueError("bands find at most three differing bits")
    rows = prints.select(F.col(key).alias("k"), F.col(hash_col).alias("h")).filter("h <> 0")
    one = rows.groupBy("h").agg(F.min("k").alias("k"))
    keyed = one.select("h", "k", F.posexplode(bands(F.col("h"))).alias("band", "v"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.k") < F.col("b.k")))
    near = near.select(F.col("a.k").alias("left_id"), F.col("b.k").alias("right_id"), hamming(F.col("a.h"), F.col("b.h")).alias("distance"))
    same = rows.join(one.withColumnRenamed("k", "first"), "h").filter("k <> first").select(F.col("first").alias("left_id"), F.col("k").alias("right_id"), F.lit(0).alias("distance"))
    return near.filter(F.col("distance") <= bits).distinct().unionAll(same)


def leaders(prints: DataFrame, pairs: DataFrame, key: str = "id", hash_col: str = "simhash") -> DataFrame:
    """(key, duplicate_of): in key order, a row joins the first leader within reach, else leads itself.

    Decided by rounds over the pair table: a row leads when no undecided or leading row before it is near; a
    row near a leader is decided once all its earlier neighbours are. Rounds are as many as the longest chain.
    They run over the least key of each hash: a copy never leads, and its first leader is that key's, or that key.
    """
    rows = prints.select(F.col(key).alias("k"), F.col(hash_col).alias("h")).distinct()
    state = written(rows.filter("h <> 0").groupBy("h").agg(F.min("k").alias("k")), "leaders-state")
    e = written(pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).join(state.select(F.col("k").alias("b")), "b", "left_semi"), "leaders-pairs")
    touched = e.select(F.col("b").alias("k")).distinct()
    lead = state.select("k").join(touched, "k", "left_anti").select("k", F.lit(None).cast("bigint").alias("duplicate_of"))
    open_ = touched
    while not open_.isEmpty():
        before = e.join(lead.select(F.col("k").alias("a"), F.col("duplicate_of").isNull().alias("leads")), "a", "left")
        status = before.join(open_.select(F.col("k").alias("b")), "b").groupBy("b").agg(
            F.min(F.when(F.col("leads"), F.col("a"))).alias("first"), F.min(F.when(F.col("leads").isNull(), F.col("a"))).alias("unknown")
        )
        ready = status.filter(F.col("unknown").isNull() | (F.col("first") < F.col("unknown"))).select(F.col("b").alias("k"), F.col("first").alias("duplicate_of"))
        ready = written(ready, "leaders-ready")
        lead = written(lead.unionByName(ready), "leaders-lead")
        open_ = open_.join(ready.select("k"), "k", "left_anti")
        open_ = written(open_, "leaders-open")
    first = state.join(lead, "k").select("h", F.col("k").alias("first"), "duplicate_of")
    own = F.when(F.col("k") != F.col("first"), F.coalesce("duplicate_of", "first")).otherwise(F.col("duplicate_of"))
    return rows.join(first, "h", "left").select(F.col("k").alias(key), own.alias("duplicate_of"))


def blocks(docs: DataFrame, key: str, site: str, text: str, least_bytes: int, sep: str = "\n") -> DataFrame:
    """Distinct blocks of a page that are long enough: (site, key, block)."""
    return docs.select(site, key, F.explode(F.array_distinct(F.split(text, sep))).alias("block")).filter(F.octet_length("block") >= least_bytes)


def boilerplate(docs: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", min_pages: int = 5, least_bytes: int = 40, share: float = 0.6) -> DataFrame:
    """Blocks on at least ceil(pages * share) pages of a site with enough pages: (site, block, on_pages, pages)."""
    pages = docs.groupBy(site).agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    on = blocks(docs, key, site, text, least_bytes).groupBy(site, "block").agg(F.count(F.lit(1)).alias("on_pages"))
    return on.join(pages, site).filter(F.col("on_pages") >= F.ceil(F.col("pages") * share))


def strip_template(docs: DataFrame, template: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", keep_share: float = 0.2) -> DataFrame:
    """(key, removed_blocks, removed_bytes, text): template blocks out, unless too little would remain."""
    lines = docs.select(key, site, F.posexplode(F.split(text, "\n")).alias("pos", "block"))
    gone = lines.join(template.select(site, "block", F.lit(True).alias("gone")), [site, "block"], "left")
    per = gone.groupBy(key).agg(
        F.count_if(F.col("gone")).alias("n"), F.sum(F.when(F.col("gone"), F.octet_length("block")).otherwise(0)).alias("cut"), F.sum(F.octet_length("block")).alias("size"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("pos", "block")))), lambda x: x["block"]), "\n").alias("kept"),
    )
    whole = (F.col("size") - F.col("cut")) < keep_share * F.col("size")
    out = docs.select(key, text).join(per, key)
    return out.select(key, F.when(whole, 0).otherwise(F.col("n")).cast("long").alias("removed_blocks"), F.when(whole, 0).otherwise(F.col("cut")).cast("long").alias("removed_bytes"), F.when(whole, F.col(text)).otherwise(F.col("kept")).alias(text))


def changes(versions: DataFrame, key: str, order: str, digest: str, simhash: str | None = None) -> DataFrame:
    """Adds ``change``: new for a key's first version, unchanged if the digest is the previous one's, else changed; with
    ``simhash`` also ``similarity`` of what changed."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(digest).over(w)
    first = F.row_number().over(w) == 1
    out = versions.withColumn("change", F.when(first, "new").when(before.eqNullSafe(F.col(digest)), "unchanged").otherwise("changed"))
    if simhash:
        out = out.withColumn("similarity", F.when(F.col("change") == "changed", similarity(F.col(simhash), F.lag(simhash).over(w))))
    return out


def plan(listed: DataFrame, known: DataFrame, key: str, modified: str, fetched: str) -> DataFrame:
    """(key, reason): new, changed, undated or unchanged; silence about a date is not 'unchanged'."""
    j = listed.join(known, key, "left")
    reason: Column = F.when(F.col(fetched).isNull(), "new").when(F.col(modified).isNull(), "undated").when(F.col(modified) > F.col(fetched), "changed").otherwise("unchanged")
    return j.select(key, reason.alias("reason"))
