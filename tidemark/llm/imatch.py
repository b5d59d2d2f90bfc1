"""I-Match document fingerprints with randomised lexicon subsets. Native.

The lexicon holds the terms whose inverse document frequency lies in a chosen band. Each of ``N_SUBSETS``
randomised lexicons keeps every term of it independently with a fixed chance, drawn by a hash of term and
lexicon number. A text's fingerprint is one hash of its sorted distinct lexicon terms and one of those in each
randomised lexicon. Dense lexicons tell near copies from the rest, sparse ones grade looser likeness.

The band's upper end bounds the lexicon: terms in at least N/e^idf_high of N documents number at most e^idf_high
times the mean count of distinct terms of a document, whatever N is. Up to ``BROADCAST_TERMS`` it is broadcast,
beyond that the terms join it by shuffle.

Null text reads as empty. A text without lexicon terms is hashed over all its terms, and one without terms over
its characters. Rows are ordered by id (null first), ties by a hash of the text; the last row is followed by the
first, a single row by itself. Repeated rows each count; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_hash, materialize, ordered_bucket, pick, quantile_bounds

#: (lexicons, terms of 256 that each keeps on average).
SUBSETS = [(2, 128), (2, 32), (4, 8), (24, 1)]
WIDTHS = [width for n, width in SUBSETS for _ in range(n)]
N_SUBSETS = len(WIDTHS)
#: A lexicon of at most so many terms (16 bytes each) is broadcast.
BROADCAST_TERMS = 2_000_000


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def kept_by(term: Column) -> Column:
    """Bit k is set if randomised lexicon k keeps the term."""
    out = F.lit(0).cast("bigint")
    for k, width in enumerate(WIDTHS):
        kept = F.pmod(F.xxhash64(term, F.lit(k)), F.lit(256)) < width
        out = out.bitwiseOR(F.when(kept, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return out


def band_lexicon(docs: DataFrame, text_col: str, idf_low: float, idf_high: float) -> DataFrame:
    """(term, kept) of the terms of the band, counted over all documents."""
    n_docs = docs.count()
    least, most = max(2.0 if n_docs > 1 else 1.0, n_docs * math.exp(-idf_high)), n_docs * math.exp(-idf_low)
    df = docs.select(F.explode(terms(F.coalesce(docs[text_col], F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return materialize(df.filter(F.col("df").between(least, most)).select("term", kept_by(F.col("term")).alias("kept")), "imatch-lexicon")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, pos, id, t, next_t, last): each row with the text that follows it in id order.

    Ids are cut into contiguous ranges, each sorted by itself. The first row of a range (and those equal to it)
    also goes to the range before it, behind that one's rows; it is all that crosses ranges. Ranges are dealt to as many
    tasks, which Spark does not merge by their packed size: a task holds a few ranges at a time, with all their terms.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(docs, id=id_col, t=text_col).withColumn("t", F.coalesce("t", F.lit(""))).withColumn("h", F.xxhash64("t"))
    rows = rows.withColumn("bucket", ordered_bucket(F.col("id"), *quantile_bounds(docs, id_col, 4 * parts), by_hash(F.col("h"))))
    first = rows.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("f")).select("bucket", F.col("f.id").alias("fid"), F.col("f.h").alias("fh"))
    order = Window.orderBy("bucket")  # a row a range: some times the partitions
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = materialize(first.withColumn("before", F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(whole))), "imatch-ranges")
    leads = F.col("id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh"))
    rows = rows.join(F.broadcast(first), "bucket")
    places = F.array(F.struct("bucket", F.lit(False).alias("tail")), F.when(leads, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail"))))
    rows = rows.select("id", "t", "h", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p")).select("p.bucket", "p.tail", "id", "h", "t")
    rows = rows.repartition(4 * parts, "bucket")
    w = Window.partitionBy("bucket").orderBy("tail", "id", "h", "t")
    rows = rows.withColumn("pos", F.row_number().over(w)).withColumn("next_t", F.lead("t").over(w)).withColumn("last", F.lead("tail").over(w))
    return rows.filter("not tail").select("bucket", "pos", "id", "t", "next_t", "last")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, pos, id, n_chars, t, next_t, last, edited, sha): :func:`with_next` with the edited texts and their digests."""
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - half), F.substring(F.col("next_t"), F.lit(1), half))
    rows = with_next(docs, id_col, text_col).select("bucket", "pos", "id", n.cast("long").alias("n_chars"), "t", "next_t", "last", edited.alias("edited"))
    return rows.withColumn("sha", F.sha2("edited", 256))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing lexicons among those where either text has terms; 1 if the whole hashes agree."""
    pairs = F.arrays_zip(a["subsets"].alias("x"), b["subsets"].alias("y"))
    used = F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull())
    same = F.size(F.filter(used, lambda p: p["x"] == p["y"]))
    return F.when(a["whole"] == b["whole"], 1.0).otherwise(F.coalesce(F.try_divide(same, F.size(used)), F.lit(0.0))).cast("double")


def as_text(print_: Column) -> Column:
    """16 hex digits for all terms, then 8 for each randomised lexicon (dashes: no term)."""
    def digits(x: Column) -> Column:
        return F.coalesce(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8)), F.lit("-" * 8))

    return F.lower(F.concat(F.lpad(F.hex(print_["whole"]), 16, "0"), F.array_join(F.transform(print_["subsets"], digits), "")))


def print_of(listed: Column, other: Column) -> Column:
    """struct<whole,subsets> of a text's distinct lexicon terms, array<struct<term,kept>>; ``other`` if there are none."""
    def hashed(xs: Column) -> Column:
        return F.xxhash64(F.transform(xs, lambda x: x["term"]))

    def thinned(xs: Column, k: int) -> Column:
        mine = F.filter(xs, lambda x: x["kept"].bitwiseAND(F.lit(1 << k)) != 0)
        return F.get(F.transform(F.filter(F.array(mine), lambda m: F.size(m) > 0), hashed), F.lit(0))  # null if none

    def of(v: Column) -> Column:
        subsets = [thinned(v["few"] if width < 32 else v["band"], k) for k, width in enumerate(WIDTHS)]
        return F.struct(F.when(F.size(v["band"]) > 0, hashed(v["band"])).otherwise(other).alias("whole"), F.array(*subsets).alias("subsets"))

    sparse = sum(1 << k for k, width in enumerate(WIDTHS) if width < 32)
    both = F.transform(F.array(F.array_sort(listed)), lambda xs: F.struct(xs.alias("band"), F.filter(xs, lambda x: x["kept"].bitwiseAND(F.lit(sparse)) != 0).alias("few")))
    return F.get(F.transform(both, of), F.lit(0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", idf_low: float = 1.6, idf_high: float = 6.9) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, own, edited and next fingerprints (structs).

    Texts move once, to stand beside their successor; the terms then meet the lexicon and are gathered per text.
    """
    lexicon = band_lexicon(docs, text_col, idf_low, idf_high)
    if lexicon.count() <= BROADCAST_TERMS:
        lexicon = F.broadcast(lexicon)
    rows = edits(docs, id_col, text_col)
    # the next row's print is this range's next print, except at the end of a range
    by_role = (F.col("t"), F.col("edited"), F.when(F.col("last"), F.col("next_t")))
    texts = F.array(*[F.struct(F.lit(r).alias("role"), x.alias("x")) for r, x in enumerate(by_role)])
    per = rows.select("bucket", "pos", F.struct("id", "n_chars", "sha").alias("row"), F.explode(F.filter(texts, lambda s: s["x"].isNotNull())).alias("s"))
    per = per.select("bucket", "pos", "row", F.col("s.role").alias("role"), F.xxhash64("s.x").alias("chars"), terms(F.col("s.x")).alias("ts"))
    # what belongs to the text travels with its first term; terms outside the lexicon go no further
    other = F.when(F.size("ts") > 0, F.xxhash64(F.array_sort("ts"))).otherwise(F.col("chars"))
    per = per.select("bucket", "pos", "role", "row", other.alias("other"), F.posexplode_outer("ts").alias("at", "term"))
    per = per.select("bucket", "pos", "role", "term", F.when(F.coalesce("at", F.lit(0)) == 0, F.struct("row", "other")).alias("head"))
    hit = per.join(lexicon, "term", "left").filter("kept is not null or head is not null")
    term = F.when(F.col("kept").isNotNull(), F.struct("term", "kept"))
    folded = hit.groupBy("bucket", "pos", "role").agg(F.first("head", ignorenulls=True).alias("head"), F.collect_list(term).alias("listed"))
    folded = folded.select("bucket", "pos", "role", "head.row", print_of(F.col("listed"), F.col("head.other")).alias("p"))
    out = folded.groupBy("bucket", "pos").agg(F.first("row").alias("row"), *[F.max(F.when(F.col("role") == r, F.col("p"))).alias(a) for r, a in ((0, "own"), (1, "edited"), (2, "end"))])
    w = Window.partitionBy("bucket").orderBy("pos")
    out = out.withColumn("next", F.coalesce("end", F.lead("own").over(w)))
    return out.select("row.id", "row.n_chars", F.col("row.sha").alias("edited_sha256"), "own", "edited", "next")


def op2_imatch(spark, sf_dir: str) -> DataFrame:
    """All documents through :func:`fingerprints`; null text is empty, repeated rows each count, an empty table gives
    no rows."""
    p = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own, edited, after = F.col("own"), F.col("edited"), F.col("next")
    return p.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, after).alias("near_next"),
    )
