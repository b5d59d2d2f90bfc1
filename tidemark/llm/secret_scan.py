"""Secret scan: fixed credential shapes plus sliding-window entropy over candidate strings. Native.

Everything is one projection over the row: no shuffle, no Python, so a hot source or a repeated text
costs what its own characters cost. Null text reads as empty; empty text has no spans; repeated rows are
judged alike; null ids and extra columns are passed over; an empty table gives no rows. Work on a very long text
grows with its characters, and with the number of matches to the power of 1.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: The base patterns (kind, pattern, fewest characters, group those are counted in).
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]+", 32, 0),
]
#: What a text must hold for a kind to be looked for at all (same language as the kind, shortened).
GATE = {"assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
#: Failing runs of these kinds hide no later match, so the length can stand in the pattern.
LONG = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: Character classes, narrowest first: (name, whole-candidate pattern, bits a window must reach), each bar below
#: the peak of nearly all random strings of 30 characters of the class.
CLASSES = [
    ("digits", r"^[0-9]+$", 2.6),
    ("hex", r"^[0-9a-fA-F]+$", 3.2),
    ("one case", r"^(?:[A-Z]?[a-z]+|[A-Z]+)$", 3.5),
    ("letters", r"^[A-Za-z]+$", 3.7),
    ("alnum", r"^[A-Za-z0-9]+$", 3.8),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.9),
]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings that look random and are public: sequences, placeholders, digests of nothing, paths, and what reads like
#: words: one case with at most one of j, q, x, z and six consonants at a stretch, or words joined by capitals.
ALLOW = [
    r"(?i)example", r"(?i)abcdefgh", r"01234567", r"(?i)qwerty", r"(.)\1{7}", r"(?i)placeholder|your[_-]",
    r"d41d8cd98f00b204e9800998ecf8427e", r"e3b0c44298fc1c149afbf4c8996fb924", r"^/?(?:[A-Z]?[a-z]+|[0-9]{1,8})(?:[-_/]+(?:[A-Z]?[a-z]+|[0-9]{1,8}))+/?$",
    r"^(?=(?:[A-Z]?[a-z]+|[A-Z]+)$)(?i)(?![^jqxz]*[jqxz][^jqxz]*[jqxz])(?!.*[b-df-hj-np-tv-xz]{7})", r"^(?=[A-Za-z]+$)(?=.*[a-z][A-Z])(?!.*[A-Z][a-z]?[A-Z])",
]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,hit>> of leftmost non-overlapping matches, in code points.

    ``split`` and ``regexp_extract_all`` walk the text alike, so the k-th match starts where the first k+1 pieces
    and k matches end. These sums run over chunks of about the root of the number of pieces: first over the chunks'
    totals, then within each chunk, so that no list of all matches is copied at each match.
    """
    kind = "array<struct<start:bigint,end:bigint,hit:string>>"
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def width(x: Column) -> Column:
        return (F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).cast("bigint")

    def chunked(xs: Column) -> Column:
        step = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / step).cast("int")), lambda j: F.slice(xs, j * step + 1, step))

    def based(chunks: Column) -> Column:
        """The chunks, each with the characters before it."""
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + width(x)))
        sums = F.aggregate(totals, F.array(F.lit(0).cast("bigint")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.zip_with(chunks, F.slice(sums, F.lit(1), F.size(chunks)), lambda c, at: F.struct(c.alias("c"), at.alias("at")))

    def walked(chunk: Column) -> Column:
        zero = F.struct(chunk["at"].alias("at"), F.array().cast(kind).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["p"])
            end = (start + F.length(x["m"])).cast("bigint")
            hit = F.struct(start.cast("bigint").alias("start"), end.alias("end"), x["m"].alias("hit"))
            return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(hit))).alias("out"))

        return F.aggregate(chunk["c"], zero, step, lambda a: a["out"])

    return F.flatten(let(let(let(parts, chunked), based), lambda cs: F.transform(cs, walked)))


def _g(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def peak_entropy(candidate: Column, window: int = 20) -> Column:
    """Highest Shannon entropy (bits) of any ``window`` consecutive characters.

    Counts of the window are kept as the window slides: one count up, one down, and the sum of n*log2(n)
    follows by the two differences; H = log2(w) - sum/w.
    """
    chars = F.transform(F.split(candidate, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"), F.lit(0).alias("i")
    )

    def step(acc: Column, pair: Column) -> Column:
        add, drop = pair["add"], pair["drop"]
        up = F.get(acc["n"], add)
        s1 = acc["s"] + _g(up + 1) - _g(up)
        down = F.get(acc["n"], drop) + F.when(drop == add, 1).otherwise(0)
        s2 = F.when(drop > 0, s1 + _g(down - 1) - _g(down)).otherwise(s1)
        n = F.transform(acc["n"], lambda v, k: v + F.when(k == add, 1).otherwise(0) - F.when((k == drop) & (drop > 0), 1).otherwise(0))
        i = acc["i"] + 1
        h = F.lit(float(window)).cast("double")
        bits = F.log2(h) - s2 / h
        return F.struct(n.alias("n"), s2.alias("s"), F.when(i >= window, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"), i.alias("i"))

    lagged = F.concat(F.array_repeat(F.lit(0), window), chars)
    pairs = F.zip_with(chars, F.slice(lagged, F.lit(1), F.size(chars)), lambda a, d: F.struct(a.alias("add"), d.alias("drop")))
    return F.aggregate(pairs, zero, step, lambda a: a["best"])


def entropy_class(candidate: Column) -> Column:
    """The bits a window of this candidate must reach: those of the narrowest class that holds it."""
    out = F.lit(9.0)
    for _, pattern, bits in reversed(CLASSES):
        out = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(out)
    return out


def reached(spans: Column, x: Column) -> Column:
    """Whether one of ``spans``, ascending and disjoint, overlaps ``x``: the last that starts before its end, by halves."""
    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        open_, here = acc["low"] < acc["high"], F.get(spans, mid)["start"] < x["end"]
        return F.struct(F.when(open_ & here, mid + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~here, mid).otherwise(acc["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    last = F.aggregate(steps, start, halve, lambda a: F.get(spans, a["low"] - 1)["end"])
    return (F.size(spans) > 0) & F.coalesce(last > x["start"], F.lit(False))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """One row per input row: ``id``, ``base`` and ``added`` spans as array<struct<start,rank,end,kind>>.

    ``base`` holds the fixed shapes. ``added`` holds candidates whose entropy peaks above the bar of their
    character class, that no allow-list pattern suppresses and that touch no base span.
    """
    span = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
    none = F.array().cast(span)
    out = pick(docs, id=id_col, t=text_col).withColumn("t", F.coalesce("t", F.lit("")))

    def as_span(rank: int, kind: str):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))

    def long_enough(pattern: str, group: int, least: int):
        return lambda x: F.length(F.regexp_extract(x["hit"], pattern, group)) >= least

    kinds, masks = [], []
    for rank, (kind, pattern, least, group) in enumerate(BASE):
        hits = located(F.col("t"), LONG.get(kind, pattern))
        if kind not in LONG:
            hits = F.filter(hits, long_enough(pattern, group, least))
        got = F.transform(hits, as_span(rank, kind)).cast(span)
        kinds.append(F.when(F.col("t").rlike(GATE[kind]), got).otherwise(none).alias(kind))
        masks.append(LONG.get(kind))
    out = out.select("id", *kinds, F.when(F.col("t").rlike(CANDIDATE), located(F.col("t"), CANDIDATE)).alias("cand"))

    def wanted(x: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOW:
            allowed = allowed | x["hit"].rlike(pattern)
        # a candidate is a whole run of characters that hold every access and hex span; assign spans are sorted and apart
        clear = ~x["hit"].rlike("|".join(m for m in masks if m)) & ~reached(F.col("assign"), x)
        return clear & ~allowed & (peak_entropy(x["hit"], window) >= entropy_class(x["hit"]))

    added = F.transform(F.filter("cand", wanted), as_span(len(BASE), "entropy")).cast(span)
    return out.select("id", F.array_sort(F.concat(*[k for k, *_ in BASE])).alias("base"), F.coalesce(added, none).alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All documents through :func:`secret_spans`; null text is empty, an empty table gives no rows."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def n_of(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [n_of(kind) for kind, *_ in BASE]
    every = F.array_sort(F.concat("base", "added"))
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
