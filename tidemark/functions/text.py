"""Text functions as Column expressions: tokenisers, shape statistics, token estimate, truncation, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{00AD}]"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def ascii_tokens(x: Column) -> Column:
    """Runs of [a-z0-9] of the ASCII-lower-cased text."""
    return F.regexp_extract_all(ascii_lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def words(x: Column) -> Column:
    """Runs of letters and digits in any script, ASCII-lower-cased."""
    return F.filter(F.split(ascii_lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def long_words(x: Column) -> Column:
    """Words of more than two bytes."""
    return F.filter(words(x), lambda w: F.octet_length(w) > 2)


def spaced(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def clean(x: Column) -> Column:
    """No invisible characters, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, INVISIBLE, ""), r"\s+", " "))


def fold(x: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(x), *ACCENTS)


def token_estimate(x: Column) -> Column:
    """A quarter token a narrow character, one and a quarter a wide one (above U+2E80)."""
    narrow = F.length(F.regexp_replace(x, r"[\x{2E81}-\x{10FFFF}]", ""))
    wide = F.length(x) - narrow
    return (F.ceil(narrow / 4) + wide + F.floor(wide / 4)).cast("long")


def parse_number(x: Column) -> Column:
    """A number written with either separator: the last one is the decimal, a lone comma only before 1-2 digits."""
    return signs_number(number_signs(x))


def number_signs(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9.,-]", "")


def signs_number(t: Column) -> Column:
    """:func:`parse_number` of the signs that numbers are written with; the signs are named many times."""
    comma, dot = F.length(t) - F.locate(",", F.reverse(t)) + 1, F.length(t) - F.locate(".", F.reverse(t)) + 1
    has_comma, has_dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    european = has_comma & F.when(has_dot, comma > dot).otherwise(t.rlike(r"^[^,]*,[0-9]{1,2}$"))
    plain = F.when(european, F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".")).otherwise(F.replace(t, F.lit(","), F.lit("")))
    return plain.try_cast("double")


def cut_at_space(x: Column, n: int) -> Column:
    """At most n characters, cut before the last white space, which may end the cut, with an ellipsis."""
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, n), r"\s+\S*\z", ""), F.lit("…")))


def literal_terms(x: Column) -> Column:
    """Words of a query that read as code or exclusion: kept as typed, less quotes and commas."""
    return F.filter(F.transform(F.split(x, r"\s+"), lambda w: F.regexp_replace(w, r"^[\"',;]+|[\"',;]+$", "")), lambda w: w.rlike(r"[_(){}\[\]<>=/\\:]|^-\w|\w\.\w"))


def sitemap_time(x: Column) -> Column:
    """Unix seconds of ``YYYY-MM-DD[ T]HH:MM:SS`` or a bare date; what follows is ignored; else null."""
    full = F.regexp_extract(x, r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})", 0)
    day = F.regexp_extract(x, r"^\d{4}-\d{2}-\d{2}", 0)
    text = F.when(full != "", F.translate(full, "T", " ")).when(day != "", F.concat(day, F.lit(" 00:00:00")))
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def iso_duration(x: Column) -> Column:
    """Seconds of PT#H#M#S; null if nothing is given."""
    def part(unit: str) -> Column:
        return F.coalesce(F.regexp_extract(x, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0))

    return F.when(x.rlike(r"^P(?:\d+D)?T?(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?$") & (F.length(x) > 2), part("D") * 86400 + part("H") * 3600 + part("M") * 60 + part("S"))


def clock(seconds: Column) -> Column:
    """H:MM:SS, or M:SS under an hour."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def cache_ttl(header: Column, has_query: Column, default: int) -> Column:
    """Seconds to keep a page: none for no-store, max-age up to the default and a week, else 300 with a query."""
    age = F.regexp_extract(F.lower(header), r"max-age\s*=\s*(\d{1,9})", 1).try_cast("long")
    return F.when(F.contains(F.lower(header), F.lit("no-store")), F.lit(None)).when(age.isNotNull(), F.least(age, F.lit(default), F.lit(604_800))).when(has_query, F.least(F.lit(300), F.lit(default))).otherwise(F.lit(default)).cast("long")


# Month names of HTTP dates.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait from a Retry-After header: whole seconds, or an HTTP date against ``now`` (not below 0); else null."""
    shape = r"^\w{3}, (\d{2}) (\w{3}) (\d{4}) (\d{2}:\d{2}:\d{2}) GMT$"
    month = F.lpad(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(header, shape, 2)).cast("string"), 2, "0")
    text = F.concat(F.regexp_extract(header, shape, 3), F.lit("-"), month, F.lit("-"), F.regexp_extract(header, shape, 1), F.lit(" "), F.regexp_extract(header, shape, 4))
    at = F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.when(header.rlike("^[0-9]{1,9}$"), header.try_cast("long")).when(header.rlike(shape), F.greatest(at - now, F.lit(0)))


def query_terms(x: Column, stop: list[str]) -> Column:
    """Distinct folded words of two letters or more, or digits, without stop words, in order."""
    ws = F.filter(F.split(fold(x), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 2) | w.rlike("^[0-9]$"))
    return F.array_distinct(F.filter(ws, lambda w: ~w.isin(stop)))


def off_topic(terms: Column, shown: Column) -> Column:
    """A result shares too few query terms with its title, snippet and URL: none, or fewer than two of three or more."""
    low = fold(shown)
    hits = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    return hits < F.when(F.size(terms) <= 2, F.least(F.size(terms), F.lit(1))).otherwise(2)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def page_cursor(block: Column, offset: Column, digest: Column) -> Column:
    """Opaque place in a text: ``block.offset.digest`` as hex numbers."""
    return F.concat_ws(".", F.lower(F.hex(block)), F.lower(F.hex(offset)), F.lower(F.hex(digest)))


def read_cursor(x: Column) -> Column:
    """struct<block,offset,digest> of a cursor; null if it is not exactly three hex numbers."""
    parts = F.split(x, r"\.")
    number = lambda i: F.conv(parts[i], 16, 10).try_cast("long")
    return F.when(x.rlike(r"^[0-9a-f]{1,15}\.[0-9a-f]{1,15}\.[0-9a-f]{1,15}$"), F.struct(number(0).alias("block"), number(1).alias("offset"), number(2).alias("digest")))


#: Scripts written without spaces: kana, Han, Hangul.
IDEOGRAPH = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"


def script_words(x: Column) -> Column:
    """Count of words between spaces, where one that holds ideographs counts as so many."""
    runs = F.regexp_extract_all(x, F.lit(r"(\S+)"), F.lit(1))
    return F.when(x.rlike(IDEOGRAPH), F.aggregate(runs, F.lit(0), lambda n, r: n + F.greatest(F.regexp_count(r, F.lit(IDEOGRAPH)), F.lit(1)))).otherwise(F.size(runs))


def shorten(q: Column, stop: list[str]) -> Column:
    """A query cut to its quoted phrases and its first content words, four of them or two beside phrases; null where that
    is no shorter."""
    parts = F.split(q, '"')
    phrases = F.transform(F.filter(parts, lambda p, i: (i % 2 == 1) & (F.trim(p) != "")), lambda p: F.concat(F.lit('"'), F.trim(p), F.lit('"')))
    rest = F.regexp_extract_all(F.array_join(F.filter(parts, lambda p, i: (i % 2 == 0) | (F.trim(p) == "")), " "), F.lit(r"(\S+)"), F.lit(1))
    content = F.filter(rest, lambda w: F.exists(words(fold(w)), lambda x: ~x.isin(stop)))
    short = F.array_join(F.concat(phrases, F.slice(content, F.lit(1), F.when(F.size(phrases) == 0, 4).otherwise(2))), " ")
    return F.when((short != "") & (F.regexp_count(short, F.lit(r"\S+")) < F.regexp_count(q, F.lit(r"\S+"))), short)
