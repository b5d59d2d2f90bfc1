"""Addresses that a page calls the visitor's: found by the label before them, and masked in other texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What pages write before a visitor's own address, how near, and what stands for it.
LABELS = [
    "your ip", "your address", "your public ip", "client ip", "visitor ip", "remote ip", "tu ip", "tu dirección ip", "tu direccion ip", "su dirección ip", "seu ip", "seu endereço ip", "votre ip",
    "votre adresse ip", "ihre ip", "deine ip", '"origin"',
]
REACH = 48
MASK = "[own IP]"
NO_SLASH, NO_QUOTE = "\ufdd0", "\ufdd1"
#: An address is not part of a longer run; a full stop behind it ends a sentence. What it begins with is looked for first, so
#: that most signs of a text are passed over at one look.
V4 = r"(?=\d)(?<![0-9.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
_CUT, _BLANK = re.compile(r'"[^"]*"|[\[\]{},:]|[^"\[\]{},:]+'), re.compile(r"[ \t\n\x0b\f\r]+")
V6 = r"(?=[0-9a-fA-F]{0,4}+:)(?<![0-9a-fA-F:])[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}"


def pieces(text: Column) -> Column:
    """array<struct<gap,found>>: what may be an address and the text before it, in order; the last has none."""
    gaps, found = F.split(text, f"{V4}|{V6}", -1), F.regexp_extract_all(text, F.lit(f"({V4}|{V6})"), F.lit(1))
    return F.zip_with(gaps, found, lambda g, f: F.struct(g.alias("gap"), f.alias("found")))


def address_key(piece: Column) -> Column:
    """One spelling of an address: IPv4 as it is, IPv6 as eight groups of four digits; null for what is none."""
    octets = F.transform(F.split(piece, r"\."), lambda o: o.try_cast("int"))
    plain = F.size(octets) == 4
    v4 = F.when(piece.rlike(r"^(?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2})$") & plain & F.forall(octets, lambda o: F.coalesce(o <= 255, F.lit(False))), piece)
    halves = F.split(piece, "::", -1)

    def groups(half: Column) -> Column:
        return F.filter(F.split(half, ":", -1), lambda g: half != "")

    first, second = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    given = F.size(first) + F.size(second)
    whole = F.when(F.size(halves) == 1, F.when(given == 8, first)).when((F.size(halves) == 2) & (given <= 7), F.concat(first, F.array_repeat(F.lit("0"), 8 - given), second))
    right = piece.contains(":") & F.forall(whole, lambda g: F.length(g).between(1, 4))
    v6 = F.when(right, F.array_join(F.transform(whole, lambda g: F.lpad(F.lower(g), 4, "0")), ":"))
    return F.coalesce(v4, v6)


def is_public(key: Column) -> Column:
    """Whether an address key could be a machine's on the internet."""
    o = F.transform(F.split(key, r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(o, F.lit(0)), F.get(o, F.lit(1))
    inner4 = (a == 10) | (a == 127) | (a == 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | a.between(224, 239) | (key == "255.255.255.255")
    inner6 = key.rlike(r"^(?:0000:){7}000[01]$|^ff|^f[cd]|^fe[89ab]")
    return F.when(key.contains(":"), ~inner6).otherwise(~inner4)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: what a lambda names from outside is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def labelled(text: Column) -> Column:
    """The public addresses, as keys in order, that a label stands before: within 48 characters and behind the address
    before it, so that a label counts for one address."""
    return labelled_in(pieces(text))


def labelled_in(cut: Column) -> Column:
    """As :func:`labelled`, of the :func:`pieces` of a text."""
    def found(parts: Column) -> Column:
        def named(x: Column, i: Column) -> Column:
            # back to the last address; what only looks like one is text, of two characters at least
            some = F.slice(parts, F.greatest(i - REACH // 2, F.lit(0)) + 1, F.least(i, F.lit(REACH // 2)))
            behind = F.aggregate(some, F.lit(""), lambda acc, p: F.when(p["key"].isNotNull(), "").otherwise(F.concat(acc, p["gap"], p["found"])))
            near = F.lower(F.right(F.concat(behind, x["gap"]), F.lit(REACH)))
            return F.when(x["key"].isNotNull() & is_public(x["key"]) & F.exists(F.array(*map(F.lit, LABELS)), lambda w: F.contains(near, w)), x["key"])

        return F.array_distinct(F.array_compact(F.transform(parts, named)))

    return _let(F.transform(cut, lambda p: F.struct(p["gap"].alias("gap"), p["found"].alias("found"), address_key(p["found"]).alias("key"))), found)


def masked(text: Column, own: Column) -> Column:
    """The text with each address whose key is in ``own`` replaced."""
    return masked_in(pieces(text), own)


def masked_in(cut: Column, own: Column) -> Column:
    """As :func:`masked`, of the :func:`pieces` of a text."""
    def shown(p: Column) -> Column:
        hide = F.coalesce(F.array_contains(own, address_key(p["found"])), F.lit(False))
        return F.concat(p["gap"], F.when(hide, MASK).otherwise(F.coalesce(p["found"], F.lit(""))))

    return F.array_join(F.transform(cut, shown), "")


def json_pieces(text: str, urls: bool) -> list[tuple[str, bool]]:
    """A JSON text cut into pieces, in order, and whether each is a string to mask: a value that no name shields."""
    cut, levels, depth = _CUT.findall(text), [], 0
    for t in cut:
        depth += t in ("[", "{")
        levels.append(depth)  # a closing mark belongs to what it closes
        depth -= t in ("]", "}")
    ends, after, until = {}, None, [None] * len(cut)
    names = [False] * len(cut)
    for p in range(len(cut) - 1, -1, -1):
        t = cut[p]
        names[p], until[p] = after == ":", ends.get(levels[p], -1)
        if t in (",", "]", "}"):
            ends[levels[p]] = p
        after = after if _BLANK.fullmatch(t) else t
    out, said, shielded = [], "", -1
    for p, t in enumerate(cut):
        if t == ":" and not urls and said.lower().endswith('url"'):
            shielded = max(shielded, until[p])
        mask = t.startswith('"') and not names[p] and shielded < p
        if out and not mask and not out[-1][1]:
            out[-1][0].append(t)
        else:
            out.append(([t], mask))
        said = said if _BLANK.fullmatch(t) else t
    return [("".join(ts), mask) for ts, mask in out]


def masked_json(rows: DataFrame, key: str, value: str, own: str, urls: bool = False) -> DataFrame:
    """(key, value): JSON texts with the addresses in ``own`` (an array of keys, by row) masked in every string that is a value, but not in
    what stands under a name that ends in ``url``, unless ``urls``.

    The text is cut into strings, marks and what stands between. A name shields until the next comma or closing mark of its
    own level, so nothing recurses and a text takes time in proportion. A row stays in its task: nothing is shuffled.
    """

    @F.pandas_udf("array<struct<t:string,m:boolean>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else [{"t": t, "m": m} for t, m in json_pieces(x, urls)])

    # escapes become two noncharacters meanwhile, so that a string is what stands between two quotes
    plain = F.replace(F.replace(value, F.lit("\\\\"), F.lit(NO_SLASH)), F.lit('\\"'), F.lit(NO_QUOTE))
    done = rows.select(key, own, cut(plain).alias("_l")).filter("size(_l) > 0")
    whole = F.array_join(F.transform("_l", lambda x: F.when(x["m"], masked(x["t"], F.col(own))).otherwise(x["t"])), "")
    return done.select(key, F.replace(F.replace(whole, F.lit(NO_QUOTE), F.lit('\\"')), F.lit(NO_SLASH), F.lit("\\\\")).alias(value))
