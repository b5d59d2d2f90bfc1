"""Fixed hashes: FNV-1a 64 and simhash as Arrow UDFs over numpy; distance and bands as expressions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# The published FNV-1a 64 offset basis and prime.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
_SPLIT = re.compile(r"[^\W_]+")


def fnv_spans(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """FNV-1a 64 of byte spans of ``flat``, one vector step per byte position."""
    h = np.full(len(starts), OFFSET, np.uint64)
    if not len(starts):
        return h
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    for i in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -i, "left"))  # spans longer than i
        h[:n] = (h[:n] ^ flat[starts[:n] + i]) * np.uint64(PRIME)
    back = np.empty_like(h)
    back[order] = h
    return back


def fnv_many(items: list[bytes]) -> np.ndarray:
    """FNV-1a 64 of each byte string."""
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    return fnv_spans(np.frombuffer(b"".join(items), np.uint8), np.cumsum(lengths) - lengths, lengths)


@F.pandas_udf(LongType())
def fnv64(x: pd.Series) -> pd.Series:
    """FNV-1a 64 as a signed long; null stays null."""
    got = pd.Series(fnv_many([t.encode() for t in x.fillna("")]).view(np.int64), index=x.index, dtype="Int64")
    return got.mask(x.isna())


def simhash_many(texts: list[str]) -> np.ndarray:
    """Simhashes of many texts. Words are laid out in one byte array with a space after each, so that a trigram is a
    span of it; spans are hashed and their bits voted on for all texts at once."""
    words = [_SPLIT.findall(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(texts), np.int64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    flat = np.frombuffer(b"".join((" ".join(w) + " ").encode() for w in words if w), np.uint8)
    flat = flat + np.where((flat >= 65) & (flat <= 90), 32, 0).astype(np.uint8)
    stops = np.flatnonzero(flat == 32)  # the end of each word
    begins = np.concatenate([[0], stops[:-1] + 1])
    n = counts[some]
    k = np.minimum(3, n)
    grams = n - k + 1
    first = np.repeat(np.cumsum(n) - n, grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    starts, ends = begins[first], stops[first + np.repeat(k, grams) - 1]
    bits = np.unpackbits(fnv_spans(flat, starts, ends - starts).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.add.reduceat(bits, np.cumsum(grams) - grams, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * votes > grams[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]
    return out


#: Characters of text that one numpy pass takes.
CHUNK = 250_000


@F.pandas_udf(LongType())
def simhash64(x: pd.Series) -> pd.Series:
    """64-bit simhash of word trigrams; 0 for a text without words."""
    out, part, size = [], [], 0
    for t in x:
        part.append(t or "")
        size += len(part[-1])
        if size >= CHUNK:
            out.append(simhash_many(part))
            part, size = [], 0
    out.append(simhash_many(part))
    return pd.Series(np.concatenate(out), dtype="int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / 64


#: Six blocks of the 64 bits: (first bit, width).
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]


def bands(h: Column) -> Column:
    """The 20 choices of three of six blocks, each a key of 31 to 33 bits: hashes within 3 bits share one."""
    from itertools import combinations

    block = [F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in BLOCKS]
    return F.array(*[F.shiftleft(a, 22).bitwiseXOR(F.shiftleft(b, 11)).bitwiseXOR(c) for a, b, c in combinations(block, 3)])
