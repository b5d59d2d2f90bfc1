"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's fingerprint has a bit set where over half of the hashes of its four-word shingles have it. Fingerprints, each
kept once, are cut into three segments of 22, 21 and 21 bits, read as words of 23 bits. The binary Golay code of 23 bits
is perfect: every word lies within three bits of one codeword. A segment's keys are the twelve-bit indices of all
codewords within four bits of it, one or six, so segments up to two bits apart share a key: the word between them lies
within three bits of a codeword that both see. Of four differing bits over three segments, two segments have two each
at most; so any linked pair shares the keys of two segments, a bucket of 24 bits. Links are verified on all 64 bits.

A bucket reports the pairs of a forest, not all its pairs, and those of one task are joined once more before they leave
it. Buckets that a sample of fingerprints shows to be large are cut into blocks that meet in tasks of bounded size;
the sample decides where work is done, never what is compared. Components of the links name the classes.

Null text reads as empty; texts without words have fingerprint zero and link like any other; repeated rows and equal
texts share a fingerprint; null ids take part and are named only where no other id is reachable; an empty table gives
no rows; very long texts are hashed in slices; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import components
from .common import hot_keys, join_hot, materialize, pick, small_batches, tidy
from .decontaminate import slices

SHINGLE, SEED = 4, 42
MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR, LENGTH, CHECKS = 0b101011100011, 23, 11
#: Fingerprints of a bucket that one task compares with as many others.
BLOCK = 4096
#: One fingerprint in so many is looked at to find the large buckets.
ONE_IN = 64


def remainder(word: int) -> int:
    """The word's polynomial modulo the generator: zero for codewords."""
    for k in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - CHECKS)
    return word


def error_patterns() -> np.ndarray:
    """Row s: the error patterns of up to four bits with remainder s, one or six, the rest of the row -1."""
    found: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    single = [remainder(1 << k) for k in range(LENGTH)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            s = e = 0
            for k in bits:
                s ^= single[k]
                e |= 1 << k
            found[s].append(e)
    return np.array([row + [-1] * (6 - len(row)) for row in found], np.int64)


class Golay:
    """Twelve-bit indices of the codewords within four bits of words of 23 bits."""

    def __init__(self):
        self.errors = error_patterns()
        self.tables = [np.array([remainder(v << shift) for v in range(256 if shift < 16 else 128)], np.int64) for shift in (0, 8, 16)]

    def indices(self, words: np.ndarray) -> np.ndarray:
        """A row of six for each word, -1 where there are fewer."""
        a, b, c = self.tables
        e = self.errors[a[words & 255] ^ b[words >> 8 & 255] ^ c[words >> 16]]
        return np.where(e < 0, -1, (words[:, None] ^ e) >> CHECKS)


def bucket_keys(prints: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row of ``prints``): the pairs of indices of each two segments."""
    seen = [code.indices((prints >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64)) for at, size in SEGMENTS]
    keys, rows = [], []
    for k, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        both = (seen[i][:, :, None] >= 0) & (seen[j][:, None, :] >= 0)
        key = (k << 24) + (seen[i][:, :, None] << 12) + seen[j][:, None, :]
        row = np.broadcast_to(np.arange(len(prints))[:, None, None], key.shape)
        keys.append(key[both])
        rows.append(row[both])
    return np.concatenate(keys), np.concatenate(rows)


def fingerprint(text: str) -> int:
    import xxhash

    words = text.encode().lower().split()  # of bytes: A to Z only, and the six ASCII blanks
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    count = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):
        h = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(first[low : low + (1 << 16)], last[low : low + (1 << 16)], strict=True)), np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of every row, the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1):
                fp = np.array([fingerprint(t.as_py() or "") for t in part.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    small_batches(docs.sparkSession)
    return pick(docs, id=id_col, t=text_col).mapInArrow(tidy(run), f"id {kind}, fp bigint")


def bucketed(prints: DataFrame) -> DataFrame:
    """(key, fp): a row for each bucket of each fingerprint."""

    def run(batches):
        import pyarrow as pa

        code = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for low in range(0, len(fp), 4000):
                some = fp[low : low + 4000]
                key, row = bucket_keys(some.view(np.uint64), code)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(some[row])], names=["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key bigint, fp bigint")


class Forest:
    """Union-find over fingerprints: which pairs are news."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def joins(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[x] = y
        return x != y


def near_in_small(group: np.ndarray, fp: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of rows of one group, groups of ``most`` rows at most: each row with those after it, by distance."""
    out = []
    for s in range(1, most):
        x, y = fp[:-s], fp[s:]
        at = np.flatnonzero(group[:-s] == group[s:])
        if not len(at):
            break
        at = at[np.bitwise_count(x[at] ^ y[at]) <= MAX_BITS]
        out.append((x[at], y[at]))
    return out


def near_in_large(fp: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """A forest over the verified pairs of one group: all of its rows, or only those of different sides."""
    label, out = np.arange(len(fp)), []
    cross = int((side == side[0]).sum()) if side[0] != side[-1] else 0  # rows come ordered by side
    for i in range(max(1, cross), len(fp)):
        before = cross or i
        near = np.flatnonzero(np.bitwise_count(fp[:before] ^ fp[i]) <= MAX_BITS)
        if not len(near):
            continue
        old, at = np.unique(label[near], return_index=True)
        new = old != label[i]
        out.extend((int(fp[i]), int(fp[near[k]])) for k in at[new])
        label[np.isin(label, old[new])] = label[i]
    return out


SMALL = 32


def links(prints: DataFrame) -> DataFrame:
    """(a, b): pairs of fingerprints four bits apart at most, enough to join all that are linked."""
    keys = bucketed(prints)
    looked = bucketed(prints.filter(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(ONE_IN)) == 0))
    large = looked.groupBy("key").agg((F.count(F.lit(1)) * ONE_IN / BLOCK).alias("blocks")).filter("blocks > 2")
    large = materialize(large.select("key", F.ceil("blocks").cast("int").alias("blocks")), "golay-large")
    if large.isEmpty():
        dealt = keys.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
        cut = keys.join(large, "key", "left").select("key", "fp", F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce(own, F.lit(0)).alias("side"))
        cut = cut.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = cut.select("key", F.least("side", "x").alias("i"), F.greatest("side", "x").alias("j"), "side", "fp")

    def run(batches):
        import pyarrow as pa

        forest, held = Forest(), None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def compared(group, side, fp):
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[starts, len(group)])
            pairs: list[tuple[int, int]] = []
            small = np.repeat((sizes <= SMALL) & (sizes > 1), sizes)
            if small.any():
                for x, y in near_in_small(group[small], fp[small], SMALL + 1):
                    pairs.extend(zip(x.tolist(), y.tolist(), strict=True))
            for k in np.flatnonzero(sizes > SMALL):
                rows = slice(starts[k], starts[k] + sizes[k])
                pairs.extend(near_in_large(fp[rows], side[rows]))
            fresh = [p for p in pairs if forest.joins(*p)]
            both = np.array(fresh, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, side, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            fp = fp.view(np.uint64)  # bits are counted of unsigned numbers
            new = (key.astype(np.int64) << 32 | i.astype(np.int64) << 16 | j.astype(np.int64), side, fp)
            held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new, strict=True))
            last = int(np.argmax(held[0] == held[0][-1]))  # where the last group begins
            if last and len(held[0]) >= 1 << 16:
                yield compared(*(h[:last] for h in held))
                held = tuple(h[last:] for h in held)
        if held is not None:
            yield compared(*held)

    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return ordered.mapInArrow(tidy(run), "a bigint, b bigint")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (signed), component_id: a row for each row."""
    rows = materialize(fingerprints(docs, id_col, text_col), "golay-prints")
    node = materialize(rows.groupBy("fp").agg(F.min("id").alias("id")), "golay-nodes")
    label = components(materialize(links(node), "golay-links"))
    named = materialize(node.join(label.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root")), "golay-named")
    low = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_print = materialize(join_hot(named.select("fp", "root"), low, "root", "fp").select("fp", "component_id"), "golay-classes")
    return join_hot(rows, of_print, "fp", "id", hot=hot_keys(rows, "fp")).select("id", "fp", "component_id")


def op13_simhash_golay(spark, sf_dir: str) -> DataFrame:
    """All documents: null text is empty, null ids take part, an empty table gives no rows."""
    out = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
