"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of shingle multisets, banding, exact overlap.

A text is the multiset of its runs of five words (lower-cased; fewer words: one run). Each shingle carries a
family of Poisson processes over the weight axis, one for each dyadic interval [0,1), [1,2), [2,4), ...: a
shingle of weight w sees the points of all intervals below w, and of the one that w falls in those whose
position is below w. Every point has a time and a register, and a register keeps its earliest point, so two
texts agree in a register with the chance of their weighted Jaccard similarity. Points are drawn in order of
time and only up to the time by which the registers of that text are full, so work follows the count of
distinct shingles, not their weights.

Equal texts are one node. Nodes that share a band of five registers are candidates; each candidate pair is
verified on its shingle multisets, and classes are the connected components of the pairs at or above the
threshold. Buckets are first tested against hub members. Where a bucket still spans several classes, its texts
outside its largest class are compared with all others inside tasks of bounded size, which report only links that
join classes; so no link between bucket mates is lost, and neither copies nor pairs are multiplied out. Hubs, roots
and other keys that many rows share are dealt to several tasks (``join_hot``).

Null text reads as empty; texts without words are linked only if equal; repeated rows share a class; null ids
take part and are named last; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, materialize, pick, small_batches, tidy, trim
from .decontaminate import slices

WORD = re.compile(r"\w+")
SHINGLE = 5
BANDS, ROWS = 25, 5
REGISTERS = 128
GOLD = np.uint64(0x9E3779B97F4A7C15)


def times_gold(n: int) -> np.uint64:
    return np.uint64(n * int(GOLD) & (1 << 64) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_bags(texts: list[str], words: _Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingle hashes ascending, their counts) of each text."""
    flat: list[int] = []
    ends = [0]
    for t in texts:
        flat.extend(map(words.__getitem__, WORD.findall(t.lower())))
        ends.append(len(flat))
    h = np.array(flat, np.uint64)
    runs = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        runs = mix(runs * GOLD + h[k : k + len(runs)])
    out = []
    for a, b in pairwise(ends):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1], return_counts=True))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for k in range(a, b):
                one = mix(one * GOLD + h[k : k + 1])
            out.append((one, np.ones(1, np.int64)))
        else:
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
    return out


def registers(bags: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """uint32 signature rows; an empty bag has a row of zeros."""
    n = len(bags)
    total = np.array([int(c.sum()) for _, c in bags], np.float64)
    out = np.full((n, m), np.inf)
    todo, patience = np.flatnonzero(total > 0), np.log(m) + 4
    while len(todo):
        limit = np.zeros(n)
        limit[todo] = m * patience / total[todo]
        reg = np.full((len(todo), m), np.inf)
        _draw([bags[i] for i in todo], limit[todo], reg)
        out[todo] = reg
        todo = todo[np.isinf(reg).any(axis=1)]
        patience *= 2.5
    bits = mix(np.where(np.isinf(out), 0, out).view(np.uint64))
    sig = (bits >> np.uint64(32)).astype(np.uint32)
    sig[total == 0] = 0
    return sig


def _draw(bags, limit: np.ndarray, reg: np.ndarray) -> None:
    """Earliest point of each register up to each text's time limit."""
    m = reg.shape[1]
    sizes = [len(k) for k, _ in bags]
    doc = np.repeat(np.arange(len(bags)), sizes)
    key, weight = np.concatenate([k for k, _ in bags]), np.concatenate([c for _, c in bags])
    flat = reg.reshape(-1)
    # one process for each shingle and dyadic interval of weights that its count reaches into
    level = 0
    while len(key):
        low = 0 if level == 0 else 1 << (level - 1)
        rate = float(max(1, low))
        state = mix(key + times_gold(level + 1))
        who, w, t, i = doc, weight, np.zeros(len(key)), 0
        while len(state):
            i += 1
            r = mix(state + times_gold(2 * i))
            t = t - np.log1p(-((r >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
            live = t <= limit[who]
            if not live.all():
                state, who, w, t = state[live], who[live], w[live], t[live]
                if not len(state):
                    break
            s = mix(state + times_gold(2 * i + 1))
            slot = who * m + ((s & np.uint64(0xFFFF)) % np.uint64(m)).astype(np.int64)
            if level == 0:
                np.minimum.at(flat, slot, t)
            else:
                seen = low + ((s >> np.uint64(16)) & np.uint64(low - 1)).astype(np.int64) < w
                np.minimum.at(flat, slot[seen], t[seen])
        deeper = weight > max(1, low * 2 if level else 1)
        key, weight, doc = key[deeper], weight[deeper], doc[deeper]
        level += 1


def band_keys(sig: np.ndarray) -> np.ndarray:
    """int64 key of each band, bands apart."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), times_gold(b + 1), np.uint64)
        for r in range(ROWS):
            h = mix(h ^ sig[:, b * ROWS + r].astype(np.uint64) * GOLD)
        out[:, b] = h
    return out.view(np.int64)


def overlap(a, b) -> float:
    """Weighted Jaccard similarity of two bags: sum of minima over sum of maxima."""
    (ka, ca), (kb, cb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    low = int(np.minimum(ca[i], cb[j]).sum())
    return low / (int(ca.sum()) + int(cb.sum()) - low)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, weight, sig, bands) of every row; ``th`` is the text's 128-bit digest."""

    def sign(batches):
        import pyarrow as pa

        words = _Words()
        for batch in batches:
            for part in slices(batch, 2):
                bags = shingle_bags([t.as_py() or "" for t in part.column(2)], words)
                sig = registers(bags)
                keys = band_keys(sig)
                total = [int(c.sum()) for _, c in bags]
                bands = [k.tolist() if w else [] for k, w in zip(keys, total, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(total, pa.int64()), pa.array([s.astype(np.uint16).tobytes() for s in sig], pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["id", "th", "weight", "sig", "bands"],
                )

    small_batches(docs.sparkSession)
    rows = pick(docs, id=id_col, t=text_col).select("id", F.unhex(F.md5(F.coalesce("t", F.lit("")))).alias("th"), "t")
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(tidy(sign), f"id {kind}, th binary, weight bigint, sig binary, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of the pairs (a, b: digests, b often a hub) whose bags overlap enough. Texts travel to their pairs."""

    def test(batches):
        import pyarrow as pa

        words, last, bag = _Words(), None, None
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch.column(k) for k in range(4)), strict=True):
                b = b.as_py()
                if b != last:
                    last, bag = b, shingle_bags([tb.as_py()], words)[0]
                s = overlap(shingle_bags([ta.as_py()], words)[0], bag)
                if s >= threshold:
                    out.append({"a": a.as_py(), "b": b, "sim": s})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("a", pa.binary()), ("b", pa.binary()), ("sim", pa.float64())]))

    one = pairs.join(texts.select(F.col("th").alias("a"), F.col("t").alias("ta")), "a")
    both = join_hot(one, texts.select(F.col("th").alias("b"), F.col("t").alias("tb")), "b", "a", keys=pairs)
    return both.select("a", "b", "ta", "tb").mapInArrow(tidy(test), "a binary, b binary, sim double")


def alike(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least ``least`` of the registers: far pairs go before texts move."""

    def test(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            y = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            keep = np.flatnonzero((x == y).mean(axis=1) >= least)
            part = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])

    one = pairs.join(nodes.select(F.col("th").alias("a"), F.col("sig").alias("sa")), "a")
    both = join_hot(one, nodes.select(F.col("th").alias("b"), F.col("sig").alias("sb")), "b", "a", keys=pairs)
    return both.select("a", "b", "sa", "sb").mapInArrow(tidy(test), "a binary, b binary")


#: Texts of a bucket, and their shingles, that one task compares with as many others.
BLOCK, BLOCK_WEIGHT = 1500, 600_000


def joining(bags, root: np.ndarray, side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Row pairs at or above the threshold that join different classes: a forest, from exact overlaps.

    Rows whose ``side`` is 1 are compared with all others, where none is 1 all rows are. The k-th copy of a shingle
    counts as an element of its own, so overlaps are inner products of 0/1 rows, summed over slices of the elements
    that two rows at least have. Rows of the largest class need no comparison among themselves.
    """
    classes, number = np.unique(root, return_inverse=True)
    if len(classes) < 2:
        return []
    u = np.flatnonzero(side == 1) if (side == 1).any() else np.flatnonzero(number != np.bincount(number).argmax())
    keys, rows = [], []
    for i, (k, c) in enumerate(bags):
        copies = np.repeat(k, c) + times_gold(1) * (np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64)
        keys.append(copies)
        rows.append(np.full(len(copies), i))
    size = np.array([len(k) for k in keys])
    _, col, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    row = np.concatenate(rows)
    shared = n[col] > 1
    col, row = np.unique(col[shared], return_inverse=True)[1], row[shared]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    both = np.zeros((len(u), len(bags)), np.float32)
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, [low, low + 4096])
        part = np.zeros((len(bags), 4096), np.float32)
        part[row[a:b], col[a:b] - low] = 1
        both += part[u] @ part.T
    near = both >= threshold * (size[u][:, None] + size[None, :] - both) - 1e-6
    near &= (size[u] > 0)[:, None] & (number[u][:, None] != number[None, :])
    up = np.arange(len(classes))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for i, j in np.argwhere(near):
        p, q = find(number[u[i]]), find(number[j])
        if p != q:
            up[p] = q
            out.append((int(u[i]), int(j)))
    return out


def links_across(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) links between texts of one bucket (bk, th, weight, root) that belong to different classes.

    The texts outside a bucket's largest class, in blocks, meet all its texts, in blocks; a task compares two blocks.
    """
    import pandas as pd

    classes = members.groupBy("bk", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    big = F.max(F.struct("n", "w", "root"))
    buckets = classes.groupBy("bk").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k"), big.alias("m")).filter("k > 1")

    def blocks(n, w):
        return F.ceil(F.greatest(n / BLOCK, w / BLOCK_WEIGHT)).cast("int")

    buckets = buckets.select("bk", F.col("m.root").alias("main"), blocks(F.col("n"), F.col("w")).alias("wide"), blocks(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("narrow"))
    cut = join_hot(members, materialize(buckets, "bag-open"), "bk", "th")
    j, i = F.pmod(F.xxhash64("th"), "wide").cast("int"), F.pmod(F.xxhash64("th", F.lit(1)), "narrow").cast("int")
    as_all = F.transform(F.sequence(F.lit(0), F.col("narrow") - 1), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    as_other = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(1).alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))
    placed = F.when((F.col("wide") == 1) & (F.col("narrow") == 1), alone).when(F.col("root") == F.col("main"), as_all).otherwise(F.concat(as_all, as_other))
    cut = cut.select("bk", "th", "root", F.explode(placed).alias("p")).select("bk", "th", "root", "p.*")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        bags = shingle_bags(pdf["t"].tolist(), _Words())
        root = np.array([r.hex() for r in pdf["root"]])
        th = pdf["th"].tolist()
        pairs = joining(bags, root, pdf["side"].to_numpy(), threshold) if (pdf["side"] > 0).any() else []
        if len(th) > 500:
            del bags
            trim()
        return pd.DataFrame({"a": [max(th[i], th[j]) for i, j in pairs], "b": [min(th[i], th[j]) for i, j in pairs]}, dtype=object)

    return cut.join(texts, "th").groupBy("bk", "i", "j").applyInPandas(compare, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): least vertex of each component, for the vertices of ``edges`` (a, b).

    Labels fall to the least among neighbours' and are then followed once; rounds grow with the logarithm
    of a component's diameter in the usual case. Only counts reach the driver. A vertex of many edges, or a root of
    many vertices, is no one task's work.
    """
    both = materialize(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    label = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "cc-labels")
    hot = hot_keys(both, "b")
    while True:
        low = join_hot(both, label.select(F.col("v").alias("b"), "root"), "b", "a", hot=hot).groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        new = label.join(low, "v").select("v", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        new = materialize(new, "cc-step")
        if new.filter("root <> was").isEmpty():  # neighbours agree everywhere
            return new.select("v", "root")
        up = new.select(F.col("v").alias("root"), F.col("root").alias("over"))
        label = materialize(join_hot(new, up, "root", "v", "left").select("v", F.least("root", F.coalesce("over", "root")).alias("root")), "cc-labels")


def rooted(th: DataFrame, label: DataFrame) -> DataFrame:
    """``th`` with the root of each digest: its own where it has no link."""
    return th.join(label.withColumnRenamed("v", "th"), "th", "left").withColumn("root", F.coalesce("root", "th"))


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per input row: id, th, root, class_id.

    ``root``, the least digest of the class, is its key; ``class_id`` is its least id, which classes share
    whose ids are null or repeat.
    """
    rows = materialize(signatures(docs, id_col, text_col), "bag-signatures")
    node = rows.groupBy("th").agg(F.min("id").alias("id"), F.max("weight").alias("weight"), F.max("sig").alias("sig"), F.max("bands").alias("bands"))
    node = materialize(node, "bag-nodes")
    member = node.select("th", "weight", F.explode("bands").alias("bk"))
    shared = member.groupBy("bk").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("low"), F.max("th").alias("high")).filter("n > 1").select("bk", "low", "high")
    member = materialize(join_hot(member, shared, "bk", "th"), "bag-members")

    hubs = member.select("th", F.explode(F.array_distinct(F.array("low", "high"))).alias("hub")).filter("th <> hub")
    once = hubs.groupBy(F.greatest("th", "hub").alias("x"), F.least("th", "hub").alias("y")).agg(F.min("hub").alias("b"))
    pairs = materialize(once.select(F.when(F.col("x") == F.col("b"), F.col("y")).otherwise(F.col("x")).alias("a"), "b"), "bag-pairs")  # b: the hub
    # every text that a pair can need, once
    needed = member.select("th").distinct()
    t = pick(docs, t=text_col).select(F.coalesce("t", F.lit("")).alias("t"))
    t = t.select(F.unhex(F.md5("t")).alias("th"), "t").dropDuplicates(["th"]).join(needed, "th", "left_semi")
    texts = materialize(t, "bag-texts")
    near = threshold - 0.2  # 128 registers stray by 0.2 once in a million pairs
    links = materialize(verified(materialize(alike(pairs, node, near), "bag-alike"), texts, threshold), "bag-links")
    label = components(links)

    placed = materialize(rooted(member.select("bk", "th", "weight"), label), "bag-placed")
    more = materialize(links_across(placed, texts, threshold), "bag-more")
    if not more.isEmpty():  # what is already one class is one vertex now
        a, b = (rooted(more.select(F.col(c).alias("th"), F.monotonically_increasing_id().alias("e")), label).select("e", F.col("root").alias(c)) for c in ("a", "b"))
        again = components(a.join(b, "e").select("a", "b").filter("a <> b")).select(F.col("v").alias("root"), F.col("root").alias("top"))
        label = materialize(rooted(node.select("th"), label), "bag-roots")
        label = join_hot(label, again, "root", "th", "left").select(F.col("th").alias("v"), F.coalesce("top", "root").alias("root"))

    named = materialize(rooted(node.select("th", "id"), label), "bag-named")
    least = named.groupBy("root").agg(F.min("id").alias("class_id"))
    named = join_hot(named, least, "root", "th").select("th", "root", "class_id")
    return join_hot(rows.select("id", "th"), named, "th", "id").select("id", "th", "root", "class_id")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row of each class: its least id (of rows that repeat that id in the class, the least text, once)."""
    classes = duplicate_classes(docs, id_col, text_col, threshold)
    kept = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "th")).alias("k")).select(F.col("k.id").alias("_id"), F.col("k.th").alias("_th"))
    digest = F.unhex(F.md5(F.coalesce(docs[text_col], F.lit(""))))
    tagged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_i"), digest.alias("_t"))
    out = tagged.join(kept, tagged["_i"].eqNullSafe(kept["_id"]) & (tagged["_t"] == kept["_th"]))
    return out.select("_row", "_i", "_t").dropDuplicates(["_i", "_t"]).select("_row.*")


def op9_bagminhash(spark, sf_dir: str) -> DataFrame:
    """All documents with their class: null text is empty, null ids take part, an empty table gives no rows."""
    out = duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "class_id", F.lower(F.hex("root")).alias("class_key"))
