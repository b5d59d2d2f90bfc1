"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

A benchmark passage leaks into a document if some stretch of the document is within ``tolerance`` edits per
word (insert, delete, substitute a word) of it. For every passage length a window of that many words slides
over the text. Windows that could still be within the bound (enough words of the benchmark, and one of some
passage's rarest) are embedded by CGK random walks, which turn edit into Hamming distance; samples of the
embedding are the keys of the hash tables, repeated over walks and samples until the recall that
``tests`` measure is reached; windows that meet a passage are verified by alignment.

Words are runs of letters, digits and underscores, lower-cased. Null and empty texts hold nothing; passages
of fewer than 1 / ``tolerance`` words match exactly and those without words are skipped; repeated rows are
judged alike; an empty benchmark finds nothing; very long texts are scanned in parts; further columns are ignored.

The benchmark is a stated query set. It is broadcast in blocks of at most ``max_items`` passages and about
``max_bytes`` bytes, and all rows meet one block after the other, so its size is not limited by a task's memory.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, small_batches, tidy

WORD = re.compile(r"\w+")
TOLERANCE = 0.2
WALKS, SAMPLES, KEYS = 4, 16, 3
END = np.int64(1 << 40)
#: Array cells of one pass over windows or alignments.
CELLS = 1_500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Index:
    """The benchmark by passage length: words as small integers, rare words, hash tables."""

    def __init__(self, items: list[tuple[int, str]], tolerance: float = TOLERANCE, walks: int = WALKS, samples: int = SAMPLES, keys: int = KEYS, seed: int = 11):
        self.tolerance, self.walks, self.samples, self.keys = tolerance, walks, samples, keys
        words = [(i, WORD.findall((t or "").lower())) for i, t in items]
        words = [(i, w) for i, w in words if w]
        self.vocab = {w: n + 1 for n, w in enumerate(sorted({x for _, ws in words for x in ws}))}
        self.items = [(i, np.array([self.vocab[x] for x in ws], np.int64)) for i, ws in words]
        shared = np.zeros(len(self.vocab) + 1, np.int64)
        for _, a in self.items:
            shared[np.unique(a)] += 1
        size = np.array([0] + [len(w) for w in sorted(self.vocab)])
        rng = np.random.default_rng(seed)
        self.hash = _mix(np.arange(len(self.vocab) + 1, dtype=np.uint64) + np.uint64(1 << 32))  # the words', for the walks' bits
        self.lengths: dict[int, dict] = {}
        for n in sorted({len(a) for _, a in self.items}):
            own = [(i, a) for i, a in self.items if len(a) == n]
            spare = int(tolerance * n)
            rare = np.zeros(len(self.vocab) + 1, bool)
            for _, a in own:  # of its spare + 1 least usual words one at least survives
                rare[a[np.lexsort((-size[a], shared[a]))[: spare + 1]]] = True
            steps, most = 3 * n, min(keys, 3 * n * 2 // 3)
            tables = (walks, samples) if n > 1 else (1, 1)  # any table finds every window of one word
            odd = rng.integers(0, 1 << 63, (walks, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            picks = np.sort(np.array([[rng.choice(steps * 2 // 3, most, replace=False) for _ in range(tables[1])] for _ in range(tables[0])]), axis=2)
            x = {"ids": [i for i, _ in own], "a": np.stack([a for _, a in own]), "spare": spare, "rare": rare, "odd": odd, "picks": picks}
            self.lengths[n] = x
            x["tables"] = []
            for w, s, key in self.hashes(x, x["a"]):
                order = np.argsort(key, kind="stable")
                x["tables"].append((key[order], order))
        self.widest = max(self.lengths, default=0)

    def hashes(self, x: dict, windows: np.ndarray):
        """(walk, sample, key of each window): the CGK walk writes the word under its pointer and moves on
        by the bit that step and word decide (the top bit of the word's hash times an odd number of the step); a
        key is the words written at sampled steps."""
        n, length = windows.shape
        padded = np.concatenate([windows, np.zeros((n, 1), np.int64)], axis=1)
        hashed = self.hash[padded]
        rows = np.arange(n)
        for w in range(len(x["picks"])):
            last = int(x["picks"][w].max())
            written = np.empty((last + 1, n), np.int64)
            at = np.zeros(n, np.int64)
            for j in range(last + 1):
                word = padded[rows, at]
                over = at >= length
                written[j] = np.where(over, END, word)
                at = np.where(over, at, at + (hashed[rows, at] * x["odd"][w, j] >> np.uint64(63)).astype(np.int64))
            for s in range(len(x["picks"][w])):
                key = np.full(n, w * 64 + s, np.uint64)
                for j in x["picks"][w, s]:
                    key = _mix(key ^ written[j].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield w, s, key

    def candidates(self, text: np.ndarray) -> dict[int, np.ndarray]:
        """Per passage length, rows (start, passage) of windows that meet a passage in some table.

        ``text``: word numbers (0: not of the benchmark) of documents one after another, each followed by
        ``widest`` zeros, so that no window finds enough words across two of them.
        """
        total = np.concatenate([[0], np.cumsum(text > 0, dtype=np.int32)]).astype(np.int32)
        out = {}
        for n, x in self.lengths.items():
            if len(text) < n:
                continue
            enough = total[n:] - total[:-n] >= n - x["spare"]
            starts = np.flatnonzero(enough)
            if len(starts):
                rare = np.concatenate([[0], np.cumsum(x["rare"][text], dtype=np.int32)])
                starts = starts[rare[starts + n] > rare[starts]]
            found, rows = [], max(1, CELLS // (n + 1))
            for low in range(0, len(starts), rows):
                s = starts[low : low + rows]
                win = text[s[:, None] + np.arange(n)]
                for (_, _, key), (keys, order) in zip(self.hashes(x, win), x["tables"], strict=True):
                    a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    hit = np.flatnonzero(b > a)
                    if len(hit):
                        times = b[hit] - a[hit]
                        slot = np.repeat(a[hit] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                        found.append(np.repeat(s[hit], times) * len(x["ids"]) + order[slot])
            if found:
                both = np.unique(np.concatenate(found))
                out[n] = np.stack([both // len(x["ids"]), both % len(x["ids"])], axis=1)
        return out

    def verify(self, text: np.ndarray, n: int, pairs: np.ndarray) -> np.ndarray:
        """Fewest edits from each passage to a stretch of the text around the window (free ends)."""
        x = self.lengths[n]
        k = x["spare"]
        best, rows = np.empty(len(pairs), np.int64), max(1, CELLS // (n + 2 * k))
        for low in range(0, len(pairs), rows):
            p = pairs[low : low + rows]
            cols = p[:, :1] - k + np.arange(n + 2 * k)
            seg = np.where((cols >= 0) & (cols < len(text)), text[np.clip(cols, 0, len(text) - 1)], 0)
            item = x["a"][p[:, 1]]
            step = np.arange(seg.shape[1] + 1)
            row = np.zeros((len(p), seg.shape[1] + 1), np.int64)
            for i in range(n):
                new = np.empty_like(row)
                new[:, 0] = i + 1
                new[:, 1:] = np.minimum(row[:, :-1] + (seg != item[:, i : i + 1]), row[:, 1:] + 1)
                row = np.minimum.accumulate(new - step, axis=1) + step
            best[low : low + rows] = row.min(axis=1)
        return best

    def scan(self, texts: list[str]) -> list[dict[int, int]]:
        """Per text, passage number to fewest edits, for those within the bound."""
        out: list[dict[int, int]] = [{} for _ in texts]
        if not self.items:
            return out
        get, gap = self.vocab.get, [0] * self.widest
        flat: list[int] = []
        ends = []  # of each text's words: a window that starts in a gap reaches the next text only
        for t in texts:
            flat.extend(map(get, WORD.findall(t.lower()), repeat(0)))
            ends.append(len(flat))
            flat.extend(gap)
        text, bounds = np.array(flat, np.int64), np.array(ends)
        for n, pairs in self.candidates(text).items():
            edits = self.verify(text, n, pairs)
            ok = edits <= self.lengths[n]["spare"]
            for (start, item), e in zip(pairs[ok], edits[ok], strict=True):
                d = out[int(np.searchsorted(bounds, start, "right"))]
                key = self.lengths[n]["ids"][item]
                d[key] = min(int(e), d.get(key, 1 << 30))
        return out


def slices(batch, column: int, chars: int = 4_000_000):
    """Parts of an Arrow batch of about so many characters: one numpy pass each, in bounded memory."""
    low = size = 0
    for i, t in enumerate(batch.column(column)):
        size += len(t.as_py() or "")
        if size >= chars:
            yield batch.slice(low, i + 1 - low)
            low, size = i + 1, 0
    if low < batch.num_rows:
        yield batch.slice(low)


MAX_ITEMS, MAX_BYTES = 100_000, 32_000_000
_built: dict[str, Index] = {}


def blocks_of(benchmark: DataFrame, item_id: str, item_text: str, max_items: int, max_bytes: int) -> list:
    """Broadcasts (key, passages) of the benchmark in blocks of bounded rows and bytes; each block alone is collected."""
    rows = benchmark.select(benchmark[item_id].alias("i"), benchmark[item_text].alias("t"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] * 5 // (4 * max_items)), -(-size["b"] * 5 // (4 * max_bytes)))  # a fifth to spare, as they are dealt by hash
    block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    out = []
    for k in range(blocks):
        got = rows.filter(block == k).collect() if blocks > 1 else rows.collect()
        items = sorted(((r[0], r[1]) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        out.append(benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items)))
    return out


def index_of(block, tolerance: float) -> Index:
    """The index of a block, built once in a Python worker; the worker keeps the last one only."""
    key, items = block.value
    name = f"{key}:{tolerance}"
    if name not in _built:
        _built.clear()
        _built[name] = Index(items, tolerance)
    return _built[name]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", max_items: int = MAX_ITEMS, tolerance: float = TOLERANCE, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per input row: id, items (array of leaked passages, ascending), edits (fewest of each)."""
    blocks = blocks_of(benchmark, item_id, item_text, max_items, max_bytes)

    def scan_with(block):
        def scan(batches):
            import pyarrow as pa

            index = index_of(block, tolerance)
            for batch in batches:
                for part in slices(batch, 1):
                    found = index.scan([t or "" for t in part.column(1).to_pylist()])
                    keys = [sorted(d, key=lambda k: (k is None, k or 0)) for d in found]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array([[d[k] for k in ks] for d, ks in zip(found, keys, strict=True)], pa.list_(pa.int64()))], names=["id", "items", "edits"]
                    )

        return tidy(scan)

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    if len(blocks) == 1:
        return pick(docs, id=id_col, t=text_col).mapInArrow(scan_with(blocks[0]), f"id {kind}, items array<bigint>, edits array<bigint>")
    rows = materialize(pick(docs, id=id_col, t=text_col).withColumn("r", F.monotonically_increasing_id()), "leak-rows")
    hits = [materialize(rows.select("r", "t").mapInArrow(scan_with(b), "id bigint, items array<bigint>, edits array<bigint>").filter(F.size("items") > 0), "leak-hits") for b in blocks]
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    flat = every.select(F.col("id").alias("r"), F.explode(F.arrays_zip("items", "edits")).alias("h")).groupBy("r", F.col("h.items").alias("item")).agg(F.min("h.edits").alias("e"))
    listed = flat.groupBy("r").agg(F.array_sort(F.collect_list(F.struct(F.col("item").isNull().alias("no"), "item", "e"))).alias("l"))
    none = F.array().cast("array<bigint>")
    return rows.drop("t").join(listed, "r", "left").select("id", F.coalesce(F.col("l.item"), none).alias("items"), F.coalesce(F.col("l.e"), none).alias("edits"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id="item_id", item_text="text", max_items: int = MAX_ITEMS, tolerance: float = TOLERANCE, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents without those that hold a benchmark passage; columns as given."""
    at = docs.columns.index(text_col)

    def keep_with(block):
        def keep(batches):
            index = index_of(block, tolerance)
            for batch in batches:
                for part in slices(batch, at):
                    found = index.scan([t or "" for t in part.column(at).to_pylist()])
                    good = [i for i, d in enumerate(found) if not d]
                    if good:
                        yield part.take(good)

        return tidy(keep)

    small_batches(docs.sparkSession)
    first, *more = blocks_of(benchmark, item_id, item_text, max_items, max_bytes)
    out = docs.mapInArrow(keep_with(first), docs.schema)
    for block in more:  # written between blocks, so that one index is in memory at a time
        out = materialize(out, "leak-kept").mapInArrow(keep_with(block), docs.schema)
    return out


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark; null texts hold nothing, an empty table gives no rows."""
    out = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(F.col("id").alias("doc_id"), (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), "items", "edits")
