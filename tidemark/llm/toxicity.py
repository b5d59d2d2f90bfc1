"""Toxicity by multiple-instance learning: sentences are scored, documents are their noisy-or.

A document is toxic if any sentence is: P = 1 - prod(1 - p_s), p_s = sigmoid(bias + sum of the weights of the
distinct features of s); sentences without any weighted feature count 0, so that length alone is no evidence.
Only documents carry labels; the weights maximise the penalised likelihood of those.
Features are words and word beginnings, hashed. Training is on a bounded sample of labelled rows (at most
``max_per_class`` of either label, the least in a hash order of the ids). Spark featurises it, counts the documents
of each feature and drops the features that tell nothing; the driver fits the weights of those left.
Every row is scored in full, and the highest sentence is located.

Null and empty text has no sentence and scores 0. Rows with a null label are not learnt from; with no rows of
either label the score is 0 everywhere. Repeated rows are scored alike; an empty table gives no rows; the length of a
text is no evidence; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, small_batches, tidy

BUCKETS = 1 << 18
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6)


def word_features(word: str) -> list[int]:
    """Bucket numbers of a word: itself, and its first letters where it is longer."""
    out = [zlib.crc32(b"w" + word.encode()) % BUCKETS]
    out += [zlib.crc32(b"p" + word[:k].encode()) % BUCKETS for k in PREFIXES if len(word) >= k]
    return out


class _Memo(dict):
    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 100_000:
            self.clear()
        self[word] = v = tuple(word_features(word))
        return v


def featurise(text: str, memo: _Memo) -> list[np.ndarray]:
    """Distinct features of each sentence."""
    out = []
    for s in SENTENCE.findall(text.lower()):
        got = {b for w in set(WORD.findall(s)) for b in memo[w]}
        if got:
            out.append(np.fromiter(got, np.int32, len(got)))
    return out


def sample_bags(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn, max_per_class: int) -> DataFrame:
    """(k, y, f, e) of the training sample: features of all sentences in a row, and where each sentence ends. The bound
    is on rows of each label: of rows that repeat an id the one of least text hash."""
    y = labels.select(labels[id_col].alias("k"), labels[label_col].cast("int").alias("y")).filter("y is not null and k is not null")
    y = y.filter(learn(F.col("k"))).groupBy("k").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("k"))
    chosen = y.filter("y = 1").orderBy("h", "k").limit(max_per_class).unionAll(y.filter("y = 0").orderBy("h", "k").limit(max_per_class))
    rows = pick(docs, k=id_col, t=text_col).join(F.broadcast(chosen.select("k", "y")), "k")  # 2 * max_per_class ids at most
    rows = rows.groupBy("k", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))  # of rows that repeat an id one, found before the shuffle

    def features(batches):
        import pandas as pd

        memo = _Memo()
        for pdf in batches:
            bags = [featurise(t or "", memo) for t in pdf["t"]]
            flat = [np.concatenate(b) if b else np.empty(0, np.int32) for b in bags]
            ends = [np.cumsum([len(x) for x in b], dtype=np.int32) for b in bags]
            yield pd.DataFrame({"k": pdf["k"], "y": pdf["y"], "f": flat, "e": ends})

    small_batches(docs.sparkSession)
    return materialize(rows.mapInPandas(tidy(features), "k long, y int, f array<int>, e array<int>"), "toxic-sample")


def telling(sample: DataFrame) -> list[int]:
    """Buckets whose share of toxic documents is above the base rate by more than chance finds among so many buckets
    (binomial large-deviation bound), so words of a few documents teach nothing. Fewer than ``BUCKETS``."""
    whole = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    if not whole["n"] or whole["pos"] in (0, whole["n"]):
        return []
    base = whole["pos"] / whole["n"]
    per = sample.select("y", F.explode(F.array_distinct("f")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).cast("double").alias("df"), F.sum("y").cast("double").alias("pos"))
    per = materialize(per, "toxic-buckets")
    bar = math.log(max(2, per.filter("df > 2").count())) - 1
    share = F.col("pos") / F.col("df")
    toxic = F.when(F.col("pos") > 0, share * F.log(share / base)).otherwise(0)
    clean = F.when(F.col("pos") < F.col("df"), (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0)
    return sorted(r["bucket"] for r in per.filter((share > base) & (F.col("df") * (toxic + clean) > bar)).select("bucket").collect())


def pruned(sample: DataFrame, buckets: list[int]):
    """The sample on the driver, telling features only: y, f (numbers into ``buckets``) and s (their sentences)."""
    known = sample.sparkSession.sparkContext.broadcast(np.array(buckets, np.int32))

    def run(batches):
        import pandas as pd

        keep = known.value
        for pdf in batches:
            out = []
            for f, e in zip(pdf["f"], pdf["e"], strict=True):
                f, e = np.asarray(f, np.int32), np.asarray(e, np.int64)
                m = np.isin(f, keep)
                out.append((np.searchsorted(keep, f[m]).astype(np.int32), np.repeat(np.arange(len(e)), np.diff(e, prepend=0))[m].astype(np.int32)))
            yield pd.DataFrame({"k": pdf["k"], "y": pdf["y"], "f": [x.tobytes() for x, _ in out], "s": [x.tobytes() for _, x in out]})

    return sample.mapInPandas(tidy(run), "k long, y int, f binary, s binary").toPandas().sort_values("k")


def fit(sample, buckets: list[int], epochs: int = 120, rate: float = 0.3, l2: float = 3e-4) -> tuple[dict[int, float], float]:
    """Weights by bucket and the bias: Adam on the noisy-or likelihood, full batches of the sample."""
    y = sample["y"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return {}, -30.0
    base = y.mean()
    idx, sent, doc, n_sent = [], [], [], 0
    for d, (f, s) in enumerate(zip(sample["f"], sample["s"], strict=True)):
        f, s = np.frombuffer(f, np.int32), np.frombuffer(s, np.int32)
        if not len(f):
            continue
        own, s = np.unique(s, return_inverse=True)  # the other sentences count nothing
        idx.append(f)
        sent.append(s + n_sent)
        doc.append(np.full(len(own), d))
        n_sent += len(own)
    if not idx:
        return {}, -30.0
    idx, sent, doc = np.concatenate(idx), np.concatenate(sent), np.concatenate(doc)
    n = len(buckets)
    w, b = np.zeros(n), -9.0
    m1, m2, bm1, bm2 = np.zeros(n), np.zeros(n), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / max(base, 1e-9), 0.5 / max(1 - base, 1e-9))
    for t in range(1, epochs + 1):
        z = np.clip(b + np.bincount(sent, w[idx], n_sent), -30, 30)
        p = 1 / (1 + np.exp(-z))
        quiet = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # log of nothing toxic
        big_p = -np.expm1(quiet)
        # d logL/dz_s = p_s * (1 - P)/P for toxic documents, -p_s for clean ones
        per = np.where(y == 1, np.exp(quiet) / np.maximum(big_p, 1e-9), -1.0) * weight
        gz = p * per[doc]
        gw = np.bincount(idx, gz[sent], n) / len(y) - l2 * w / 10 - l2 / 20 * np.sign(w)
        gb = gz.sum() / len(y)
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.999 * m2 + 0.001 * gw * gw
        bm1, bm2 = 0.9 * bm1 + 0.1 * gb, 0.999 * bm2 + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w += rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-6)
        b += rate * (bm1 / c1) / (np.sqrt(bm2 / c2) + 1e-6)
        w = np.clip(w, -6, 14)
        b = float(np.clip(b, -14, -9))
    big = np.abs(w) > 0.05
    return dict(zip(np.array(buckets)[big].tolist(), w[big].tolist(), strict=True)), b


def scorer(weights: dict[int, float], bias: float):
    """Text to (score, score of the worst sentence, its first code point, the one after its last)."""

    class Words(dict):
        """Buckets of a word that have weight."""

        def __missing__(self, word: str) -> tuple[int, ...]:
            if len(self) >= 100_000:
                self.clear()
            self[word] = v = tuple(x for x in word_features(word) if x in weights)
            return v

    words, none = Words(), ()

    def score(text: str | None):
        raw = text or ""
        low = raw.lower()
        if len(low) != len(raw):  # letters whose lower case is longer stay, so that positions hold
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in raw)
        quiet, worst, at, upto = 0.0, 0.0, None, None
        for m in SENTENCE.finditer(low):
            found = WORD.findall(m.group())
            if not found:
                continue
            hits = {x for v in map(words.__getitem__, found) if v is not none for x in v}
            if not hits:
                continue
            z = min(30.0, max(-30.0, bias + sum(map(weights.__getitem__, sorted(hits)))))
            p = float(1 / (1 + np.exp(-z)))
            quiet += float(np.log1p(-min(p, 1 - 1e-12)))
            if p > worst:
                worst, at, upto = p, m.start(), m.end()
        return float(-np.expm1(quiet)) + 0.0, worst, at, upto

    return score


def score_documents(docs: DataFrame, weights: dict[int, float], bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, score, worst (score of the worst sentence), at and upto (its code points)."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))  # at most BUCKETS weights

    def run(batches):
        import pyarrow as pa

        score = scorer(*model.value)
        for batch in batches:
            out = [score(t.as_py()) for t in batch.column(1)]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["id", "score", "worst", "at", "upto"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return pick(docs, id=id_col, t=text_col).mapInArrow(tidy(run), f"id {kind}, score double, worst double, at bigint, upto bigint")


def drop_toxic(docs: DataFrame, weights: dict[int, float], bias: float, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold; columns as given."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))
    at = docs.columns.index(text_col)

    def run(batches):
        score = scorer(*model.value)
        for batch in batches:
            good = [i for i, t in enumerate(batch.column(at)) if score(t.as_py())[0] < threshold]
            if good:
                yield batch.take(good)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", learn=None, max_per_class: int = 4000) -> tuple[dict[int, float], float]:
    """Weights and bias, learnt from at most ``max_per_class`` labelled documents of either label whose id ``learn`` takes."""
    sample = sample_bags(docs, labels, id_col, text_col, label_col, learn or (lambda k: F.lit(True)), max_per_class)
    buckets = telling(sample)
    return fit(pruned(sample, buckets), buckets) if buckets else ({}, -30.0)


def held_out(doc_id):
    """The third of the ids that no model learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, scored by weights of the labels that are not held out; empty and null texts score 0, null ids
    count as not held out, an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights, bias = train(docs, labels, learn=lambda k: ~held_out(k))
    out = score_documents(docs, weights, bias)
    return out.select(
        F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.col("worst").alias("worst_sentence"), F.col("at").alias("worst_start"), F.col("upto").alias("worst_end"),
    )
