"""Ranking: BM25, reciprocal-rank fusion, cosine top-k, MMR, frontier scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.scratch import written

K1, B, RRF_K = 1.5, 0.75, 60


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", group: str | None = None) -> DataFrame:
    """(group, key, score) of the rows with a positive score; statistics per group, or over all rows.

    One pass over the texts writes length and term counts of each row; statistics and scores read those few numbers.
    """
    groups = [group] if group else []
    wanted = sorted(set(terms))
    low = T.ascii_lower(F.col(text))
    hits = F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9])(?:{'|'.join(wanted)})(?![a-z0-9])"), F.lit(0))  # few, and all that is listed
    rows = docs.select(key, *groups, F.regexp_count(low, F.lit("[a-z0-9]+")).alias("len"), hits.alias("hits"))

    def count(term: str) -> Column:
        return F.size(F.filter("hits", lambda x: x == term))

    rows = written(rows.select(key, *groups, "len", *[count(t).alias(f"tf{i}") for i, t in enumerate(wanted)]), "bm25")
    stats = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    rows = rows.filter(" or ".join(f"tf{i} > 0" for i in range(len(wanted))))
    joined = rows.join(F.broadcast(stats), group) if group else rows.crossJoin(F.broadcast(stats))  # one row a group
    score = F.lit(0.0)
    for i, t in enumerate(wanted):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + terms.count(t) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return joined.select(*groups, key, score.alias("score")).filter("score > 0")


def fuse(ranked: DataFrame, query: str, key: str, rank: str, k: int = RRF_K) -> DataFrame:
    """(query, key, score, lists): sum of 1/(k + rank) over the lists; ranks start at 1."""
    return ranked.groupBy(query, key).agg(F.sum(1.0 / (k + F.col(rank))).alias("score"), F.count(F.lit(1)).alias("lists"))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", block: int = 256, most: int = 50_000) -> DataFrame:
    """(query, key, score, rank) of the k nearest rows by cosine, exact; ties go to the smaller key.

    The query set is stated. It goes to the tasks in parts of at most ``most`` queries, a scan of the corpus each; a
    partition keeps its own k best of every query, so what is shuffled is k rows a query and partition, never all pairs.
    """
    wanted = queries.select(key, vec).filter(F.col(vec).isNotNull())
    parts = max(1, -(-wanted.count() // most))
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    out = None
    for p in range(parts):
        some = _topk_part((wanted if parts == 1 else wanted.filter(part == p)).collect(), corpus, k, key, vec, block)
        out = some if out is None else out.unionByName(some)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _topk_part(rows, corpus: DataFrame, k: int, key: str, vec: str, block: int) -> DataFrame:
    names = [r[0] for r in rows]
    mat = np.array([np.asarray(r[1], np.float64) / (np.linalg.norm(r[1]) or 1.0) for r in rows]) if rows else np.zeros((0, 1))
    sent = corpus.sparkSession.sparkContext.broadcast((names, mat))

    def best(batches):
        names, mat = sent.value
        keep: list[list[tuple[float, int]]] = [[] for _ in names]
        for pdf in batches:
            pdf = pdf[pdf[vec].notna()]
            if not len(pdf) or not len(names):
                continue
            x = np.stack([np.asarray(v, np.float64) for v in pdf[vec]])
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            ids = pdf[key].to_numpy()
            for low in range(0, len(names), block):
                sims = mat[low : low + block] @ x.T
                for i, row in enumerate(sims):
                    row, q = np.round(row, 9), low + i
                    least = np.partition(row, -min(k + 1, len(row)))[-min(k + 1, len(row))]
                    top = np.flatnonzero(row >= least)  # with all that tie at the cut
                    top = top[np.lexsort((ids[top], -row[top]))[: k + 1]]
                    keep[q] = sorted(keep[q] + [(-float(row[j]), int(ids[j])) for j in top if ids[j] != names[q]])[:k]
        yield pd.DataFrame([(n, i, -s) for n, rows in zip(names, keep, strict=True) for s, i in rows], columns=["query", "key", "score"]).astype({"query": "int64", "key": "int64", "score": "float64"})

    return corpus.select(key, vec).mapInPandas(best, "query bigint, key bigint, score double")


def mmr(lists: DataFrame, query: str, order: str, key: str, vec: str, weight: float = 0.5) -> DataFrame:
    """Greedy diversity order of each short ranked list: (query, key, rank). Lists are a page of results long.

    The first item stays; relevance falls with position; similarity counts from 0.5 up; ties go to the earlier.
    """
    def reorder(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, key]).reset_index(drop=True)
        n = len(pdf)
        if n < 3:
            return pd.DataFrame({query: pdf[query], key: pdf[key], "rank": np.arange(1, n + 1)})
        x = np.stack([np.asarray(v, np.float64) for v in pdf[vec]])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        extra = np.maximum(0, (x @ x.T - 0.5) / 0.5)
        relevance = 1 - np.arange(n) / n
        chosen, rest, worst = [0], list(range(1, n)), extra[0].copy()
        while rest:
            value = [weight * relevance[i] - (1 - weight) * worst[i] for i in rest]
            i = rest.pop(int(np.argmax(np.round(value, 12))))
            chosen.append(i)
            worst = np.maximum(worst, extra[i])
        out = pdf.iloc[chosen]
        return pd.DataFrame({query: out[query].to_numpy(), key: out[key].to_numpy(), "rank": np.arange(1, n + 1)})

    return lists.groupBy(query).applyInPandas(reorder, f"{query} bigint, {key} bigint, rank bigint")


#: Prior of a candidate's source.
SOURCE_PRIOR = {"seed": 1.0, "sitemap": 0.6, "feed": 0.7, "llms": 0.8, "link": 0.4}


def frontier_score(relevance: Column, source: Column, parent: Column, depth: Column, segments: Column, age_days: Column) -> Column:
    """Crawl priority: relevance, source and parent raise it, depth and long paths lower it, freshness helps."""
    priors = F.create_map(*[F.lit(x) for kv in SOURCE_PRIOR.items() for x in kv])
    prior = F.coalesce(priors[source], F.lit(0.4))
    fresh = F.coalesce(0.4 * F.exp(-age_days / 90.0), F.lit(0.0))
    return 1.2 * relevance + 0.6 * prior + 0.4 * parent - 0.25 * depth - 0.08 * segments + fresh


def iou(ax1: Column, ay1: Column, ax2: Column, ay2: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """Overlap of two boxes by their union; 0 if they do not meet."""
    w, h = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    inter = (F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))).cast("double")
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def histogram_distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two histograms of three channels, each of sum 1, by 6: 0 alike, 1 apart."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v) / 6


def one_word_answers(results: DataFrame, query: str, terms: str, shown: str) -> DataFrame:
    """(query, word): result lists that answer one word of a query: of three results or more to three terms or more, none
    holds two terms, all that hold one hold the same, and those are at least 70%."""
    held = F.filter(terms, lambda t: F.contains(F.lower(shown), t))
    rows = results.filter(F.size(terms) >= 3).select(query, held.alias("h"))
    one = F.when(F.size("h") == 1, F.get("h", F.lit(0)))
    g = rows.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("h")).alias("most"), F.min(one).alias("low"), F.max(one).alias("high"), F.count(one).alias("hits"))
    return g.filter("n >= 3 and most = 1 and low = high and hits * 10 >= n * 7").select(query, F.col("low").alias("word"))
