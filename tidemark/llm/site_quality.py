"""Quality classifier by hierarchical empirical Bayes: document evidence with host and path posteriors.

A logistic model over shape statistics of the text gives each document's own evidence. Labels are counted by
host and by path; a host's rate is shrunk towards the global rate and a path's towards its host's, by a
strength that the spread between groups beyond chance gives (method of moments), so sites with few labels
stay near their parents. The score adds the path's shift in log-odds to the document's.

The document model learns from at most ``max_sample`` labelled rows, the least in a hash order of the ids; rates count
all labels. Null text reads as empty; null host and path are values of their own; rows with null labels are not learnt
from; sites without labels take their parent's rate; with labels of one kind only the document evidence is the
global rate; repeated rows are judged alike and counted each; very long texts are statistics like others; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize, pick
from .toxicity import held_out
from .url_rules import url_host, url_path

#: Site tables of at most so many rows are broadcast; larger ones join by shuffle.
BROADCAST_SITES = 50_000
FEATURES = ["log_words", "distinct", "top_repeat", "symbols", "upper", "bars", "bangs", "word_len", "digits", "line_repeat", "adjacent"]


def shape(text: Column) -> Column:
    """struct of shape statistics, each bounded and defined for empty texts."""
    words = F.filter(F.split(text, r"[\s]+"), lambda w: w != "")

    def of(ws: Column) -> Column:
        n, size = F.greatest(F.size(ws), F.lit(1)).cast("double"), F.greatest(F.length(text), F.lit(1)).cast("double")

        def count(pattern: str) -> Column:
            return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

        lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 20)
        twins = F.size(F.filter(F.zip_with(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: a == b), lambda t: t))
        return F.struct(
            F.log1p(F.size(ws)).alias("log_words"),
            (F.size(F.array_distinct(ws)) / n).alias("distinct"),
            F.least(F.lit(1.0), twins / n).alias("adjacent"),
            F.log1p(100 * twins / n).alias("top_repeat"),
            F.log1p(100 * count(r"[#*$%&@^~]") / n).alias("symbols"),
            (count(r"\p{Lu}") / size).alias("upper"),
            F.log1p(100 * count(r"\|") / n).alias("bars"),
            F.log1p(100 * count("!") / n).alias("bangs"),
            F.least(F.lit(20.0), size / n).alias("word_len"),
            (count("[0-9]") / size).alias("digits"),
            (1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))).alias("line_repeat"),
        )

    return F.get(F.transform(F.array(words), of), F.lit(0))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def shrunk(counts: DataFrame, parent: Column, out: str) -> DataFrame:
    """Adds ``out``: (good + k * parent) / (n + k), k from the spread of rates beyond binomial noise."""
    counts = counts.withColumn("_parent", parent)
    noise = F.col("_parent") * (1 - F.col("_parent")) / F.col("n")
    spread = F.sum(F.col("n") * (F.pow(F.col("good") / F.col("n") - F.col("_parent"), 2) - noise)) / F.sum("n")
    level = F.sum(F.col("n") * F.col("_parent") * (1 - F.col("_parent"))) / F.sum("n")
    k = counts.agg((F.greatest(level / F.greatest(spread, F.lit(1e-4)) - 1, F.lit(1.0))).alias("_k"))
    joined = counts.join(F.broadcast(k))  # one row
    rate = (F.col("good") + F.coalesce("_k", F.lit(1.0)) * F.col("_parent")) / (F.col("n") + F.coalesce("_k", F.lit(1.0)))
    return joined.withColumn(out, rate).drop("_parent", "_k")


def site_scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", host_col="source", path_col="lang", label_col="quality", learn=None, max_sample: int = 20_000, sites: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, own (document evidence), host_rate, path_rate, score. ``max_sample`` bounds the rows
    that the document model learns from. ``sites`` (id, host, path: a row an id) goes before the rows' own columns."""
    y = labels.select(labels[id_col].alias("id"), (labels[label_col] > 0).cast("int").alias("y")).filter("y is not null and id is not null")
    y = y.filter((learn or (lambda k: F.lit(True)))(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    rows = pick(docs, id=id_col, t=text_col, host=host_col, path=path_col)
    rows = rows.select("id", "host", "path", shape(F.coalesce("t", F.lit(""))).alias("s"))
    rows = materialize(rows.select("id", "host", "path", "s.*"), "site-shapes")
    if sites is not None:  # texts are no longer here; null ids have no site and meet no join
        met = join_hot(rows.filter("id is not null"), sites.select("id", F.col("host").alias("_h"), F.col("path").alias("_p")), "id", FEATURES[0], "left")
        met = met.withColumns({"host": F.coalesce("_h", "host"), "path": F.coalesce("_p", "path")}).select(rows.columns)
        rows = materialize(met.unionAll(rows.filter("id is null")), "site-rows")
    known = materialize(rows.join(y, "id"), "site-known")

    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_sample)
    kinds = known.agg(F.count_distinct("y").alias("k"), F.avg(F.col("y").cast("double")).alias("m")).first()
    rate = F.lit(0.5 if kinds["m"] is None else float(kinds["m"]))
    if kinds["k"] == 2:
        stages = [VectorAssembler(inputCols=FEATURES, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol="y", regParam=1e-3, maxIter=60, probabilityCol="_p")]
        model = Pipeline(stages=stages).fit(sample)
        scored = model.transform(rows).select("id", "host", "path", vector_to_array("_p")[1].alias("own"))
    else:
        scored = rows.select("id", "host", "path", rate.cast("double").alias("own"))

    by_path = known.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"))
    hosts = shrunk(by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), rate, "host_rate").select("host", "host_rate")
    p, h = by_path.alias("p"), hosts.alias("h")
    paths = p.join(h, F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "p.path", "p.n", "p.good", "h.host_rate")
    paths = materialize(shrunk(paths, F.col("host_rate"), "path_rate").select("host", "path", "host_rate", "path_rate"), "site-paths")
    hosts = materialize(paths.groupBy("host").agg(F.first("host_rate").alias("host_rate")), "site-hosts")
    small = paths.count() <= BROADCAST_SITES
    if small:
        s, p, h = scored.alias("s"), F.broadcast(paths).alias("p"), F.broadcast(hosts).alias("h")
        out = s.join(h, F.col("s.host").eqNullSafe(F.col("h.host")), "left").join(p, F.col("s.host").eqNullSafe(F.col("p.host")) & F.col("s.path").eqNullSafe(F.col("p.path")), "left")
    else:  # a large site's rows are dealt to several tasks
        of_host, of_path = F.to_json(F.array("host")), F.to_json(F.array("host", "path"))
        keyed = materialize(scored.select("id", "own", of_host.alias("hk"), of_path.alias("pk")), "site-scored")
        out = join_hot(keyed, hosts.select(of_host.alias("hk"), F.struct("host_rate").alias("h")), "hk", "id", "left")
        out = join_hot(out, paths.select(of_path.alias("pk"), F.struct("path_rate").alias("p")), "pk", "id", "left", keys=keyed).alias("s")
    host_rate = F.coalesce("h.host_rate", rate)
    path_rate = F.coalesce("p.path_rate", host_rate)
    score = 1 / (1 + F.exp(-(logit(F.col("s.own")) + logit(path_rate) - logit(rate))))
    return out.select("s.id", "s.own", host_rate.alias("host_rate"), path_rate.alias("path_rate"), score.alias("score"))


def page_sites(pages: DataFrame) -> DataFrame:
    """(id, host, path) of the documents whose number ends a page's URL: of the least such URL, path its first folder."""
    path = url_path(pages["url"])
    number = F.try_to_number(F.regexp_extract(path, r"([0-9]{1,18})(?:\.[a-z]+)?/?$", 1), F.lit("9" * 18)).cast("long")
    sites = pages.select(number.alias("id"), F.struct(pages["url"].alias("url"), url_host(pages["url"]).alias("host"), F.regexp_extract(path, r"^/([^/]*)/", 1).alias("path")).alias("p"))
    return sites.filter("id is not null").groupBy("id").agg(F.min("p").alias("p")).select("id", "p.host", "p.path")


def with_sites(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, host, path) of each document: its page's, else its source and language."""
    own = docs.select(docs["doc_id"], docs["source"], docs["lang"])
    out = own.join(page_sites(pages).withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("host", "source").alias("host"), F.coalesce("path", "lang").alias("path"))


def op6_site_quality(spark, sf_dir: str) -> DataFrame:
    """All documents by the site of their page, else by source and language; null texts are empty, an empty table gives no rows."""
    docs, labels, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "pages"))
    out = site_scores(docs, labels, learn=lambda k: ~held_out(k), sites=page_sites(pages))
    return out.select(
        F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), F.round("own", 9).alias("doc_score"),
        "host_rate", "path_rate", "score", (F.col("score") >= 0.5).cast("int").alias("keep"),
    )
