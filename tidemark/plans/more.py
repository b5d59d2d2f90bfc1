"""Queries over blocks of texts, spans of time, per-key ledgers, stores and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import hashing as H
from tidemark.functions import text as T
from tidemark.operators import blocks, intervals, ledgers, quality, retrieval
from tidemark.plans.content import LOW, TERMS, _T, ESTIMATE, read, simhash_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def events(spark, d):
    """The request log with whole seconds in ``s``."""
    return read(spark, d, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))


_E = "(SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)"

# Blocks -----------------------------------------------------------------------------------------------------

#: Documents as markdown: the first line a heading, every further line one of the second level, questions of the third.
_MD = "'# ' || replace(replace(text, chr(10), chr(10) || chr(10) || '## '), '? ', '?' || chr(10) || chr(10) || '### ')"
_BLOCKS = f"""l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) - 1 AS pos FROM (SELECT doc_id, {_MD} AS md FROM documents) m),
i AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(line, '^\\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM l),
k AS (SELECT *, trim(line) = '' AND NOT inside AS blank FROM i),
n AS (SELECT *, CASE WHEN NOT blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY pos), true) THEN 1 ELSE 0 END AS starts FROM k),
b AS (SELECT doc_id, block, min(pos) AS first, string_agg(line, chr(10) ORDER BY pos) AS text FROM (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM n) x WHERE NOT blank GROUP BY doc_id, block)"""


def markdown(spark, d):
    md = F.concat(F.lit("# "), F.replace(F.replace("text", F.lit("\n"), F.lit("\n\n## ")), F.lit("? "), F.lit("?\n\n### ")))
    return blocks.markdown_blocks(read(spark, d, "documents").select("doc_id", md.alias("md")), "doc_id", "md")


@query("bd1_markdown_blocks", f"WITH {_BLOCKS} SELECT doc_id, block, first, md5(text) AS digest FROM b")
def bd1(spark, d):
    return markdown(spark, d).select("doc_id", "block", "first", F.md5("text").alias("digest"))


def _path(n: int) -> str:
    w = "OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""CASE WHEN last_value(CASE WHEN level = {n} THEN block END IGNORE NULLS) {w} > coalesce(last_value(CASE WHEN level < {n} THEN block END IGNORE NULLS) {w}, -1) THEN last_value(CASE WHEN level = {n} THEN title END IGNORE NULLS) {w} END"""


@query("wn8_heading_path", f"""WITH {_BLOCKS}, h AS (SELECT doc_id, block, CASE WHEN regexp_matches(text, '^#{{1,6}}\\s') THEN length(regexp_extract(text, '^#{{1,6}}', 0)) END AS level, trim(regexp_replace(split_part(text, chr(10), 1), '^#{{1,6}}\\s+', '')) AS title FROM b)
SELECT doc_id, block, array_to_string(list_filter([{", ".join(_path(n) for n in range(1, 7))}], lambda x: x IS NOT NULL), ' > ') AS path FROM h""")
def wn8(spark, d):
    return blocks.heading_path(markdown(spark, d), "doc_id", "block", "text").select("doc_id", "block", "path")


@query("bd4_verbatim_pages", f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '\\n', chr(10) || chr(30), 'g'), chr(30)), lambda x: x <> '') AS ls FROM documents) t),
c AS (SELECT *, {ESTIMATE.format(x='line')} AS cost FROM l),
r AS (SELECT doc_id, i, line, cost AS used, 0 AS page FROM c WHERE i = 1 UNION ALL
 SELECT c.doc_id, c.i, c.line, CASE WHEN r.used = 0 OR r.used + c.cost <= 200 THEN r.used + c.cost ELSE c.cost END, CASE WHEN r.used = 0 OR r.used + c.cost <= 200 THEN r.page ELSE r.page + 1 END FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i + 1)
SELECT doc_id, page, md5(string_agg(line, '' ORDER BY i)) AS digest FROM r GROUP BY doc_id, page""")
def bd4(spark, d):
    return blocks.verbatim_pages(read(spark, d, "documents"), "doc_id", "text", 200).select("doc_id", "page", F.md5("text").alias("digest"))


@query("bd5_cursor", "SELECT doc_id, printf('%x.%x.%x', doc_id, n_chars, doc_id % 1000) AS cursor, doc_id AS block, n_chars AS \"offset\" FROM documents")
def bd5(spark, d):
    docs = read(spark, d, "documents").select("doc_id", T.page_cursor(F.col("doc_id"), F.col("n_chars").cast("long"), F.col("doc_id") % 1000).alias("cursor"))
    read_ = T.read_cursor(F.col("cursor"))
    return docs.select("doc_id", "cursor", read_["block"].alias("block"), read_["offset"].alias("offset"))


@query("tk1_best_blocks", f"""WITH b AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) x),
t AS (SELECT doc_id, pos, regexp_extract_all({LOW.replace("text", "line")}, '[a-z0-9]+') AS toks FROM b),
s AS (SELECT doc_id, count(*) AS n, greatest(avg(len(toks)), 1) AS avgdl FROM t GROUP BY doc_id),
f AS (SELECT doc_id, pos, len(toks) AS dl, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM t, {_T}),
df AS (SELECT doc_id, term, count(*) AS df FROM f WHERE tf > 0 GROUP BY 1, 2),
sc AS (SELECT f.doc_id, f.pos, round(sum(CASE WHEN tf > 0 THEN ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) ELSE 0 END), 9) AS score, max(n) AS n FROM f JOIN s ON s.doc_id = f.doc_id LEFT JOIN df ON df.doc_id = f.doc_id AND df.term = f.term GROUP BY 1, 2)
SELECT doc_id, pos, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank, max(score) OVER (PARTITION BY doc_id) AS best FROM sc) r WHERE rank <= 3 OR best = 0 OR n <= 3""")
def tk1(spark, d):
    ls = blocks.lines(read(spark, d, "documents"), "doc_id", "text")
    return blocks.best_blocks(ls, TERMS, 3, "doc_id", "pos", "line").withColumn("score", F.round("score", 6))


@query("rk2_literal_lines", "SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) x WHERE contains(line, 'mail3.example.com') OR contains(line, 'api_key=')")
def rk2(spark, d):
    terms = T.literal_terms(F.lit("where is 'mail3.example.com' or api_key= used"))
    found = F.exists(terms, lambda t: F.contains("line", t))
    return blocks.lines(read(spark, d, "documents"), "doc_id", "text").filter(found).select("doc_id", "pos", "line")


# Time -------------------------------------------------------------------------------------------------------


@query("jn10_in_spans", f"SELECT e.event_id, p.event_id AS span FROM {_E} e JOIN {_E} p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND e.s >= p.s AND e.s < p.s + 1800 + p.event_id % 7 * 600")
def jn10(spark, d):
    e = events(spark, d)
    spans = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span"), F.col("s").alias("a"), (F.col("s") + 1800 + F.col("event_id") % 7 * 600).alias("b"))
    return intervals.in_spans(e.select("user_id", "event_id", "s"), spans, "user_id", "s", "a", "b", 3600).select("event_id", "span")


@query("jn11_nearest", f"SELECT event_id, click, gap FROM (SELECT e.event_id, c.event_id AS click, abs(e.s - c.s) AS gap, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.s - c.s), c.s, c.event_id) AS rn FROM {_E} e JOIN {_E} c ON c.user_id = e.user_id AND c.event_type = 'click' AND abs(e.s - c.s) <= 7200 WHERE e.event_type = 'error') t WHERE rn = 1")
def jn11(spark, d):
    e = events(spark, d)
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("s").alias("at"))
    return intervals.nearest(e.filter("event_type = 'error'"), clicks, "user_id", "event_id", "s", "click", "at", 7200)


@query("jn12_overlaps", f"SELECT a.event_id AS a, b.event_id AS b FROM {_E} a JOIN {_E} b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND a.s < b.s + 1200 AND b.s < a.s + 2400")
def jn12(spark, d):
    e = events(spark, d)
    x = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a"), F.col("s").alias("a1"), (F.col("s") + 2400).alias("a2"))
    y = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("b"), F.col("s").alias("b1"), (F.col("s") + 1200).alias("b2"))
    return intervals.overlapping(x, y, "user_id", ("a1", "a2"), ("b1", "b2"), 3600).select("a", "b")


@query("tk8_apart", """WITH RECURSIVE k AS (SELECT query, key, rank FROM (SELECT a.vec_id AS query, b.vec_id AS key, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) t WHERE rank <= 30),
r AS (SELECT DISTINCT query, 0::bigint AS rank, []::bigint[] AS took FROM k UNION ALL SELECT r.query, k.rank, CASE WHEN len(took) < 5 AND len(list_filter(took, lambda t: abs(t - k.key) < 25)) = 0 THEN list_append(took, k.key) ELSE took END FROM r JOIN k ON k.query = r.query AND k.rank = r.rank + 1)
SELECT query, unnest(took) AS key, generate_subscripts(took, 1)::integer AS place FROM (SELECT query, arg_max(took, rank) AS took FROM r GROUP BY query) x""")
def tk8(spark, d):
    e = read(spark, d, "embeddings")
    top = retrieval.vector_topk(e.filter("vec_id % 20 = 0"), e, 30)
    return intervals.apart(top, "query", "rank", "key", 25, 5)


@query("wn6_running_coverage", f"WITH f AS (SELECT source, term, min(doc_id) AS doc_id FROM documents, {_T} WHERE list_contains(regexp_extract_all({LOW}, '[a-z0-9]+'), term) GROUP BY 1, 2), n AS (SELECT source, doc_id, count(*) AS k FROM f GROUP BY 1, 2) SELECT source, doc_id, CAST(sum(k) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS covered FROM n")
def wn6(spark, d):
    docs = read(spark, d, "documents")
    t = docs.select("source", "doc_id", F.explode(F.array_intersect(T.ascii_tokens(F.col("text")), F.array(*[F.lit(x) for x in TERMS]))).alias("term"))
    first = t.groupBy("source", "term").agg(F.min("doc_id").alias("doc_id"))  # a row a source and term
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return first.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("k")).select("source", "doc_id", F.sum("k").over(w).alias("covered"))


@query("wn4_new_words", f"SELECT doc_id, count(*) AS fresh FROM (SELECT source, w, min(doc_id) AS doc_id FROM (SELECT source, doc_id, unnest(list_filter(regexp_split_to_array({LOW}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: octet_length(encode(w)) > 2)) AS w FROM documents) x GROUP BY source, w) f GROUP BY doc_id")
def wn4(spark, d):
    w = read(spark, d, "documents").select("source", "doc_id", F.explode(F.array_distinct(T.long_words(F.col("text")))).alias("w"))
    return w.groupBy("source", "w").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("fresh"))


# Ledgers ----------------------------------------------------------------------------------------------------


@query("ag18_pacing", "WITH RECURSIVE e AS (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r AS (SELECT user_id, rn, value AS s, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS strikes FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, 0.7 * r.s + 0.3 * e.value, CASE WHEN e.event_type = 'error' THEN r.strikes + 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) SELECT user_id, round(arg_max(s, rn), 6) AS latency, arg_max(strikes, rn)::bigint AS strikes, least(3600, 30 * pow(4, least(arg_max(strikes, rn), 6)))::bigint AS hold_s FROM r GROUP BY user_id")
def ag18(spark, d):
    e = read(spark, d, "events")
    good = F.max(F.when(F.col("event_type") != "error", F.struct("ts", "event_id"))).alias("good")
    last = e.groupBy("user_id").agg(good)
    after = e.join(last, "user_id").filter(F.col("good").isNull() | (F.struct("ts", "event_id") > F.col("good"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    out = ledgers.ewma(e, "user_id", ["ts", "event_id"], "value").join(after, "user_id", "left").withColumn("strikes", F.coalesce("n", F.lit(0)))
    return out.select("user_id", F.round("ewma", 6).alias("latency"), "strikes", F.least(F.lit(3600), 30 * F.pow(F.lit(4), F.least("strikes", F.lit(6)))).cast("long").alias("hold_s"))


_OUTCOME = "CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'view' THEN 'useless' ELSE 'ok' END"


@query("ag20_engine_health", f"WITH RECURSIVE e AS (SELECT user_id, {_OUTCOME} AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r AS (SELECT DISTINCT user_id, 0::bigint AS rn, 0.5::double AS h FROM events UNION ALL SELECT e.user_id, e.rn, CASE o WHEN 'ok' THEN h * 0.7 + 0.3 WHEN 'useless' THEN h * 0.9 ELSE h * 0.6 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) SELECT user_id, round(arg_max(h, rn), 6) AS health FROM r GROUP BY user_id")
def ag20(spark, d):
    e = read(spark, d, "events").withColumn("o", F.expr(_OUTCOME))
    return ledgers.engine_health(e, "user_id", ["ts", "event_id"], "o").withColumn("health", F.round("health", 6))


@query("snk9_upsert", "SELECT conv_id, turn, h AS digest, n = 1 AS current FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM (SELECT conv_id, turn, md5(text) AS h, lag(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) a WHERE prev IS NULL OR prev <> h) b WHERE n <= 20")
def snk9(spark, d):
    return ledgers.upsert(read(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("digest")), "conv_id", "turn", "digest")


@query("chg2_page_diff", f"""WITH s AS ({simhash_sql("conversations", "conv_id, turn")}),
v AS (SELECT c.conv_id, c.turn, c.text, s.simhash, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) AS n, count(*) OVER (PARTITION BY c.conv_id) AS versions FROM conversations c JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn)
SELECT a.conv_id, a.versions AS versions_known, CASE WHEN b.text IS NOT NULL THEN a.text <> b.text END AS changed, CASE WHEN b.text IS NOT NULL THEN 1 - bit_count(xor(a.simhash, b.simhash)) / 64.0::double END AS similarity,
 CAST(len(list_filter(list_distinct(string_split(a.text, chr(10))), lambda x: NOT list_contains(string_split(b.text, chr(10)), x))) AS BIGINT) AS added,
 CAST(len(list_filter(list_distinct(string_split(b.text, chr(10))), lambda x: NOT list_contains(string_split(a.text, chr(10)), x))) AS BIGINT) AS removed
FROM (SELECT * FROM v WHERE n = 1) a LEFT JOIN (SELECT * FROM v WHERE n = 2) b ON b.conv_id = a.conv_id""")
def chg2(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "text", H.simhash64("text").alias("simhash"))
    known = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("versions_known"))
    two = ledgers.newest(c, "conv_id", ["turn"], 2)
    now, old = two.filter("back = 1"), two.filter("back = 2").select("conv_id", F.col("text").alias("old"), F.col("simhash").alias("was"))
    both = now.join(old, "conv_id", "left").join(known, "conv_id")
    a, b = F.split("text", "\n"), F.split("old", "\n")
    some = F.col("old").isNotNull()
    return both.select(
        "conv_id", "versions_known", F.when(some, F.col("text") != F.col("old")).alias("changed"), F.when(some, H.similarity(F.col("simhash"), F.col("was"))).alias("similarity"),
        F.size(F.array_except(a, b)).cast("long").alias("added"), F.size(F.array_except(b, a)).cast("long").alias("removed"),
    )


# Verdicts and terms -----------------------------------------------------------------------------------------


@query("q2_structured_verdict", "SELECT event_id, CASE WHEN x = '' THEN 'empty' WHEN json_valid(x) THEN 'ok' WHEN length(x) - length(regexp_replace(x, '[{\\[]', '', 'g')) > length(x) - length(regexp_replace(x, '[}\\]]', '', 'g')) THEN 'truncated' ELSE 'malformed' END AS verdict FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN substring(props, 1, length(props) - 1) WHEN 2 THEN props || '}' ELSE '' END AS x FROM events) t")
def q2(spark, d):
    k = F.col("event_id") % 4
    x = F.when(k == 0, F.col("props")).when(k == 1, F.expr("substring(props, 1, length(props) - 1)")).when(k == 2, F.concat("props", F.lit("}"))).otherwise(F.lit(""))
    return read(spark, d, "events").select("event_id", x.alias("x")).select("event_id", quality.structured_verdict(F.col("x")).alias("verdict"))


@query("cl4_markup_sniff", "SELECT 'page' AS kind, page_id AS id, TRUE AS markup FROM pages UNION ALL SELECT 'document', doc_id, regexp_matches(text, '^\\s*<(!doctype|html|head|body|\\?xml)') FROM documents")
def cl4(spark, d):
    both = read(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("x")).unionByName(read(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("x")))
    return both.select("kind", "id", F.col("x").rlike(r"(?i)^\s*<(!doctype|html|head|body|\?xml)").alias("markup"))


@query("rk5_off_topic", f"SELECT doc_id, len(list_filter(['idiot', 'the', 'under'], lambda t: contains(lower(text), t))) < 2 AS off_topic FROM documents")
def rk5(spark, d):
    terms = T.query_terms(F.lit("Of the IDIOT under a"), ["of", "a"])
    return read(spark, d, "documents").select("doc_id", T.off_topic(terms, F.col("text")).alias("off_topic"))


@query("dat2_retry_after", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id WHEN doc_id % 3 = 1 THEN greatest(CAST(epoch(DATE '2024-01-01') AS BIGINT) + doc_id * 3600 - 1706745600, 0) END AS wait_s FROM documents")
def dat2(spark, d):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    header = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise(F.lit("soon"))
    return read(spark, d, "documents").select("doc_id", T.retry_after(header, F.lit(1706745600)).alias("wait_s"))


@query("dat3_durations", "SELECT doc_id, n_chars::double AS seconds, CASE WHEN n_chars >= 3600 THEN printf('%d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) ELSE printf('%d:%02d', n_chars // 60, n_chars % 60) END AS clock FROM documents")
def dat3(spark, d):
    n = F.col("n_chars").cast("long")
    iso = F.concat(F.lit("PT"), F.floor(n / 3600), F.lit("H"), F.floor(n % 3600 / 60), F.lit("M"), n % 60, F.lit("S"))
    return read(spark, d, "documents").select("doc_id", T.iso_duration(iso).alias("seconds"), T.clock(n).alias("clock"))


@query("dat4_cache_ttl", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN least(n_chars, 3600) WHEN 2 THEN 300 ELSE 3600 END::bigint AS ttl FROM documents")
def dat4(spark, d):
    k = F.col("doc_id") % 4
    header = F.when(k == 0, "Private, No-Store").when(k == 1, F.concat(F.lit("public, max-age="), F.col("n_chars"))).otherwise("")
    return read(spark, d, "documents").select("doc_id", T.cache_ttl(header, k == 2, 3600).alias("ttl"))


@query("str9_numbers", "SELECT doc_id, round(n_chars + (doc_id % 100) / 100.0, 2)::double AS value FROM documents")
def str9(spark, d):
    n, cents = F.col("n_chars"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0")
    us = F.concat(F.lit("$ "), F.format_number(n, 0), F.lit("."), cents)
    eu = F.concat(F.translate(F.format_number(n, 0), ",", "."), F.lit(","), cents, F.lit(" EUR"))
    return read(spark, d, "documents").select("doc_id", T.parse_number(F.when(F.col("doc_id") % 2 == 0, us).otherwise(eu)).alias("value"))


@query("ag15_jaccard", "SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(list_concat(x, y))) ELSE 0 END::double, 9) AS jaccard FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS x FROM documents) a JOIN (SELECT doc_id - 1 AS doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS y FROM documents) b ON b.doc_id = a.doc_id")
def ag15(spark, d):
    t = read(spark, d, "documents").select("doc_id", T.ascii_tokens(F.col("text")).alias("x"))
    pairs = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id")
    return pairs.select("doc_id", F.round(T.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


@query("mth4_iou", "SELECT vec_id, round(w * h / (64.0 + 36.0 - w * h), 9) AS iou FROM (SELECT vec_id, greatest(0, least(8, x + 6) - greatest(0, x))::double AS w, greatest(0, least(8, y + 6) - greatest(0, y))::double AS h FROM (SELECT vec_id, vec_id % 10 AS x, vec_id % 7 AS y FROM embeddings) a) b")
def mth4(spark, d):
    x, y = F.col("vec_id") % 10, F.col("vec_id") % 7
    iou = retrieval.iou(*[F.lit(v) for v in (0, 0, 8, 8)], x, y, x + 6, y + 6)
    return read(spark, d, "embeddings").select("vec_id", F.round(iou, 9).alias("iou"))


@query("mth3_histogram_distance", "SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i]::double - b.embedding[i]::double))) / 6, 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mth3(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(retrieval.histogram_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("ml6_weak_labels", f"SELECT event_id, CASE WHEN nxt IS NULL OR nxt - s >= 120 THEN 'substantive' ELSE 'ordinary' END AS label FROM (SELECT event_id, event_type, s, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 120 PRECEDING AND 120 FOLLOWING) AS burst, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS nxt FROM {_E} e) t WHERE event_type <> 'error' AND burst <= 4")
def ml6(spark, d):
    near = Window.partitionBy("user_id").orderBy("s").rangeBetween(-120, 120)
    e = events(spark, d).withColumn("burst", F.count(F.lit(1)).over(near)).withColumn("nxt", F.lead("s").over(Window.partitionBy("user_id").orderBy("s", "event_id")))
    quiet = F.col("nxt").isNull() | (F.col("nxt") - F.col("s") >= 120)
    return e.filter("event_type <> 'error' and burst <= 4").select("event_id", F.when(quiet, "substantive").otherwise("ordinary").alias("label"))


@query("ml5_holdout", "SELECT user_id, label, (row_number() OVER (PARTITION BY label ORDER BY user_id) - 1) % 5 = 0 AS held_out FROM (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS label FROM events GROUP BY user_id) t")
def ml5(spark, d):
    last = read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("label"))
    w = Window.partitionBy("label").orderBy("user_id")
    return last.select("user_id", "label", ((F.row_number().over(w) - 1) % 5 == 0).alias("held_out"))


@query("tk10_watches_due", f"SELECT user_id, checked FROM (SELECT user_id, max(CASE WHEN event_type = 'view' THEN s END) AS checked, 3600 * (1 + user_id % 24) AS every FROM {_E} e GROUP BY user_id) t WHERE checked IS NULL OR checked + every <= 1706659200")
def tk10(spark, d):
    w = events(spark, d).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("s"))).alias("checked"))
    return w.filter(F.col("checked").isNull() | (F.col("checked") + 3600 * (1 + F.col("user_id") % 24) <= 1706659200)).orderBy(F.asc_nulls_first("checked"), "user_id")
