"""Queries over pages and documents: URLs, text, quality, duplicates, retrieval, changes, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import hashing as H
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import dedup, ledgers, quality, retrieval
from tidemark.scratch import written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


HOST = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
DOMAIN = f"regexp_replace({HOST}, '^www\\.', '')"
PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
TRACKING = "(" + ", ".join(f"'{t}'" for t in U.TRACKING) + ")"
PAIRS = f"list_sort(list_transform(list_filter(string_split({QUERY}, '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN {TRACKING}), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END))"
NORMAL = f"lower(regexp_extract(url, '^[a-zA-Z]+://', 0)) || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), ':80$', '') || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || CASE WHEN len({PAIRS}) > 0 THEN '?' || array_to_string({PAIRS}, '&') ELSE '' END"
FNV = "list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(0, octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::uhugeint)), lambda a, b: (xor(a, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"
SIGNED = "CASE WHEN {x} >= 9223372036854775808::uhugeint THEN ({x}::hugeint - 18446744073709551616::hugeint)::bigint ELSE {x}::bigint END"
LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"list_filter(regexp_split_to_array({LOW}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
ESTIMATE = "(ceil(length(regexp_replace({x}, '[\\x{{2E81}}-\\x{{10FFFF}}]', '', 'g')) / 4.0) + (length({x}) - length(regexp_replace({x}, '[\\x{{2E81}}-\\x{{10FFFF}}]', '', 'g'))) + floor((length({x}) - length(regexp_replace({x}, '[\\x{{2E81}}-\\x{{10FFFF}}]', '', 'g'))) / 4.0))::bigint"


# URLs -------------------------------------------------------------------------------------------------------


@query("url1_domain", f"SELECT page_id, {DOMAIN} AS domain FROM pages")
def url1(spark, d):
    return read(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("domain"))


@query("url2_same_site", f"SELECT page_id, ({DOMAIN} = 'example.org' OR {DOMAIN} LIKE '%.example.org') AS same FROM pages")
def url2(spark, d):
    return read(spark, d, "pages").select("page_id", U.same_site(U.domain(F.col("url")), F.lit("example.org")).alias("same"))


@query("url3_normalize", f"SELECT page_id, {NORMAL} AS canonical FROM pages")
def url3(spark, d):
    return read(spark, d, "pages").select("page_id", U.normalize(F.col("url")).alias("canonical"))


@query("url4_stable_hash", f"SELECT page_id, {SIGNED.format(x='h')} AS url_hash FROM (SELECT page_id, {FNV.format(x='url')} AS h FROM pages) t")
def url4(spark, d):
    return read(spark, d, "pages").select("page_id", H.fnv64("url").alias("url_hash"))


@query("url5_result_key", f"SELECT page_id, regexp_replace({NORMAL}, '/(\\?|$)', '\\1') AS result_key FROM pages")
def url5(spark, d):
    return read(spark, d, "pages").select("page_id", U.result_key(F.col("url")).alias("result_key"))


@query("url6_unwrap", "SELECT page_id, url AS target FROM pages")
def url6(spark, d):
    wrapped = F.concat(F.lit("https://duck.example/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))
    return read(spark, d, "pages").select("page_id", U.unwrap_redirect(wrapped).alias("target"))


@query("url9_pagination", f"SELECT page_id, CAST(regexp_extract({QUERY}, '(?:^|&)(page|p|pg|start|offset|from|skip)=([0-9]{{1,9}})(?:&|$)', 2) AS BIGINT) AS n FROM pages WHERE regexp_matches({QUERY}, '(?:^|&)(page|p|pg|start|offset|from|skip)=([0-9]{{1,9}})(?:&|$)')")
def url9(spark, d):
    return read(spark, d, "pages").select("page_id", U.page_number(F.col("url"))["n"].alias("n")).filter("n is not null")


@query("url10_next_page", "SELECT page_id, regexp_replace(url, '([?&]page=)2', '\\13') AS next_url FROM pages WHERE url LIKE '%?page=2%'")
def url10(spark, d):
    return read(spark, d, "pages").select("page_id", U.next_page(F.col("url")).alias("next_url")).filter("next_url is not null")


@query("url11_depth", f"SELECT page_id, {PATH} IN ('', '/', '/index.html') AS root, (contains(regexp_replace({PATH}, '^/|/$', '', 'g'), '/') OR length(regexp_replace({PATH}, '^/|/$', '', 'g')) > 12) AS deep FROM pages")
def url11(spark, d):
    p = U.path(F.col("url"))
    return read(spark, d, "pages").select("page_id", U.is_root(p).alias("root"), U.is_deep(p).alias("deep"))


@query("url12_blocklist", f"SELECT page_id, url FROM pages WHERE regexp_matches({DOMAIN}, '(^|\\.)(spam-farm\\.example\\.org|casino-win\\.example\\.net|ads-track\\.example\\.com)$')")
def url12(spark, d):
    rules = spark.createDataFrame([("spam-farm.example.org",), ("casino-win.example.net",), ("ads-track.example.com",)], "host string")
    return U.blocked_hosts(read(spark, d, "pages").select("page_id", "url"), rules, "url", "page_id").select("page_id", "url")


@query("url14_origin_policy", f"SELECT page_id, CASE WHEN regexp_matches({DOMAIN}, '(^|\\.)spam-farm\\.example\\.org$') THEN 'blocked' WHEN NOT regexp_matches({DOMAIN}, '(^|\\.)example\\.(org|net)$') THEN 'not_listed' ELSE 'ok' END AS verdict FROM pages")
def url14(spark, d):
    return read(spark, d, "pages").select("page_id", U.origin_policy(F.col("url"), ["spam-farm.example.org"], ["example.org", "example.net"]).alias("verdict"))


@query("mx1_endpoint_shapes", "SELECT regexp_replace(url, '[0-9]+', '#', 'g') AS shape, min(page_id) AS first_page, count(*) AS n FROM pages GROUP BY 1")
def mx1(spark, d):
    return read(spark, d, "pages").groupBy(U.url_shape(F.col("url")).alias("shape")).agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))


@query("mx2_longest_route", f"SELECT page_id, CASE WHEN {DOMAIN} LIKE '%ththre.example.org' THEN 'c' WHEN {DOMAIN} LIKE '%.example.org' THEN 'b' WHEN {DOMAIN} LIKE '%.example.net' THEN 'a' END AS route FROM pages")
def mx2(spark, d):
    routes = spark.createDataFrame([("example.net", "a"), ("example.org", "b"), ("ththre.example.org", "c")], "host string, route string")
    pages = read(spark, d, "pages").select("page_id", U.domain(F.col("url")).alias("host"))
    return U.longest_route(pages, routes, "host", "page_id")


@query("set3_seen_set", f"SELECT min(page_id) AS page_id, {NORMAL} AS canonical FROM pages GROUP BY 2")
def set3(spark, d):
    return read(spark, d, "pages").groupBy(U.normalize(F.col("url")).alias("canonical")).agg(F.min("page_id").alias("page_id"))


# Text -------------------------------------------------------------------------------------------------------


@query("str1_clean", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def str1(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("digest"))


@query("str3_fold", "SELECT doc_id, md5(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')) AS digest FROM documents")
def str3(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("digest"))


@query("str4_tokenisers", f"SELECT doc_id, CAST(len(regexp_extract_all({LOW}, '[a-z0-9]+')) AS BIGINT) AS ascii_tokens, CAST(len({WORDS}) AS BIGINT) AS words, CAST(len(list_filter({WORDS}, lambda w: octet_length(encode(w)) > 2)) AS BIGINT) AS long_words, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS spaced FROM documents")
def str4(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", *[F.size(f(t)).cast("long").alias(n) for n, f in (("ascii_tokens", T.ascii_tokens), ("words", T.words), ("long_words", T.long_words), ("spaced", T.spaced))])


@query("str10_truncate", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(substring(text, 1, 200), '\\s+\\S*\\z', '') || '…' END AS label FROM documents")
def str10(spark, d):
    return read(spark, d, "documents").select("doc_id", T.cut_at_space(F.col("text"), 200).alias("label"))


@query("bd2_token_estimate", f"SELECT doc_id, {ESTIMATE.format(x='text')} AS tokens FROM documents")
def bd2(spark, d):
    return read(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("bd6_budget_share", "SELECT source, count(*) AS pages, CAST(least(2000, greatest(floor(100000 / count(*)), 150)) AS BIGINT) AS share FROM documents GROUP BY source")
def bd6(spark, d):
    n = F.count(F.lit(1))
    return read(spark, d, "documents").groupBy("source").agg(n.alias("pages"), F.least(F.lit(2000), F.greatest(F.floor(100000 / n), F.lit(150))).cast("long").alias("share"))


@query("jsn1_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn1(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("jsn2_json_valid", "SELECT event_id, json_valid(substring(props, 1, length(props) - event_id % 2)) AS valid FROM events")
def jsn2(spark, d):
    cut = F.expr("substring(props, 1, length(props) - cast(event_id % 2 as int))")
    return read(spark, d, "events").select("event_id", F.try_parse_json(cut).isNotNull().alias("valid"))


# Quality ----------------------------------------------------------------------------------------------------

@query("q1_integrity", f"""
WITH a AS (SELECT doc_id, trim(text) AS body, trim(text) AS head FROM documents),
b AS (SELECT *, list_filter(regexp_split_to_array(head, '\\s+'), lambda w: w <> '') AS ws, list_filter(regexp_split_to_array(body, '\\s+'), lambda w: w <> '') AS allw FROM a),
c AS (SELECT *, len(ws) AS n, length(array_to_string(ws, '')) AS letters FROM b),
g AS (SELECT doc_id, max(k) AS best FROM (SELECT doc_id, p, count(*) AS k FROM (SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS p FROM c) x GROUP BY 1, 2) y GROUP BY 1),
r AS (SELECT c.doc_id,
 (len(allw) < 50 AND length(body) < 300) AS thin,
 n > 0 AND (NOT (letters / greatest(n, 1) BETWEEN 3.0 AND 10.0) OR len(list_filter(ws, lambda w: regexp_matches(w, '\\p{{L}}'))) / greatest(n, 1) < 0.8
  OR ((length(head) - length(regexp_replace(head, '[#…]', '', 'g'))) + (length(head) - length(regexp_replace(head, '\\.\\.\\.', '', 'g'))) / 3) / greatest(n, 1) > 0.1) AS odd,
 n >= 100 AND coalesce(best, 0) * 2.0 / greatest(n, 1) > 0.2 AS rep,
 (suffix(body, '…') OR suffix(body, '...')) AS cut FROM c LEFT JOIN g ON g.doc_id = c.doc_id)
SELECT doc_id, CASE WHEN cut THEN 'partial' WHEN NOT thin AND NOT odd AND NOT rep THEN 'full' ELSE 'thin' END AS verdict,
 array_to_string(list_filter([CASE WHEN thin THEN 'thin_text' END, CASE WHEN odd THEN 'not_prose' END, CASE WHEN rep THEN 'repetitive' END, CASE WHEN cut THEN 'truncated' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def q1(spark, d):
    out = quality.assess(read(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "verdict", F.array_join("reasons", ",").alias("reasons"))


@query("ag9_percentiles", """
WITH b AS (SELECT event_type, CAST(least(floor(least(greatest(value / 400, 0), 1) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS total, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
SELECT event_type, bin, n, total::bigint AS total, CASE WHEN total >= 30 THEN round((below + n / 2) / total, 6) END AS percentile, CASE WHEN total < 30 THEN 'refused' WHEN total < 200 THEN 'wide' ELSE 'narrow' END AS band FROM c""")
def ag9(spark, d):
    return quality.percentile_bands(read(spark, d, "events").withColumn("value", F.col("value") / 400), "event_type", "value")


@query("cl1_page_kind", "SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'not_found' WHEN doc_id % 50 = 1 THEN 'rate_limited' WHEN length(trim(text)) = 0 THEN 'empty' ELSE 'none' END AS kind FROM documents")
def cl1(spark, d):
    status = F.when(F.col("doc_id") % 50 == 0, 404).when(F.col("doc_id") % 50 == 1, 429).otherwise(200)
    return read(spark, d, "documents").select("doc_id", quality.page_kind(status, F.col("text")).alias("kind"))


# Duplicates -------------------------------------------------------------------------------------------------


def simhash_sql(table: str, keys: str, text: str = "text") -> str:
    """(keys, simhash) of a table in DuckDB; a row's words make runs of three, hashed and voted bit by bit."""
    low = LOW.replace("text", text)
    return f"""
WITH w AS (SELECT {keys}, list_filter(regexp_split_to_array({low}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM {table}),
s AS (SELECT {keys}, unnest(list_transform(range(1, len(ws) - least(3, len(ws)) + 2), lambda i: array_to_string(ws[i : i + least(3, len(ws)) - 1], ' '))) AS g FROM w WHERE len(ws) > 0),
h AS (SELECT g, {FNV.format(x="g")} AS h FROM (SELECT DISTINCT g FROM s) x),
v AS (SELECT {keys}, b, sum(CASE WHEN (h::hugeint >> b) & 1::hugeint = 1 THEN 1 ELSE -1 END) AS votes FROM s JOIN h USING (g), (SELECT unnest(range(0, 64))::integer AS b) bits GROUP BY ALL),
r AS (SELECT {keys}, sum(CASE WHEN votes > 0 THEN (1::hugeint << b) ELSE 0::hugeint END)::uhugeint AS x FROM v GROUP BY {keys})
SELECT {", ".join("d." + k.strip() for k in keys.split(","))}, coalesce({SIGNED.format(x="r.x")}, 0) AS simhash FROM {table} d LEFT JOIN r USING ({keys})"""


_PAIRS = f"""p AS ({simhash_sql("documents", "doc_id")}),
one AS (SELECT simhash AS h, min(doc_id) AS k FROM p WHERE simhash <> 0 GROUP BY simhash),
pairs AS (SELECT a.k AS left_id, b.k AS right_id, bit_count(xor(a.h, b.h))::integer AS distance FROM one a JOIN one b ON a.k < b.k AND bit_count(xor(a.h, b.h)) <= 3
 UNION ALL SELECT one.k, p.doc_id, 0 FROM p JOIN one ON one.h = p.simhash WHERE p.doc_id <> one.k)"""


@query("dup1_simhash", simhash_sql("documents", "doc_id"))
def dup1(spark, d):
    return read(spark, d, "documents").select("doc_id", H.simhash64("text").alias("simhash"))


def prints(spark, d) -> DataFrame:
    return written(read(spark, d, "documents").select(F.col("doc_id").alias("id"), H.simhash64("text").alias("simhash")), "simhash")


@query("dup3_near_pairs", f"WITH {_PAIRS} SELECT * FROM pairs")
def dup3(spark, d):
    return dedup.near_pairs(prints(spark, d))


@query("dup5_group_labels", f"""WITH RECURSIVE {_PAIRS},
o AS (SELECT h, k, row_number() OVER (ORDER BY k) AS rn FROM one),
f AS (SELECT 0::bigint AS rn, []::bigint[] AS led, NULL::bigint AS k, NULL::bigint AS boss UNION ALL
 SELECT o.rn, CASE WHEN b.boss IS NULL THEN list_append(f.led, o.k) ELSE f.led END, o.k, b.boss FROM f JOIN o ON o.rn = f.rn + 1
 LEFT JOIN LATERAL (SELECT min(n.left_id) AS boss FROM pairs n WHERE n.right_id = o.k AND n.distance > 0 AND list_contains(f.led, n.left_id)) b ON true)
SELECT p.doc_id AS id, CASE WHEN p.doc_id <> one.k THEN coalesce(f.boss, one.k) ELSE f.boss END AS duplicate_of FROM p LEFT JOIN one ON one.h = p.simhash LEFT JOIN f ON f.k = one.k""")
def dup5(spark, d):
    p = prints(spark, d)
    return dedup.leaders(p, dedup.near_pairs(p))


_BLOCKS = "SELECT DISTINCT source, doc_id, block FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS block FROM documents) x WHERE octet_length(encode(block)) >= {n}"


@query("ag8_block_pages", f"SELECT source, md5(block) AS block, count(*) AS pages FROM ({_BLOCKS.format(n=40)}) b GROUP BY source, block HAVING count(*) > 1")
def ag8(spark, d):
    b = dedup.blocks(read(spark, d, "documents"), "doc_id", "source", "text", 40)
    return b.groupBy("source", "block").agg(F.count(F.lit(1)).alias("pages")).filter("pages > 1").select("source", F.md5("block").alias("block"), "pages")


@query("dup6_boilerplate", f"SELECT b.source, block, count(*) AS on_pages, max(p.pages) AS pages FROM ({_BLOCKS.format(n=40)}) b JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source HAVING count(*) >= 5) p ON p.source = b.source GROUP BY b.source, block HAVING count(*) >= ceil(max(p.pages) * 0.05)")
def dup6(spark, d):
    return dedup.boilerplate(read(spark, d, "documents"), share=0.05)


@query("dup7_template_strip")
def dup7(spark, d):
    docs = read(spark, d, "documents")
    return dedup.strip_template(docs, dedup.boilerplate(docs, min_pages=5, least_bytes=40, share=0.05))


@query("chg1_change_status", f"""WITH s AS ({simhash_sql("conversations", "conv_id, turn")}),
t AS (SELECT c.conv_id, c.turn, md5(c.text) AS h, s.simhash, lag(md5(c.text)) OVER w AS prev, lag(s.simhash) OVER w AS old, row_number() OVER w AS rn FROM conversations c JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn WINDOW w AS (PARTITION BY c.conv_id ORDER BY c.turn))
SELECT conv_id, turn, CASE WHEN rn = 1 THEN 'new' WHEN prev = h THEN 'unchanged' ELSE 'changed' END AS change, CASE WHEN rn > 1 AND prev <> h THEN 1 - bit_count(xor(simhash, old)) / 64.0::double END AS similarity FROM t""")
def chg1(spark, d):
    v = read(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("h"), H.simhash64("text").alias("simhash"))
    return dedup.changes(v, "conv_id", "turn", "h", "simhash").select("conv_id", "turn", "change", "similarity")


@query("chg4_incremental_plan", "SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'new' WHEN d.n_chars % 7 = 0 THEN 'undated' WHEN d.n_chars > 1000 * l.quality + 500 THEN 'changed' ELSE 'unchanged' END AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def chg4(spark, d):
    listed = read(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") % 7 != 0, F.col("n_chars")).alias("modified"))
    known = read(spark, d, "labels").select("doc_id", (1000 * F.col("quality") + 500).alias("fetched"))
    return dedup.plan(listed, known, "doc_id", "modified", "fetched")


@query("set1_block_diff", "SELECT conv_id, turn, CAST(len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS BIGINT) AS added, CAST(len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) AS BIGINT) AS removed FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS a, lag(string_split(text, chr(10))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) t WHERE b IS NOT NULL")
def set1(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    v = read(spark, d, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("a")).withColumn("b", F.lag("a").over(w)).filter("b is not null")
    return v.select("conv_id", "turn", F.size(F.array_except("a", "b")).cast("long").alias("added"), F.size(F.array_except("b", "a")).cast("long").alias("removed"))


# Retrieval --------------------------------------------------------------------------------------------------

TERMS = ["the", "thion", "under", "idiot", "que", "und"]
_T = "(VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") q(term)"
BM25 = f"""WITH t AS (SELECT doc_id, lang, regexp_extract_all({LOW}, '[a-z0-9]+') AS toks FROM documents),
s AS (SELECT lang, count(*) AS n, greatest(avg(len(toks)), 1) AS avgdl FROM t GROUP BY lang),
f AS (SELECT doc_id, lang, len(toks) AS dl, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM t, {_T}),
df AS (SELECT lang, term, count(*) AS df FROM f WHERE tf > 0 GROUP BY 1, 2),
sc AS (SELECT f.lang, f.doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM f JOIN df ON df.lang = f.lang AND df.term = f.term JOIN s ON s.lang = f.lang WHERE tf > 0 GROUP BY 1, 2)"""


@query("rk1_bm25_top20", BM25 + " SELECT lang, doc_id, round(score, 6) AS score, rank FROM (SELECT lang, doc_id, score, row_number() OVER (PARTITION BY lang ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc) r WHERE rank <= 20")
def rk1(spark, d):
    s = retrieval.bm25(read(spark, d, "documents"), TERMS, group="lang").withColumn("score", F.round("score", 6))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id")
    return s.withColumn("rank", F.row_number().over(w)).filter("rank <= 20").select("lang", "doc_id", "score", "rank")


@query("rk3_rrf", BM25 + """, l AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc UNION ALL SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) FROM documents)
 SELECT lang, doc_id, round(sum(1.0::double / (60 + rank)), 9) AS score, count(*) AS lists FROM l WHERE rank <= 50 GROUP BY lang, doc_id""")
def rk3(spark, d):
    docs = read(spark, d, "documents")
    a = retrieval.bm25(docs, TERMS, group="lang").select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(F.round("score", 6)), "doc_id")).alias("rank"))
    b = docs.select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    a, b = a.filter("rank <= 50"), b.filter("rank <= 50")  # under the union, so that each task keeps its own 50
    return retrieval.fuse(a.unionByName(b), "lang", "doc_id", "rank").withColumn("score", F.round("score", 9))


@query("ag7_document_frequency", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all({LOW}, '[a-z0-9]+')) AS term FROM documents) t GROUP BY term HAVING count(*) >= 5")
def ag7(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.ascii_tokens(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df >= 5")


@query("mth2_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS cosine FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def mth2(spark, d):
    e = read(spark, d, "embeddings")
    one = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))  # one row


@query("rk8_vector_topk", "SELECT query, key, rank FROM (SELECT a.vec_id AS query, b.vec_id AS key, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) t WHERE rank <= 10")
def rk8(spark, d):
    e = read(spark, d, "embeddings")
    return retrieval.vector_topk(e.filter("vec_id % 20 = 0"), e, 10).select("query", "key", "rank")


@query("tk7_mmr")
def tk7(spark, d):
    e = read(spark, d, "embeddings")
    top = retrieval.vector_topk(e.filter("vec_id % 20 = 0"), e, 20).join(e.select(F.col("vec_id").alias("key"), "embedding"), "key")
    return retrieval.mmr(top, "query", "rank", "key", "embedding")


@query("rk9_frontier_score", f"SELECT page_id, round(1.2 * (page_id % 10) / 10.0 + 0.6 * 0.6 + 0.4 * (page_id % 7) / 7.0 - 0.25 * (page_id % 3) - 0.08 * len(list_filter(string_split({PATH}, '/'), lambda x: x <> '')) + 0.4 * exp(-(page_id % 365) / 90.0), 6) AS score FROM pages")
def rk9(spark, d):
    i = F.col("page_id")
    seg = F.size(F.filter(F.split(U.path(F.col("url")), "/"), lambda x: x != ""))
    s = retrieval.frontier_score((i % 10) / 10.0, F.lit("sitemap"), (i % 7) / 7.0, i % 3, seg, i % 365)
    return read(spark, d, "pages").select("page_id", F.round(s, 6).alias("score"))


# Ordered folds ----------------------------------------------------------------------------------------------


@query("mth6_ewma", "WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r AS (SELECT user_id, rn, value AS s FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, 0.7 * r.s + 0.3 * e.value FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) SELECT user_id, round(arg_max(s, rn), 6) AS ewma FROM r GROUP BY user_id")
def mth6(spark, d):
    return ledgers.ewma(read(spark, d, "events"), "user_id", ["ts", "event_id"], "value").withColumn("ewma", F.round("ewma", 6))


@query("ag19_session_health", """WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CASE WHEN event_type = 'error' THEN -35 WHEN event_type = 'view' THEN -10 ELSE 3 END AS delta, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS rn FROM events),
r AS (SELECT user_id, rn, s, least(100.0, greatest(0.0, 100.0 + delta))::double AS h FROM e WHERE rn = 1 UNION ALL
 SELECT e.user_id, e.rn, e.s, least(100.0, greatest(0.0, least(100.0, h + floor((e.s - r.s) / 600.0)) + delta))::double FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, round(arg_max(h, rn), 6) AS health, arg_max(h, rn) >= 40 AS usable FROM r GROUP BY user_id""")
def ag19(spark, d):
    """100 at the start; +3 a success, -10 a limit (here a view), -35 a block (an error), +1 for each idle ten minutes."""
    e = read(spark, d, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    delta = F.when(F.col("event_type") == "error", -35).when(F.col("event_type") == "view", -10).otherwise(3)
    out = ledgers.session_health(e, "user_id", "s", "event_id", delta)
    return out.select("user_id", F.round("health", 6).alias("health"), (F.col("health") >= 40).alias("usable"))


@query("cr3_saturation")
def cr3(spark, d):
    """Per source the first page from which the trailing mean of new words is below a floor."""
    words = read(spark, d, "documents").select("source", "doc_id", F.explode(F.array_distinct(T.long_words(F.col("text")))).alias("w"))
    first = words.groupBy("source", "w").agg(F.min("doc_id").alias("doc_id"))
    new = first.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("new"))
    size = words.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy("doc_id")
    nov = size.join(new, ["source", "doc_id"], "left").withColumn("novelty", F.avg(F.coalesce("new", F.lit(0)) / F.col("n")).over(w.rowsBetween(-4, 0))).withColumn("seq", F.row_number().over(w))
    return nov.groupBy("source").agg(F.min(F.when((F.col("seq") >= 5) & (F.col("novelty") < 0.35), F.col("doc_id"))).alias("saturated_at"))
