"""Queries over tables and blocks of pages, links, captions, boxes, sessions and search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions import paths as P
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import blocks, intervals, ledgers, quality, retrieval
from tidemark.plans.content import DOMAIN, PATH, read, simhash_sql
from tidemark.plans.more import _E, events
from tidemark.sources import html, manifests

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Tables and blocks ------------------------------------------------------------------------------------------


def order_pages(spark, d):
    """Each order as a page: a table of its lines, the order's id spanning all rows, amounts under a spanning header, an
    empty column, and a list of links in a layout table around it."""
    line = F.concat(F.lit("<td>"), F.col("l_linenumber"), F.lit("</td><td>"), F.col("l_linestatus"), F.lit("</td><td>"), F.col("l_returnflag"), F.lit("</td><td> </td></tr>"))
    head = '<table role="presentation"><tr><td><a href="/a">a</a></td><td><a href="/b">b</a></td></tr></table><table><caption>Lines</caption><thead><tr><th>order</th><th>no</th><th colspan="2">ship</th><th>note</th></tr></thead><tbody>'
    # dealt by number, so that the parse is not coalesced into few tasks; the grouping needs no further shuffle
    dealt = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag").repartition(spark.sparkContext.defaultParallelism, "l_orderkey")
    rows = dealt.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    opened = F.transform("lines", lambda h, i: F.concat(F.when(i == 0, '<tr><td rowspan="64">@</td>').otherwise("<tr>"), h))
    rows = rows.select("l_orderkey", F.array_join(opened, "").alias("rows"))
    page = F.concat(F.lit(head), F.replace("rows", F.lit("@"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))), F.lit("</tbody></table>"))
    return html.parse_pages(rows.select("l_orderkey", F.lit("http://shop.test/").alias("url"), page.alias("html")), "l_orderkey", only_tables=True)


_LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber::varchar || '<' || l_linestatus || l_returnflag) AS n FROM lineitem)"


@query("hx13_spanned_tables", f"SELECT l_orderkey AS id, 1::integer AS \"table\", n AS row, ['o' || l_orderkey, l_linenumber::varchar, l_linestatus, l_returnflag] AS cells FROM {_LINES} l UNION ALL SELECT DISTINCT l_orderkey, 1, 0, ['order', 'no', 'ship', 'ship'] FROM lineitem")
def hx13_spanned(spark, d):
    return html.table_rows(order_pages(spark, d))


@query("hx14_table_records", f"SELECT l_orderkey AS id, n AS row, 'o' || l_orderkey || '/' || l_linenumber || '/' || l_returnflag AS record FROM {_LINES} l")
def hx14_records(spark, d):
    r = F.col("record")
    return html.table_records(order_pages(spark, d)).select("id", "row", F.concat_ws("/", r["order"], r["no"], r["ship"]).alias("record"))


@query("hx14_table_markdown", f"SELECT l_orderkey AS id, '**Lines**' || repeat(chr(10), 2) || '| order | no | ship | ship |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| o' || l_orderkey || ' | ' || l_linenumber || ' | ' || l_linestatus || ' | ' || l_returnflag || ' |', chr(10) ORDER BY n) AS markdown FROM {_LINES} l GROUP BY l_orderkey")
def hx14_markdown(spark, d):
    return html.table_markdown(order_pages(spark, d)).select("id", "markdown")


_LINKED = "CAST(length(line) % 10 AS DOUBLE) / 10"


@query("hx8_content_blocks", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
w AS (SELECT doc_id, pos, {_LINKED} AS linked, len(regexp_extract_all(line, '\\S+')) AS words FROM l),
n AS (SELECT *, row_number() OVER o AS place, lag(words, 1, 0) OVER o AS before, lag(linked, 1, 0.0) OVER o AS was, lead(words, 1, 0) OVER o AS after FROM w WHERE words > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, place::integer - 1 AS place, linked <= 0.333333 AND CASE WHEN was <= 0.555556 THEN words > 16 OR after > 15 OR before > 4 ELSE words > 40 OR after > 17 END AS content FROM n""")
def hx8(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), (F.length(x) % 10 / 10).alias("linked")))
    judged = blocks.judged_blocks(read(spark, d, "documents").select("doc_id", lines.alias("b")), "doc_id", "b")
    # outer, so that no filter on the blocks' number is inferred: it would be moved below them and judge them anew for each
    each = judged.select("doc_id", F.posexplode_outer("blocks").alias("place", "x")).filter("place is not null")
    return each.select("doc_id", "place", F.col("x.content").alias("content"))


@query("hx9_main_text")
def hx9(spark, d):
    parsed = html.parse_pages(read(spark, d, "pages")).select(F.col("id").alias("page_id"), F.col("parts.blocks").alias("b"))
    return blocks.main_text(parsed, "page_id", "b")


@query("ag14_tree_totals", f"""WITH p AS (SELECT {DOMAIN} AS site, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS parts, length(html) AS size FROM pages),
n AS (SELECT site, '/' || array_to_string(parts[1:k], '/') AS node, size FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS k FROM p) x)
SELECT site, node, count(*) AS pages, CAST(sum(size) AS BIGINT) AS size FROM n GROUP BY 1, 2""")
def ag14(spark, d):
    p = read(spark, d, "pages").select(U.domain(F.col("url")).alias("site"), F.explode(U.path_prefixes(U.path(F.col("url")))).alias("node"), F.length("html").alias("size"))
    return p.groupBy("site", "node").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("size"))


# Links and headers ------------------------------------------------------------------------------------------


def tagged_links(spark, d):
    """Page URLs with referral and engine marks by turns."""
    k = F.col("page_id") % 6
    u = F.when(k == 0, F.concat(F.col("url"), F.lit("?AFF_ID=7"))).when(k == 1, F.concat(F.lit("https://www.amazon.test/x?tag="), F.col("page_id"))).when(k == 2, F.concat(F.col("url"), F.lit("?tag=x")))
    u = u.when(k == 3, "https://www.awin1.com/cread.php").when(k == 4, F.concat(F.lit("https://www.bing.com/aclick?u="), F.col("url"))).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", u.alias("link"))


@query("url8_affiliate", "SELECT page_id, page_id % 6 IN (0, 1, 3) AS affiliate FROM pages")
def url8(spark, d):
    return tagged_links(spark, d).select("page_id", U.is_affiliate(F.col("link")).alias("affiliate"))


@query("url7_ad_links", "SELECT page_id, page_id % 6 = 4 AS ad FROM pages")
def url7(spark, d):
    return tagged_links(spark, d).select("page_id", U.is_ad(F.col("link")).alias("ad"))


@query("url13_block_patterns", f"""WITH s AS (SELECT DISTINCT {DOMAIN} AS domain FROM pages), t AS (SELECT domain FROM s WHERE domain <> '' ORDER BY length(domain) - length(replace(domain, '.', '')), length(domain), domain LIMIT 50)
SELECT domain, 0::integer AS place, '*://' || domain || '/*' AS pattern FROM t UNION ALL SELECT domain, 1, '*://*.' || domain || '/*' FROM t""")
def url13(spark, d):
    return U.block_patterns(read(spark, d, "pages").select(U.domain(F.col("url")).alias("domain")).filter("domain <> ''"), "domain", 50)


@query("src21_alt_svc", "SELECT page_id, CASE WHEN page_id % 4 < 3 THEN CASE page_id % 4 WHEN 0 THEN 443 WHEN 1 THEN 8000 + page_id % 100 ELSE 443 END END::integer AS port, CASE page_id % 4 WHEN 0 THEN page_id WHEN 1 THEN 86400 WHEN 2 THEN 60 END::bigint AS max_age FROM pages")
def src21(spark, d):
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    header = F.when(k == 0, F.concat(F.lit('h2="x.test:80"; ma=5, h3=":443"; ma='), n, F.lit("; persist=1"))).when(k == 1, F.concat(F.lit('h3-29=":'), (8000 + F.col("page_id") % 100).cast("string"), F.lit('"')))
    svc = U.alt_svc(header.when(k == 2, 'H3="alt.test:443";ma=60').otherwise("clear"))
    return read(spark, d, "pages").select("page_id", svc["port"].alias("port"), svc["max_age"].alias("max_age"))


# Verdicts ---------------------------------------------------------------------------------------------------

_STATUS = "CASE doc_id % 8 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 503 ELSE 200 END"


@query("cl2_response_verdict", f"""SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'blocked' WHEN s = 403 THEN 'blocked' WHEN s IN (429, 503) THEN 'rate_limited' WHEN n_chars < 200 THEN 'blocked' WHEN doc_id % 8 = 3 THEN 'blocked' WHEN doc_id % 8 = 4 AND n_chars * 10 > 8 * 700 AND n_chars * 10 > 5000 THEN 'rate_limited' ELSE 'ok' END AS verdict
FROM (SELECT doc_id, length(text) AS n_chars, {_STATUS} AS s FROM documents) x""")
def cl2(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.length("text").alias("n"), F.expr(_STATUS).alias("s"))
    k = F.col("doc_id") % 8
    verdict = quality.response_verdict(F.col("s"), F.col("n"), F.lit("/blog/post"), F.when(k == 3, "/").otherwise("/blog/post"), F.col("doc_id") % 50 == 0, F.when(k == 4, F.col("n") * 10).otherwise(0), F.lit(700))
    return docs.select("doc_id", verdict.alias("verdict"))


@query("q3_optimisation", """WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n, len(regexp_extract_all(text, '[0-9]')) AS a, len(string_split(text, chr(10))) AS h, doc_id % 7 AS f, doc_id % 2 = 0 AS e FROM documents)
SELECT doc_id, CASE WHEN len(t) >= 2 THEN 'high' ELSE 'ordinary' END AS level, array_to_string(t, ',') AS traits FROM (SELECT doc_id, list_filter([CASE WHEN n >= 200 AND f >= 3 AND f * 1000.0 / greatest(n, 1) > 5 THEN 'affiliate_heavy' END, CASE WHEN h >= 3 AND e THEN 'headings_echo_the_body' END, CASE WHEN n >= 200 AND a * 100.0 / greatest(n, 1) > 4 THEN 'link_dense' END], lambda x: x IS NOT NULL) AS t FROM c) x""")
def q3(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\S+")).alias("n"), F.regexp_count("text", F.lit("[0-9]")).alias("a"), F.size(F.split("text", "\n")).alias("h"))
    level = quality.optimisation(F.col("a"), F.col("doc_id") % 7, F.col("h"), F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.5), F.col("n"))
    return docs.select("doc_id", level.alias("x")).select("doc_id", "x.level", F.array_join("x.traits", ",").alias("traits"))


@query("q6_soft_404", f"""WITH s AS ({simhash_sql("documents", "doc_id")}), p AS (SELECT s.doc_id, s.simhash, d.source FROM s JOIN documents d ON d.doc_id = s.doc_id), e AS (SELECT source, arg_min(simhash, doc_id) AS probe FROM p GROUP BY source)
SELECT p.doc_id FROM p JOIN e ON e.source = p.source WHERE 1 - bit_count(xor(p.simhash, e.probe)) / 64.0::double >= 0.9""")
def q6(spark, d):
    p = read(spark, d, "documents").select("doc_id", "source", H.simhash64("text").alias("simhash"))
    probes = read(spark, d, "documents").groupBy("source").agg(F.min_by("text", "doc_id").alias("t")).select("source", H.simhash64("t").alias("probe"))
    return p.join(probes, "source").filter(H.similarity(F.col("simhash"), F.col("probe")) >= 0.9).select("doc_id")


# Captions, boxes, growth ------------------------------------------------------------------------------------


@query("wn10_passages", f"""WITH RECURSIVE c AS (SELECT user_id, s // 86400 AS day, s, event_id, row_number() OVER (PARTITION BY user_id, s // 86400 ORDER BY s, event_id) AS rn FROM {_E} e),
r AS (SELECT user_id, day, rn, s AS a, s FROM c WHERE rn = 1 UNION ALL SELECT c.user_id, c.day, c.rn, CASE WHEN c.s - r.a >= 7200 THEN c.s ELSE r.a END, c.s FROM r JOIN c ON c.user_id = r.user_id AND c.day = r.day AND c.rn = r.rn + 1)
SELECT user_id, day, a AS s, max(s) + 60 AS e, count(*)::integer AS n FROM r GROUP BY user_id, day, a""")
def wn10(spark, d):
    cues = events(spark, d).select("user_id", F.floor(F.col("s") / 86400).alias("day"), "s", (F.col("s") + 60).alias("e"), "event_id", "event_type")
    return intervals.passages(cues, ["user_id", "day"], "s", "e", "event_type", "event_id", 7200).select("user_id", "day", "s", "e", "n")


_ROLLED = "SELECT doc_id, pos, CASE WHEN pos = 1 THEN line ELSE lag(line) OVER w || chr(10) || line END AS cue FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"


@query("wn11_fresh_captions", f"""WITH c AS ({_ROLLED}), p AS (SELECT *, string_split(cue, chr(10)) AS now, coalesce(lag(string_split(cue, chr(10))) OVER (PARTITION BY doc_id ORDER BY pos), []) AS was FROM c),
f AS (SELECT doc_id, pos, now[1 + CASE WHEN len(was) >= 2 AND was[-2:] = now[1:2] AND len(now) = 2 THEN 2 WHEN len(was) >= 1 AND was[-1] = now[1] THEN 1 ELSE 0 END:] AS fresh FROM p)
SELECT doc_id, pos - 1 AS pos, md5(array_to_string(fresh, chr(10))) AS digest FROM f WHERE array_to_string(fresh, chr(10)) <> ''""")
def wn11(spark, d):
    lines = F.split("text", "\n")
    rolled = F.transform(lines, lambda x, i: F.when(i == 0, x).otherwise(F.concat_ws("\n", F.get(lines, i - 1), x)))
    cues = read(spark, d, "documents").select("doc_id", F.posexplode(rolled).alias("pos", "cue"))
    return intervals.fresh_lines(cues, "doc_id", "pos", "cue").select("doc_id", "pos", F.md5("cue").alias("digest"))


_BOX = "vec_id // 40 AS pic, vec_id AS id, CAST(vec_id * 7 % 20 AS DOUBLE) AS x1, CAST(vec_id * 3 % 16 AS DOUBLE) AS y1, CAST(vec_id * 7 % 20 + 4 + vec_id % 5 AS DOUBLE) AS x2, CAST(vec_id * 3 % 16 + 5 + vec_id % 3 AS DOUBLE) AS y2, vec_id * 11 % 13 AS score"


@query("tk9_strongest_boxes", f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY pic ORDER BY score DESC, x1 + x2, y1 + y2, id) AS rn FROM (SELECT {_BOX} FROM embeddings) x),
r AS (SELECT pic, 0::bigint AS rn, []::bigint[] AS took FROM b GROUP BY pic UNION ALL
 SELECT r.pic, b.rn, CASE WHEN EXISTS (SELECT 1 FROM b t WHERE t.pic = b.pic AND list_contains(r.took, t.rn) AND greatest(0, least(t.x2, b.x2) - greatest(t.x1, b.x1)) * greatest(0, least(t.y2, b.y2) - greatest(t.y1, b.y1)) / ((t.x2 - t.x1) * (t.y2 - t.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(t.x2, b.x2) - greatest(t.x1, b.x1)) * greatest(0, least(t.y2, b.y2) - greatest(t.y1, b.y1))) > 0.3) THEN r.took ELSE list_append(r.took, b.rn) END
 FROM r JOIN b ON b.pic = r.pic AND b.rn = r.rn + 1)
SELECT b.pic, b.id FROM (SELECT pic, arg_max(took, rn) AS took FROM r GROUP BY pic) k JOIN b ON b.pic = k.pic AND list_contains(k.took, b.rn)""")
def tk9(spark, d):
    b = read(spark, d, "embeddings").selectExpr("vec_id div 40 as pic", "vec_id * 11 % 13 as score", "struct(vec_id as id, cast(vec_id * 7 % 20 as double) as x1, cast(vec_id * 3 % 16 as double) as y1, cast(vec_id * 7 % 20 + 4 + vec_id % 5 as double) as x2, cast(vec_id * 3 % 16 + 5 + vec_id % 3 as double) as y2) as box")
    return intervals.strongest_boxes(b, "pic", "box", "score", 0.3).select("pic", "box.id")


@query("cr10_growth", """WITH RECURSIVE o AS (SELECT user_id, row_number() OVER w AS rn, value * 100 > coalesce(max(value * 100) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grew FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT DISTINCT user_id, 0::bigint AS n, 0 AS q, FALSE AS tried, FALSE AS stop FROM events UNION ALL
 SELECT user_id, n, CASE WHEN n < 40 AND q >= 2 AND NOT tried THEN 0 ELSE q END, tried OR (n < 40 AND q >= 2), n >= 40 OR (n < 40 AND q >= 2 AND tried) FROM (SELECT r.user_id, r.n + 1 AS n, CASE WHEN o.grew THEN 0 ELSE r.q + 1 END AS q, r.tried FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.n + 1 WHERE NOT r.stop) x)
SELECT user_id, max(CASE WHEN stop THEN n END)::integer AS rounds, bool_or(tried) AS tried FROM r GROUP BY user_id""")
def cr10(spark, d):
    e = read(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("o"), (F.col("value") * 100).alias("height"), F.lit(0).alias("n"))
    return ledgers.growth(e, "user_id", "o", "height", "n")


# Search -----------------------------------------------------------------------------------------------------


@query("str6_shorten", """WITH q AS (SELECT doc_id, regexp_extract_all(text, '[a-z]+') AS w FROM documents),
s AS (SELECT doc_id, w[1:7] AS w, CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(34) || array_to_string(w[8:9], ' ') || chr(34) END AS phrase FROM q WHERE len(w) >= 9),
c AS (SELECT doc_id, phrase, list_filter(w, lambda x: x NOT IN ('er', 'en', 'de')) AS c FROM s),
r AS (SELECT doc_id, trim(phrase || ' ' || array_to_string(c[1:CASE WHEN phrase = '' THEN 4 ELSE 2 END], ' ')) AS short FROM c)
SELECT doc_id, CASE WHEN short <> '' THEN short END AS short FROM r""")
def str6(spark, d):
    w = F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1))
    docs = read(spark, d, "documents").select("doc_id", w.alias("w")).filter(F.size("w") >= 9)
    phrase = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit(' "'), F.array_join(F.slice("w", 8, 2), " "), F.lit('"')))
    return docs.select("doc_id", T.shorten(F.concat(F.array_join(F.slice("w", 1, 7), " "), phrase), ["er", "en", "de"]).alias("short"))


_TERMS3 = ["de", "en", "fr"]


@query("rk6_one_word_answer", f"""WITH h AS (SELECT doc_id // 3 AS query, list_filter({_TERMS3}, lambda t: contains(lower(lang), t)) AS h FROM documents),
g AS (SELECT query, count(*) AS n, max(len(h)) AS most, min(CASE WHEN len(h) = 1 THEN h[1] END) AS low, max(CASE WHEN len(h) = 1 THEN h[1] END) AS high, count(CASE WHEN len(h) = 1 THEN 1 END) AS hits FROM h GROUP BY query)
SELECT query, low AS word FROM g WHERE n >= 3 AND most = 1 AND low = high AND hits * 10 >= n * 7""")
def rk6(spark, d):
    docs = read(spark, d, "documents").select(F.expr("doc_id div 3").alias("query"), F.array(*[F.lit(t) for t in _TERMS3]).alias("terms"), "lang")
    return retrieval.one_word_answers(docs, "query", "terms", "lang")


@query("flt5_overdue", f"SELECT user_id, 1706659200 - (s + every) AS overdue_s FROM (SELECT user_id, max(s) AS s, 3600 * (1 + user_id % 24) AS every FROM {_E} e GROUP BY user_id) t WHERE s + every <= 1706659200")
def flt5(spark, d):
    w = events(spark, d).groupBy("user_id").agg(F.max("s").alias("s"))
    return w.select("user_id", (1706659200 - (F.col("s") + 3600 * (1 + F.col("user_id") % 24))).alias("overdue_s")).filter("overdue_s >= 0")


# JSON and manifests -----------------------------------------------------------------------------------------


@query("jsn1_json_select", """SELECT event_id, printf('[%d,%d,null]', k, event_id) AS keys, printf('%d', event_id) AS "last", CASE WHEN event_id % 2 = 0 THEN printf('[%d]', k) END AS part, printf('{"items[0].k":%d,"n.x":"v"}', k) AS pick, '["v",[1]]' AS "values"
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) e""")
def jsn1_select(spark, d):
    name = F.when(F.col("event_id") % 2 == 0, "items").otherwise("other")
    doc = F.format_string('{"items":[%s,{"k":%d},{"z":[]}],"n":{"x":"v","y":[1]},"%s":[%s,2]}', F.col("props"), F.col("event_id"), F.lit("rows"), F.col("props"))
    tasks = 2 * spark.sparkContext.defaultParallelism  # a row group would be one task; many tasks would each set up these expressions
    events = read(spark, d, "events").select("event_id", "props").repartition(tasks, "event_id")
    e = events.select("event_id", doc.alias("x"), F.when(name == "items", doc).otherwise("{").alias("y")).withColumn("v", F.try_parse_json("x"))
    v = F.col("v")
    return e.select(
        "event_id", P.variant_project(v, "$.items.k").alias("keys"), P.variant_project(v, "items[-2]['k']").alias("last"), P.json_project(F.col("y"), "$.items[0:1].k").alias("part"),
        P.variant_project(v, "{items[0].k, n.x}").alias("pick"), P.variant_project(v, "$.n.*").alias("values"),
    )


@query("src15_hls_segments", "SELECT conv_id, place::integer AS place, 's' || turn || '.ts' AS uri, (4.5 * place)::double AS start, 4.5::double AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM (SELECT DISTINCT conv_id, turn FROM conversations) c) x")
def src15_segments(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).alias("t"))
    lines = F.transform("t", lambda t: F.concat(F.lit("#EXTINF:4.5,x\r\n#EXT-X-NOTE\r\ns"), t.cast("string"), F.lit(".ts\r\n")))
    body = F.concat(F.lit("#EXTM3U\r\n"), F.array_join(lines, ""), F.lit("#EXT-X-ENDLIST"))
    return manifests.hls_segments(turns.select("conv_id", body.alias("body")), "conv_id", "body")


@query("src15_hls_subtitles", "SELECT doc_id, lang AS language, source || ', all' AS name, doc_id || '.m3u8' AS uri FROM documents")
def src15_subtitles(spark, d):
    media = F.format_string('#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,LANGUAGE="x",URI="a"\n#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="s",LANGUAGE="%s",NAME="%s, all",URI="%d.m3u8"\n', "lang", "source", "doc_id")
    return manifests.hls_subtitles(read(spark, d, "documents").select("doc_id", media.alias("body")), "doc_id", "body")
