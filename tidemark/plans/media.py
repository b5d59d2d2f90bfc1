"""Queries over recordings: moments, DASH manifests, storyboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import addresses
from tidemark.operators import export, moments
from tidemark.plans.content import read
from tidemark.sources import dash

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_FOLD = "lower(strip_accents(text))"
_EMPTY = ", ".join(f"'{w}'" for w in moments.EMPTY_WORDS)


@query("rk7_moments", rf"""WITH c AS (SELECT DISTINCT conv_id, turn, first(text) OVER (PARTITION BY conv_id, turn ORDER BY text) AS text FROM conversations WHERE text IS NOT NULL),
q AS (SELECT conv_id, list_sort(list_distinct(CASE WHEN len(t) > 0 THEN t ELSE a END)) AS ws FROM (SELECT conv_id, a, list_filter(a, lambda w: w NOT IN ({_EMPTY})) AS t
  FROM (SELECT conv_id, list_filter(regexp_extract_all({_FOLD}, '[a-z0-9]+')[-6:], lambda w: length(w) >= 2) AS a FROM (SELECT conv_id, arg_min(regexp_replace(text, '[^\x20-\x7E]', 'e', 'g'), turn) AS text FROM c GROUP BY 1) x) y) z WHERE len(a) > 0),
p AS (SELECT conv_id, turn, text, regexp_extract_all({_FOLD}, '[a-z0-9]+') AS have, regexp_extract_all({_FOLD}, '[^a-z0-9]+') AS gaps, regexp_matches({_FOLD}, '^[a-z0-9]') AS w0 FROM (SELECT conv_id, turn, regexp_replace(text, '[^\x20-\x7E]', 'e', 'g') AS text FROM c) x),
h AS (SELECT *, list_transform(ws, lambda w: list_position(list_transform(have, lambda x: x = w OR length(x) >= 4 AND length(w) >= 4 AND (starts_with(x, w) OR starts_with(w, x))), true)) AS f FROM p JOIN q USING (conv_id)),
s AS (SELECT *, len(list_filter(f, lambda x: x > 0)) / len(ws) AS score, list_min(list_filter(f, lambda x: x > 0)) AS k FROM h),
a AS (SELECT *, (coalesce(list_sum(list_transform(have[1:k - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(gaps[1:CASE WHEN w0 THEN k - 1 ELSE k END], lambda x: length(x))), 0))::BIGINT AS at_ FROM s WHERE score >= 0.5),
e AS (SELECT *, greatest(at_ - 60, 0) AS lo, least(at_ + 140, length(text)) AS hi FROM a)
SELECT conv_id, turn, round(score, 6) AS score, CASE WHEN lo > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, lo + 1, hi - lo), '\s+', ' ', 'g')) || CASE WHEN hi < length(text) THEN '…' ELSE '' END AS snippet FROM e""")
def rk7(spark, d):
    """The last words of a conversation's first turn, looked for in all its turns, in plain letters."""
    turns = read(spark, d, "conversations").filter("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).withColumn("text", F.regexp_replace("text", r"[^\x20-\x7E]", "e"))
    asked = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("t")).select("conv_id", F.regexp_extract_all(F.lower("t"), F.lit("([a-z0-9]+)"), F.lit(1)).alias("w"))
    asked = asked.select("conv_id", F.array_join(F.slice("w", F.greatest(F.size("w") - 5, F.lit(1)), 6), " ").alias("q"))
    return moments.moments(turns, asked, "conv_id", "turn", "text", "q").withColumn("score", F.round("score", 6))


@query("src15_dash_segments", """WITH r AS (SELECT user_id, 1 + count(*) % 7 AS n FROM events GROUP BY 1), k AS (SELECT user_id, n, unnest(range(0, n + 3)) AS i FROM r)
SELECT user_id AS id, i AS place, 'v/' || (i + 5) || '-' || (100 + 40 * least(i, n + 1) + CASE WHEN i > n + 1 THEN 25 ELSE 0 END) || '.m4s' AS uri, (100 + 40 * least(i, n + 1) + CASE WHEN i > n + 1 THEN 25 ELSE 0 END) / 10.0 AS start, CASE WHEN i <= n THEN 4.0 ELSE 2.5 END AS seconds FROM k""")
def src15_dash(spark, d):
    """A manifest a user: a run of equal segments by repeat count, then two of another length."""
    n = read(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg((1 + F.count(F.lit(1)) % 7).alias("n"))
    xml = F.concat(
        F.lit('<MPD xmlns="urn:mpeg:dash:schema:mpd:2011"><Period><AdaptationSet mimeType="video/mp4"><SegmentTemplate timescale="10" startNumber="5" media="v/$Number$-$Time$.m4s"><SegmentTimeline><S t="100" d="40" r="'),
        "n", F.lit('"/><S d="25" r="1"/></SegmentTimeline></SegmentTemplate></AdaptationSet></Period></MPD>'),
    )
    return dash.segments(n.select("id", xml.alias("body")), "id", "body").select("id", "place", "uri", "start", "seconds")


@query("src16_storyboards", """WITH b AS (SELECT l_orderkey AS id, count(*) + 3 AS n, CASE WHEN l_orderkey % 2 = 0 THEN 2.0 ELSE 60.0 / (count(*) + 3) END AS every FROM lineitem GROUP BY 1), f AS (SELECT *, unnest(range(0, n)) AS i FROM b)
SELECT id, i AS place, round(i * every, 6) AS t, 'https://i.test/sb/' || id || '/1/M' || (i // 6) || '.jpg?sigh=s' || id AS sheet, round((i % 6 % 3) / 3.0, 6) AS x, round((i % 6 // 3) / 2.0, 6) AS y FROM f""")
def src16(spark, d):
    n = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg((F.count(F.lit(1)) + 3).alias("n"))
    every = F.when(F.col("id") % 2 == 0, "2000").otherwise("0")
    spec = F.concat(F.lit("https://i.test/sb/"), "id", F.lit("/$L/$N.jpg|48#27#100#10#10#0#default#x|160#90#"), "n", F.lit("#3#2#"), every, F.lit("#M$M#s"), "id")
    frames = dash.storyboard(n.select("id", spec.alias("spec"), F.lit(60.0).alias("seconds")), "id", "spec", "seconds")
    return frames.select("id", "place", F.round("t", 6).alias("t"), "sheet", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# Exports ----------------------------------------------------------------------------------------------------


@query("snk4_ragged_csv", """WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN ['id', 'kind', 'x'] WHEN 'error' THEN ['id', 'note'] WHEN 'purchase' THEN ['id', 'deep', 'kind'] ELSE ['kind', 'two words'] END AS ks,
 [event_id::VARCHAR, CASE WHEN event_type IN ('click', 'purchase') THEN '"' || event_type || ', all"' ELSE event_type END, (event_id % 7)::VARCHAR, CASE WHEN event_id % 2 = 0 THEN '''=SUM(A1)' ELSE '-5' END, '"{""a"":' || event_id || '}"', 'said'] AS vs FROM events),
k AS (SELECT name FROM (SELECT event_id, unnest(ks) AS name, generate_subscripts(ks, 1) AS p FROM r) x GROUP BY name ORDER BY min(event_id * 10 + p)), h AS (SELECT list(name) AS hs FROM k)
SELECT NULL::BIGINT AS event_id, array_to_string(hs, ',') AS line FROM h UNION ALL
SELECT event_id, array_to_string(list_transform(hs, lambda n: CASE WHEN list_contains(ks, n) THEN vs[list_position(['id', 'kind', 'x', 'note', 'deep', 'two words'], n)] ELSE '' END), ',') FROM r, h""")
def snk4(spark, d):
    e = read(spark, d, "events")
    i, t = F.col("event_id"), F.col("event_type")
    named = F.concat(t, F.lit(", all"))
    note = F.when(i % 2 == 0, "=SUM(A1)").otherwise("-5")
    record = F.when(t == "click", F.to_json(F.struct(i.alias("id"), named.alias("kind"), (i % 7).alias("x")))).when(t == "error", F.to_json(F.struct(i.alias("id"), note.alias("note"))))
    record = record.when(t == "purchase", F.to_json(F.struct(i.alias("id"), F.struct(i.alias("a")).alias("deep"), named.alias("kind")))).otherwise(F.to_json(F.struct(t.alias("kind"), F.lit("said").alias("two words"))))
    return export.csv_lines(e.select("event_id", record.alias("r")), ["event_id"], "r")


# Addresses --------------------------------------------------------------------------------------------------


@query("str8_own_address", """WITH d AS (SELECT doc_id, '203.0.113.' || (doc_id % 250) AS ip, substr(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), 1) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ip END AS own, md5(t || ' Your IP: ' || CASE WHEN doc_id % 3 = 0 THEN '[own IP]' ELSE '10.0.0.1' END || '. Server 198.51.100.7; again ' || CASE WHEN doc_id % 3 = 0 THEN '[own IP]' ELSE ip END || '.') AS digest FROM d""")
def str8(spark, d):
    """Texts that name an address as the visitor's and another as a server's; what was labelled is masked throughout."""
    ip = F.concat(F.lit("203.0.113."), (F.col("doc_id") % 250).cast("string"))
    shown = F.when(F.col("doc_id") % 3 == 0, ip).otherwise("10.0.0.1")
    text = F.concat(F.regexp_replace("text", "[^a-zA-Z ]", ""), F.lit(" Your IP: "), shown, F.lit(". Server 198.51.100.7; again "), ip, F.lit("."))
    docs = read(spark, d, "documents").filter("text is not null").select("doc_id", text.alias("t")).select("doc_id", addresses.pieces(F.col("t")).alias("cut")).withColumn("mine", addresses.labelled_in(F.col("cut")))
    return docs.select("doc_id", F.get("mine", F.lit(0)).alias("own"), F.md5(addresses.masked_in(F.col("cut"), F.col("mine"))).alias("digest"))


@query("mx11_masked_json", """SELECT event_id, '{"page_url": "http://192.0.2.1/x", "text": ["[own IP]", {"n": ' || event_id || ', "Curl": {"deep": "192.0.2.1"}, "said": "by [own IP], 192.0.2.10"}]}' AS record FROM events""")
def mx11(spark, d):
    record = F.concat(F.lit('{"page_url": "http://192.0.2.1/x", "text": ["192.0.2.1", {"n": '), F.col("event_id").cast("string"), F.lit(', "Curl": {"deep": "192.0.2.1"}, "said": "by 192.0.2.1, 192.0.2.10"}]}'))
    rows = read(spark, d, "events").select("event_id", record.alias("record"), F.array(F.lit("192.0.2.1")).alias("own"))
    return addresses.masked_json(rows, "event_id", "record", "own")
