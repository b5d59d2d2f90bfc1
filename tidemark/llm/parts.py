"""What of some operators SQL can express, column by column, as queries of their own: the operators' results narrowed to it,
or the operator's own step where that makes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import imatch, quote_link
from .secret_scan import op4_secret_scan
from .source_mix import op7_source_mix
from .url_rules import op5_url_rules


def edits_of_op2(spark, sf_dir: str) -> DataFrame:
    """Lengths and edited texts of the fingerprint query, by its step that makes them: no terms are made or gathered."""
    return imatch.edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"))


def base_of_op4(spark, sf_dir: str) -> DataFrame:
    """The fixed shapes of the secret scan."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def rules_of_op5(spark, sf_dir: str) -> DataFrame:
    """Host, path and fixed rule of each URL, with the verdict where a rule decides."""
    return op5_url_rules(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def targets_of_op7(spark, sf_dir: str) -> DataFrame:
    """Sizes and targets of the mix."""
    return op7_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def conversations_of_op10(spark, sf_dir: str) -> DataFrame:
    """The conversations themselves, in reply order and without quotes, in parts of 1,000 messages."""
    built = quote_link.conversations(quote_link.link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    said = F.transform("messages", lambda m: F.concat_ws(": ", F.coalesce(m["role"], F.lit("-")), m["text"]))
    return built.select(F.col("conv").alias("conv_id"), "part", said.alias("messages"))


QUERIES = {f.__name__: f for f in (edits_of_op2, base_of_op4, rules_of_op5, targets_of_op7, conversations_of_op10)}

_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, rank: int, pattern: str, least: int, value: str) -> str:
    """Rows of one kind: what stands between the matches and the matches themselves add up to places."""
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start, start + length(hit) AS stop FROM (
  SELECT doc_id, m[k] AS hit, {value.format(m="m[k]")} AS value, (list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d) a) b) c WHERE length(value) >= {least}"""


_AFTER = "regexp_extract(url, '(?s)://(.*)$', 1)"

SQL = {
    "conversations_of_op10": f"""WITH q AS ({quote_link.SQL}) SELECT conv_id, (pos // 1000)::BIGINT AS part, list(coalesce(role, '-') || ': ' || text ORDER BY pos) AS messages FROM q GROUP BY 1, 2""",
    "edits_of_op2": """WITH o AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT a.doc_id, length(a.t) AS n_chars, sha256(left(a.t, (length(a.t) - length(a.t) // 2)::BIGINT) || left(b.t, (length(a.t) // 2)::BIGINT)) AS edited_sha256 FROM o a JOIN o b ON b.rn = a.rn % a.n + 1""",
    "base_of_op4": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_spans("assign", 0, _ASSIGN, 8, f"regexp_extract({{m}}, '{_ASSIGN}', 1)")} UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 16, "{m}")} UNION ALL {_spans("hex", 2, "[0-9a-f]+", 32, "{m}")})
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '')) AS base_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    "rules_of_op5": f"""WITH u AS (SELECT page_id, coalesce(lower(regexp_extract({_AFTER}, '^[^/?#]*')), '') AS host, coalesce(regexp_replace(regexp_extract({_AFTER}, '^[^?#]*'), '^[^/]*', ''), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) v(verdict, h, p)),
f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, verdict FROM u LEFT JOIN f USING (page_id)""",
    "targets_of_op7": r"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
i AS (SELECT 0 AS k, (SELECT list({'s': source, 'size': size, 'w': w, 'full': false}) FROM s) AS l, (SELECT sum(size) FROM s)::DOUBLE AS whole UNION ALL
  SELECT k + 1, list_transform(l, lambda x: {'s': x.s, 'size': x.size, 'w': x.w, 'full': x.full OR per * x.w > 3 * x.size}), whole
  FROM (SELECT *, (whole - coalesce(list_sum(list_transform(list_filter(l, lambda x: x.full), lambda x: 3 * x.size)), 0)) / greatest(list_sum(list_transform(list_filter(l, lambda x: NOT x.full), lambda x: x.w)), 1) AS per FROM i) j WHERE k <= len(l)),
e AS (SELECT l, (whole - coalesce(list_sum(list_transform(list_filter(l, lambda x: x.full), lambda x: 3 * x.size)), 0)) / greatest(list_sum(list_transform(list_filter(l, lambda x: NOT x.full), lambda x: x.w)), 1) AS per FROM i ORDER BY k DESC LIMIT 1),
t AS (SELECT x.s AS source, x.size AS source_size, CASE WHEN x.full THEN 3.0 * x.size ELSE per * x.w END AS target FROM e, unnest(l) u(x))
SELECT doc_id, size, source_size, round(target, 6) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
}
