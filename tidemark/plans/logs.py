"""Log, ledger, join and window queries whose SQL both engines read alike; ``events`` stands for the request log:
event_type is the domain, value the milliseconds, user_id the exit, 'error' a blocked request."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def run_sql(sql: str):
    """A query function: the tables that the text names become views of the folder."""
    names = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in names:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(sql)

    return query


SHARED = {
    "ag1_request_summary": "SELECT event_type AS domain, count(*) AS requests, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS blocked, CAST(floor(avg(value)) AS BIGINT) AS avg_ms FROM events GROUP BY event_type",
    "ag2_first_seen": "SELECT user_id, min(ts) AS first_seen FROM events GROUP BY user_id",
    "ag3_outcomes_by_type": "SELECT o_orderpriority AS kind, count(*) FILTER (WHERE o_orderstatus = 'F') AS solved, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failed FROM orders GROUP BY o_orderpriority",
    "ag4_strategy_history": "SELECT l_returnflag AS strategy, count(*) AS n, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS ok FROM lineitem GROUP BY l_returnflag",
    "ag5_route_grains": "SELECT l_returnflag AS widget, l_linestatus AS strategy, grouping(l_returnflag) AS overall, count(*) AS n, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS ok FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus))",
    "ag6_sizes": "SELECT count(*) AS n_docs, sum(n_chars) AS n_chars, count(DISTINCT source) AS n_sources FROM documents",
    "ag12_cited_hosts": "SELECT event_type AS page, count(*) AS citations, count(DISTINCT user_id) AS hosts FROM events GROUP BY event_type",
    "ag13_label_counts": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic",
    "ag13_holdout": "SELECT quality, CASE WHEN (rn - 1) % 5 = 0 THEN 1 ELSE 0 END AS held_out, count(*) AS n FROM (SELECT quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rn FROM labels) t GROUP BY 1, 2",
    "ag16_visits_in_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS visits, min(epoch_s) OVER (PARTITION BY user_id ORDER BY epoch_s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS oldest FROM (SELECT event_id, user_id, {epoch} AS epoch_s FROM events) t",
    "ag17_decayed_spend": "SELECT event_type AS domain, user_id % 10 AS exit, round(sum(CASE WHEN event_type = 'error' THEN 2.0 ELSE 1.0 END * pow(CAST(0.5 AS DOUBLE), ({now} - {epoch}) / 21600.0)), 6) AS spent FROM events GROUP BY event_type, user_id % 10",
    "ag21_route_scores": "SELECT event_type AS tier, round((s + 1) / (s + f + 2) / (1 + lat / 30000.0), 9) AS score FROM (SELECT event_type, CAST(count(*) FILTER (WHERE value < 50) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE value >= 50) AS DOUBLE) AS f, avg(value) AS lat FROM events GROUP BY event_type) t",
    "src2_newest_of_domain": "SELECT event_id, ts, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "src20_recent_requests": "SELECT event_id, event_type, value FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20",
    "jn1_jobs_with_pending": "SELECT c.c_custkey AS job, n.n_name AS crawl, coalesce(p.pending, 0) AS pending FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS pending FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) p ON p.o_custkey = c.c_custkey",
    "jn2_crawl_queue": "SELECT c.c_custkey AS crawl, count(*) AS pending, max(o.o_totalprice) AS best FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O' GROUP BY c.c_custkey ORDER BY pending DESC, crawl LIMIT 20",
    "jn3_next_job": "SELECT o_orderkey AS job FROM orders q WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_custkey = q.o_custkey AND r.o_orderstatus = 'F') ORDER BY o_orderdate, o_orderkey LIMIT 1",
    "jn4_orphans": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "jn5_in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "jn6_log_to_page": "SELECT l.doc_id, l.quality, d.lang, d.n_chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id",
    "jn9_asof_version": "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events",
    "jn13_dictionary": "SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey",
    "jn14_bursts": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_s RANGE BETWEEN 119 PRECEDING AND 119 FOLLOWING) AS burst, lead(epoch_s) OVER (PARTITION BY user_id ORDER BY epoch_s, event_id) AS next_visit FROM (SELECT event_id, user_id, {epoch} AS epoch_s FROM events) t",
    "wn1_keep_versions": "SELECT conv_id, turn, rn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) t WHERE rn <= 3",
    "wn2_neighbour_blocks": "SELECT conv_id, turn, length(text) AS chars, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations",
    "wn3_trailing_novelty": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS novelty FROM events",
    "wn7_running_budget": "SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM documents",
    "wn9_rising_prefix": "SELECT event_id FROM (SELECT event_id, user_id, ts, max(broken) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bad FROM (SELECT event_id, user_id, ts, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS broken FROM events) a) b WHERE bad = 0",
    "wn12_static_runs": "SELECT user_id, run, count(*) AS frames FROM (SELECT user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT user_id, ts, event_id, CASE WHEN abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 5 THEN 0 ELSE 1 END AS brk FROM events) a) b GROUP BY user_id, run",
    "tk3_evict": "SELECT doc_id, n_chars FROM (SELECT d.doc_id, d.n_chars, sum(d.n_chars) OVER (PARTITION BY d.source ORDER BY coalesce(l.quality, 0), d.n_chars DESC, d.doc_id ROWS UNBOUNDED PRECEDING) - d.n_chars AS before FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) t WHERE before < 10000",
    "tk11_resumable": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    "set2_source_priority": "SELECT doc_id, src FROM (SELECT doc_id, src, row_number() OVER (PARTITION BY doc_id ORDER BY prio) AS rn FROM (SELECT doc_id, 'labels' AS src, 1 AS prio FROM labels UNION ALL SELECT doc_id, 'documents' AS src, 2 AS prio FROM documents) u) t WHERE rn = 1",
    "chg3_watch_counts": "SELECT conv_id, count(*) AS checks, sum(CASE WHEN prev IS NOT NULL AND prev <> text THEN 1 ELSE 0 END) AS changed FROM (SELECT conv_id, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) t GROUP BY conv_id",
    "chg5_retention": "SELECT event_id FROM (SELECT event_id, {epoch} AS epoch_s, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn <= 20 AND epoch_s >= {now} - 2592000",
    "flt1_fresh": "SELECT event_id FROM events WHERE {epoch} + 86400 * 30 > {now}",
    "flt4_include": "SELECT page_id, url FROM pages WHERE url LIKE '%example.org%' AND NOT regexp_like(lower(url), '[.](jpg|png|gif|pdf|zip)([?#]|$)')",
    "flt8_prefix": "SELECT page_id FROM pages WHERE url LIKE 'http://www.%'",
    "mx3_fallback": "SELECT g.k AS exit, CASE WHEN g.n >= 30 THEN g.avg_ms ELSE a.avg_ms END AS avg_ms FROM (SELECT user_id % 50 AS k, count(*) AS n, round(avg(value), 6) AS avg_ms FROM events GROUP BY user_id % 50) g CROSS JOIN (SELECT round(avg(value), 6) AS avg_ms FROM events) a",
    "ag11_corroboration": "SELECT source, count(DISTINCT text) AS independent, max(n) AS largest FROM (SELECT source, text, count(*) OVER (PARTITION BY source, text) AS n FROM documents) t GROUP BY source",
}

_NOW = "1706745600"  # 2024-02-01
_SPARK = {"epoch": "unix_seconds(CAST(ts AS TIMESTAMP))", "now": _NOW}
_DUCK = {"epoch": "CAST(floor(epoch(ts)) AS BIGINT)", "now": _NOW}


def _fill(sql: str, names: dict[str, str]) -> str:
    for k, v in names.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


QUERIES = {k: run_sql(_fill(v, _SPARK).replace(" IGNORE NULLS)", ") IGNORE NULLS")) for k, v in SHARED.items()}
SQL = {k: _fill(v, _DUCK).replace("regexp_like(", "regexp_matches(") for k, v in SHARED.items()}
