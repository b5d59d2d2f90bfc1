"""Queries of the state machines over the event table, with the same folds in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.plans.content import read
from tidemark.streaming import state

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def timed(spark, d, *cols: Column):
    e = read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("k"), "at", F.unix_seconds("at").alias("s"), F.col("event_id").alias("tie"), *cols)


_E = "SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_id, event_type, value FROM events"


@query("st2_backoff", f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS rn FROM ({_E}) x WHERE event_type = 'error'),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS until, 0 AS strikes, 0::BIGINT AS struck_at FROM e UNION ALL
 SELECT user_id, rn, greatest(until, s + CASE kind WHEN 2 THEN least(3600, greatest(1, event_id % 5000)) WHEN 1 THEN 30 ELSE least(900, 30 * pow(4, n)) END)::BIGINT, CASE kind WHEN 0 THEN n + 1 ELSE n END, CASE kind WHEN 0 THEN s ELSE struck_at END
 FROM (SELECT e.user_id, e.rn, e.s, e.event_id, e.event_id % 3 AS kind, r.until, r.struck_at, CASE WHEN e.s - r.struck_at > 1800 THEN 0 ELSE r.strikes END AS n FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) x)
SELECT user_id, arg_max(until, rn) AS until, arg_max(strikes, rn) AS strikes, arg_max(struck_at, rn) AS struck_at FROM r GROUP BY user_id""")
def st2(spark, d):
    kind = F.col("event_id") % 3
    why = F.when(kind == 0, "limited").when(kind == 1, "server").otherwise("after")
    rows = timed(spark, d, why.alias("why"), (F.col("event_id") % 5000).alias("wait"), "event_type").filter("event_type = 'error'").drop("event_type")
    return state.latest(state.in_turns(rows, state.Backoff())).withColumnRenamed("k", "user_id")


@query("st4_failure_memory", f"""WITH w AS (SELECT *, max(CASE WHEN event_type = 'error' THEN s END) OVER o AS failed, last_value(CASE WHEN event_type IN ('error', 'purchase') THEN event_type END IGNORE NULLS) OVER o AS news FROM ({_E}) x
WINDOW o AS (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, count(*) FILTER (event_type NOT IN ('error', 'purchase')) AS asked, count(*) FILTER (event_type NOT IN ('error', 'purchase') AND news = 'error' AND failed > s - 600) AS answered FROM w GROUP BY user_id""")
def st4(spark, d):
    what = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "passed").otherwise("asked")
    return state.latest(state.in_turns(timed(spark, d, what.alias("what")), state.FailureMemory())).withColumnRenamed("k", "user_id")


@query("st8_route_learning", f"""WITH RECURSIVE e AS (SELECT *, 'r' || event_id % 3 AS route, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY s, event_id) AS rn, max(s) OVER (PARTITION BY user_id) AS heard FROM ({_E}) x),
r AS (SELECT DISTINCT user_id, route, 0::BIGINT AS rn, 0::DOUBLE AS good, 0::DOUBLE AS bad, 0::DOUBLE AS ms, 0::BIGINT AS updated, heard FROM e UNION ALL
 SELECT user_id, route, rn, CASE WHEN event_type = 'error' THEN least(4.0, good * decay) * 0.5 ELSE good * decay + CASE WHEN value >= 50 THEN 1 ELSE 0 END END, CASE WHEN event_type = 'error' THEN bad * decay + 1 ELSE 0 END, ms * 0.7 + value * 0.3, s, heard
 FROM (SELECT e.*, CASE WHEN fresh THEN 0.0 ELSE r.good END AS good, CASE WHEN fresh THEN 0.0 ELSE r.bad END AS bad, CASE WHEN fresh THEN e.value ELSE r.ms END AS ms, CASE WHEN fresh THEN 1.0 ELSE pow(0.5, (e.s - r.updated) / 43200) END AS decay
  FROM (SELECT r.*, e.s - r.updated > 86400 OR r.rn = 0 AS fresh FROM r JOIN e ON e.user_id = r.user_id AND e.route = r.route AND e.rn = r.rn + 1) r JOIN e ON e.user_id = r.user_id AND e.route = r.route AND e.rn = r.rn + 1) x)
SELECT user_id, route, round(arg_max(good, rn), 6) AS successes, round(arg_max(bad, rn), 6) AS failures, round(arg_max(ms, rn), 6) AS ms FROM r GROUP BY user_id, route, heard HAVING heard - max(updated) <= 86400""")
def st8(spark, d):
    feedback = F.when(F.col("event_type") == "error", "failed").when(F.col("value") >= 50, "useful").otherwise("delivered")
    rows = timed(spark, d, F.concat(F.lit("r"), F.col("event_id") % 3).alias("route"), feedback.alias("feedback"), F.col("value").alias("ms"))
    last = state.latest(state.in_turns(rows, state.Routes())).select("k", F.explode("routes").alias("r")).select("k", "r.*")
    return last.select(F.col("k").alias("user_id"), "route", *[F.round(c, 6).alias(c) for c in ("successes", "failures", "ms")])


@query("st9_watch_changes", f"""WITH w AS (SELECT *, floor(value / 50) AS digest, lag(floor(value / 50)) OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) AS was FROM ({_E}) x)
SELECT user_id, event_type AS page, count(*) AS checks, count(*) FILTER (digest <> was) AS changes, max(s) FILTER (digest <> was) AS changed_at FROM w GROUP BY ALL""")
def st9(spark, d):
    rows = timed(spark, d, F.col("event_type").alias("page"), F.floor(F.col("value") / 50).alias("digest"))
    last = state.latest(state.in_turns(rows, state.Watches())).select("k", F.explode("pages").alias("p"))
    return last.select(F.col("k").alias("user_id"), "p.page", "p.checks", "p.changes", "p.changed_at")


@query("st12_orphaned_jobs", f"""WITH w AS (SELECT user_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS later, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS beats FROM ({_E}) x)
SELECT user_id, s + 300 AS orphaned_at, beats FROM w WHERE later - s > 300 OR later IS NULL AND s + 300 < (SELECT floor(epoch(max(ts))) FROM events) - 600""")
def st12(spark, d):
    return state.in_turns(timed(spark, d), state.Heartbeats(), "append").select(F.col("k").alias("user_id"), "orphaned_at", "beats")
