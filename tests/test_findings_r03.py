"""Faults of the third review, each with the least input that showed it."""

import datetime

import duckdb
import pytest

from tidemark import catalog
from tidemark.sources import nodes


def against_sql(spark, folder, name, tables):
    """The query over ``tables`` and its twin's rows, both sorted."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({catalog.SQL[name]}) x").fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


CUT = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Hahe the&amp;&amp</title><style>p{margin:0}</style><script>var t="</p>";track(1);</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><article><h1>Hahe the&amp;&amp</h1><p>words &am</p></article><footer>&copy; x</footer></body></html>'


def cut_pages(spark):
    return {"pages": spark.createDataFrame([(1, "http://x.example.org/a", CUT)], "page_id bigint, url string, html string")}


def test_title_reads_references_as_the_twin(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "hx1_title", cut_pages(spark))
    assert got == want == [(1, "Hahe the&&amp")]


def test_density_prune_reads_references_as_the_twin(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "hx5_density_prune", cut_pages(spark))
    assert got == want


def test_node_stats_read_references_as_the_twin(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "hx12_node_stats", cut_pages(spark))
    assert got == want


def test_ended_refs_leave_what_has_no_references():
    assert nodes.ended_refs("a &amp b &lt; &#65; &#x41; &x") == "a &amp;amp b &lt; &#65; &#x41; &amp;x"
    assert nodes.ended_refs("<script>a && b</script>&c<style>&</style><!-- & -->") == "<script>a && b</script>&amp;c<style>&</style><!-- & -->"


@pytest.mark.parametrize("fraction", [0, 999_500])
def test_heartbeat_on_the_watermarks_second(spark, tmp_path, fraction):
    """The newest event may have a fraction of a second; jobs went quiet a second before the line, on it and after it."""
    at = datetime.datetime(2024, 1, 2)
    rows = [(1, at + datetime.timedelta(microseconds=fraction), 0, "view", 1.0, "{}")]
    rows += [(2 + k, at - datetime.timedelta(seconds=900 + s, microseconds=-700_000), 1 + k, "view", 1.0, "{}") for k, s in enumerate([1, 0, -1, 2])]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    got, want = against_sql(spark, tmp_path, "st12_orphaned_jobs", {"events": events})
    assert got == want and len(got) == 2


def test_long_page_leaves_in_parts(monkeypatch):
    """A page's nodes come as they close, not all at once, and are the same wherever the parts end."""
    html = "<html><body><main>" + "".join(f"<div class=c><h2>a &amp; b{k}</h2><script>if (a<{k}) x</script><p>1 < 2 &copy<p><b>x<li>y</div>" for k in range(300)) + "</main>"
    whole = nodes.page_nodes(html)
    monkeypatch.setattr(nodes, "PIECE", 500)
    parts = list(nodes.node_lists(html))
    assert len(parts) > 40 and max(map(len, parts)) < len(whole) / 20
    assert sorted((n for p in parts for n in p), key=lambda n: n[0]) == whole


@pytest.mark.parametrize("name", ["dup3_near_pairs", "dup5_group_labels", "hx17_healed"])
def test_written_tables_are_not_collected_to_be_broadcast(spark, name):
    """Small on disk is not small in rows: no join of these may bring a table to the driver."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_masked_json_shuffles_nothing(spark):
    plan = catalog.QUERIES["mx11_masked_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
