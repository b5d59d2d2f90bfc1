"""What the third review's projections were about: how often queries move their rows, and what a row costs."""

import random
import re
import tracemalloc

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import hashing
from tidemark.functions import paths as paths_of
from tidemark.llm import registry as llm_registry
from tidemark.operators import schema, structure
from tidemark.plans import further
from tidemark.sources import html, nodes
from tidemark.streaming import state


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_move_the_nodes_once(spark):
    """Selectors, texts and nested records stay within the pages' one shuffle; nothing is written or joined on the way."""
    f = schema.Field
    pages = spark.createDataFrame([(1, "<section><h3>a</h3><ol><li><b>1</b></li><li><b>2</b> <u>x</u></li></ol></section><section id=q></section>")], "id int, html string")
    fields = [f("id", None, "attribute", attribute="id"), f("state", "h3"), f("lines", "ol > li", "nested", fields=[f("n", "b", "number"), f("open", "b + u", "exists"), f("own", None)])]
    got = schema.extract(nodes.node_rows(pages, "id"), "section", fields)
    plan = plan_of(got)
    assert len(re.findall("Exchange", plan)) == 1 and "Join" not in plan and "Scan parquet" not in plan
    rows = [(r.item, r.id, r.state, [tuple(x) for x in r.lines]) for r in got.orderBy("item").collect()]
    assert rows == [(0, None, "a", [(1.0, False, "1"), (2.0, True, "2 x")]), (1, "q", None, [])]


def test_page_take_shuffles_nothing(spark):
    plan = plan_of(catalog.QUERIES["bd3_page_take"](spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" in plan and "Exchange" not in plan and "FlatMapGroups" not in plan


ODD = ["<table>", "</table>", "<tr>", "<tr hidden>", "<td>", "</td>", "<td>a b</td>", "<td> &amp; &lt</td>", "<th colspan=2>", '<th colspan="2">h</th>', '<td rowspan="3">r</td>', "<td hidden>n</td>", "<caption>", "</caption>", "<thead>", "</thead>", "<tbody>", "<ul>", "<li>", "<p>", "x", " ", "<b>y</b>",
       "<br/>", "<script>a<b></script>", "<style>p{}</style>", "<title>t &amp</title>", "<head>", "</head>", "<!-- c -->", "<!DOCTYPE html>", "<A HREF='q'>L</A>", "1 < 2", "<td>z</TD >", '<div style="display: none">', "</div>", "<template>", "</template>"]


def test_plain_markup_reads_as_the_parser_reads_it(monkeypatch):
    """Pages drawn from pieces, regular and not: the same nodes, parts and tables with the short cut and without."""
    pages = []
    for seed in range(1500):
        draw = random.Random(seed)
        few = draw.sample(ODD, 12)
        pages.append("<table>" * (seed % 2) + "".join(draw.choice(few) for _ in range(30)))
    fast = [(nodes.page_nodes(p), html.page_parts(p, "http://a.test/"), html.page_tables(p)) for p in pages]
    taken = []

    def whole(parser, markup):
        taken.append(markup)
        parser.feed(markup)
        parser.close()

    monkeypatch.setattr(nodes, "fed", whole)
    monkeypatch.setattr(html, "fed", whole)
    for p, (found, parts, tables) in zip(pages, fast, strict=True):
        assert found == nodes.page_nodes(p) and parts == html.page_parts(p, "http://a.test/") and tables["tables"] == parts["tables"], p
    assert len(taken) == 2 * len(pages) and sum(bool(f[1]["tables"]) for f in fast) > 100


def test_order_tables_read_only_tables(spark):
    plan = plan_of(catalog.QUERIES["hx14_table_records"](spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" in plan
    kind = further.order_pages(spark, "/root/testdata/sf0.001").schema["parts"].dataType
    assert kind.names == ["tables"]


def test_blocks_are_judged_once(spark):
    """No filter on what posexplode reads is moved below the judging, where it would judge all blocks again for each."""
    plan = catalog.QUERIES["hx8_content_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 3


def test_addresses_are_cut_once(spark):
    plan = catalog.QUERIES["str8_own_address"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_simhash_needs_memory_for_few_texts_at_a_time():
    texts = pd.Series([" ".join(f"w{i * k % 997}" for i in range(600)) for k in range(1, 1200)])
    tracemalloc.start()
    got = hashing.simhash64.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    assert got.tolist()[:3] == [hashing.simhash_many([t])[0] for t in texts[:3]]


def test_vote_counts_a_page_once(spark, monkeypatch):
    calls, count = [], structure.node_stats
    monkeypatch.setattr(structure, "node_stats", lambda rows: calls.append(rows) or count(rows))
    pages = spark.createDataFrame([(1, "<p>some words</p>")], "id int, html string")
    structure.voted(nodes.node_rows(pages, "id"))
    assert len(calls) == 1


def test_edits_make_no_terms(spark):
    """Lengths and digests of edited texts come before terms do; ranges go to as many tasks as were asked for."""
    df = llm_registry.QUERIES["edits_of_op2"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "collect_list" not in plan
    assert df.rdd.getNumPartitions() == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_json_is_parsed_once(spark):
    """Paths share one parse and tell shapes without the schema of a value; the rows of one row group go to many tasks."""
    df = catalog.QUERIES["jsn1_json_select"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2 and "schemaOfVariant" not in plan
    assert df.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_json_keys_of_any_spelling(spark):
    doc = '{"a.b":1,"x[0]":2,"":3," s":4,"q?":5,"e":[],"f":[[],[{"k":null}]],"g":"t","n":null}'
    paths = {"['a.b']": "1", '["q?"]': "5", '[" s"]': "4", "['']": "3", "e.k": "[]", "e[0]": None, "e[-1]": None, "f.k": "[[],[null]]", "f{k}": '[[],[{"k":null}]]', "g.k": None, "g{k}": None, "n.k": None, "g.*": None, "e.*": "[]", "g[0:1]": None, "x": None}
    df = spark.createDataFrame([(doc,)], "x string")
    got = df.select(*[paths_of.json_project(F.col("x"), p).alias(f"c{i}") for i, p in enumerate(paths)]).first()
    assert list(got) == list(paths.values())


class Handle:
    """A processor's handle that counts the calls which another process would answer."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, []

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "get":
                return self.value
            if name == "update":
                self.value = args[0]
            if name == "registerTimer":
                self.timers.append(args[0])
            if name == "deleteTimer":
                self.timers.remove(args[0])

        return call

    def getValueState(self, *_):  # noqa: N802
        return self


def test_state_is_called_seldom():
    """A key's micro-batch reads and writes one value and moves at most one timer, however many rows and routes it has."""
    rows = [Row(s=100 * k, tie=k, what=w, route=f"r{k}", feedback="useful", ms=4.0) for k, w in enumerate(["asked", "failed", "asked", "asked"])]
    memory, handle = state.FailureMemory(), Handle()
    memory.init(handle)
    assert [tuple(r) for r in memory.handleInputRows((7,), iter(rows[::-1]), None)] == [(7, 3, 2)]
    assert handle.calls == 3 and handle.timers == [700_000]
    later = [Row(s=650, tie=9, what="asked"), Row(s=701, tie=10, what="asked"), Row(s=702, tie=11, what="failed")]
    handle.calls = 0
    assert [tuple(r) for r in memory.handleInputRows((7,), iter(later), None)] == [(7, 5, 3)]
    assert handle.calls == 4 and handle.timers == [1_302_000]
    assert not list(memory.handleExpiredTimer((7,), None, None)) and handle.value == (None, 5, 3)
    routes, handle = state.Routes(), Handle()
    routes.init(handle)
    out = list(routes.handleInputRows((7,), iter(rows), None))
    assert handle.calls == 2 and [r.route for r in out[0].routes] == ["r0", "r1", "r2", "r3"]
