"""Tables, blocks, captions, boxes, growth and search results on small cases and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.operators import blocks, intervals, ledgers, retrieval
from tidemark.sources import html, manifests


def cells(markup):
    return [(t["header"], t["rows"]) for t in html.page_parts(markup, "http://a.test/")["tables"]]


def test_spans_fill_the_grid():
    grid = "<table><tr><th>a</th><th colspan=2>b</th></tr><tr><td rowspan=2>1</td><td>2</td><td>3</td></tr><tr><td>4</td><td>5</td></tr><tr><td>6</td></tr></table>"
    assert cells(grid) == [(["a", "b", "b"], [["1", "2", "3"], ["1", "4", "5"], ["6", "", ""]])]


def test_headless_table_and_last_row_of_thead():
    assert cells("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>") == [(["", ""], [["1", "2"], ["3", "4"]])]
    assert cells("<table><thead><tr><td>x</td><td>x</td></tr><tr><td>p</td><td>q</td></tr></thead><tr><td>1</td><td>2</td></tr></table>") == [(["p", "q"], [["x", "x"], ["1", "2"]])]


@pytest.mark.parametrize("markup", [
    "<table role=presentation><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>", "<table><tr><td>1</td></tr><tr><td>2</td></tr></table>", "<table><tr><td>1</td><td>2</td></tr></table>",
    "<table></table>", "<table><tr></tr></table>", "<table><tr><td> </td><td></td></tr><tr><td></td><td></td></tr></table>", f"<table><tr><td>{'w ' * 300}</td><td>{'v ' * 300}</td></tr><tr><td>{'u ' * 300}</td><td>x</td></tr></table>",
    "", "<td>1</td><td>2</td>",
])
def test_no_data_table(markup):
    assert cells(markup) == []


def test_inner_table_is_data_and_outer_layout():
    inner = "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"
    assert cells(f"<table><tr><td>{inner}</td><td>n</td></tr><tr><td>n</td><td>n</td></tr></table>") == [(["", ""], [["1", "2"], ["3", "4"]])]


def test_linked_data_graph(spark):
    blob = '<script type="application/ld+json">{"@context":"c","@graph":[{"@type":"Site"},[{"headline":"H","author":{"name":"N"}}]],"name":"beside"}</script>'
    broken = '<script type="application/ld+json">{"headline":</script>'
    page = spark.createDataFrame([(1, "http://a.test/", broken + blob), (2, "http://a.test/", None)], "page_id long, url string, html string")
    got = {r.id: (r.title, r.author) for r in html.metadata(html.parse_pages(page)).collect()}
    assert got == {1: ("H", "N"), 2: (None, None)}


def test_main_text_by_plain_loop(spark):
    rng = random.Random(5)
    pages = [(i, [(" ".join("w" * 3 for _ in range(rng.choice([0, 2, 5, 15, 16, 17, 18, 41]))), rng.choice([0.0, 0.3, 0.34, 0.6])) for _ in range(rng.randrange(9))]) for i in range(60)]
    pages.append((60, [("中文没有空格所以每个字都算一个词这是一段比较长的内容", 0.0), ("x", 0.0)]))
    want = {}
    for i, bs in pages:
        bs = [(t, k, sum(max(1, sum("一" <= c <= "鿿" for c in w)) for w in t.split())) for t, k in bs if t]
        ends = [("", 0.0, 0), *bs, ("", 0.0, 0)]
        kept = [b[0] for a, b, c in zip(ends, bs, ends[2:], strict=False) if b[1] <= 1 / 3 and ((b[2] > 16 or c[2] > 15 or a[2] > 4) if a[1] <= 5 / 9 else (b[2] > 40 or c[2] > 17))]
        kept, full = "\n".join(kept), "\n".join(b[0] for b in bs)
        want[i] = full if len(kept) < 400 and (not kept or (len(full) >= 3 * len(kept) and len(full) <= 4000)) else kept
    df = spark.createDataFrame(pages, "id int, b array<struct<text:string,linked:double>>")
    got = {r.id: r.main for r in blocks.main_text(df, "id", "b").collect()}
    assert got == want
    assert blocks.main_text(df.limit(0), "id", "b").count() == 0


def test_fresh_lines_by_plain_loop(spark):
    rng = random.Random(6)
    rows = [(v, i, "\n".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))) for v in range(20) for i in range(12)]
    want = set()
    for v in range(20):
        prev = []
        for _, i, t in [r for r in rows if r[0] == v]:
            now = t.split("\n")
            n = max(k for k in range(min(len(now), len(prev)) + 1) if prev[len(prev) - k :] == now[:k])
            if now[n:]:
                want.add((v, i, "\n".join(now[n:])))
            prev = now
    got = intervals.fresh_lines(spark.createDataFrame(rows, "v int, i int, t string"), "v", "i", "t")
    assert {tuple(r) for r in got.collect()} == want


def test_passages_cut_by_length_and_chapter(spark):
    cues = spark.createDataFrame([("v", 0, 0, 4, "a", 1), ("v", 0, 9, 12, "b", 2), ("v", 0, 10, 11, "c", 3), ("v", 1, 11, 12, "d", 4)], "v string, chapter int, s int, e int, t string, k int")
    got = intervals.passages(cues, ["v", "chapter"], "s", "e", "t", "k", 10).collect()
    assert {tuple(r) for r in got} == {("v", 0, 0, 12, 2, "a b"), ("v", 0, 10, 11, 1, "c"), ("v", 1, 11, 12, 1, "d")}


def test_boxes_keep_the_strongest(spark):
    b = [("p", 1, 0.0, 0.0, 4.0, 4.0, 0.9), ("p", 2, 0.0, 1.0, 4.0, 5.0, 0.8), ("p", 3, 9.0, 9.0, 12.0, 12.0, 0.1), ("q", 4, 0.0, 1.0, 4.0, 5.0, 0.8), ("q", 5, 2.0, 2.0, 2.0, 2.0, 0.7)]
    df = spark.createDataFrame(b, "pic string, id int, x1 double, y1 double, x2 double, y2 double, score double").select("pic", F.struct("id", "x1", "y1", "x2", "y2").alias("box"), "score")
    assert {r.id for r in intervals.strongest_boxes(df, "pic", "box", "score", 0.4).select("box.id").collect()} == {1, 3, 4, 5}


def test_growth_stops(spark):
    rows = [("grows", i, i + 1) for i in range(50)] + [("still", i, 7) for i in range(9)] + [("short", 0, 3), ("short", 1, 3)]
    got = {r.k: (r.rounds, r.tried) for r in ledgers.growth(spark.createDataFrame(rows, "k string, i int, h int").withColumn("t", F.lit(0)), "k", "i", "h", "t").collect()}
    assert got == {"grows": (40, False), "still": (5, True), "short": (None, False)}


@pytest.mark.parametrize("q, want", [
    ("how to fix the rusty garden gate hinge quickly", "how fix rusty garden"), ('find "blue gate" of the rusty garden hinge', '"blue gate" find rusty'), ("garden gate", None), ("", None), ('"one" two', None), ('the of "', None),
])
def test_shorten(spark, q, want):
    assert spark.createDataFrame([(q,)], "q string").select(T.shorten(F.col("q"), ["the", "of", "to"])).first()[0] == want


@pytest.mark.parametrize("header, want", [('h3=":8443"; ma=60, h2=":1"', (8443, 60)), ('h2=":1"; ma=9,h3-29="alt:444"', (444, 86400)), ("h3=x", (443, 86400)), ("clear", None), ('h2=":443"', None), (None, None)])
def test_alt_svc(spark, header, want):
    got = spark.createDataFrame([(header,)], "h string").select(U.alt_svc(F.col("h"))).first()[0]
    assert (got and tuple(got)) == want


def test_one_word_answers(spark):
    rows = [("a", t) for t in ("Red shoes", "red hat", "red", "none")] + [("b", t) for t in ("red", "red", "red big")] + [("c", t) for t in ("red", "old", "red")] + [("d", "red")] * 2
    df = spark.createDataFrame(rows, "query string, shown string").withColumn("terms", F.array(F.lit("red"), F.lit("big"), F.lit("old")))
    assert [tuple(r) for r in retrieval.one_word_answers(df, "query", "terms", "shown").collect()] == [("a", "red")]


@pytest.mark.parametrize("path, want", [
    ("$", '{"a":[{"b":1},{"b":[2,3]},5],"c":{"d e":null,"f":7}}'), ("a.b", "[1,[2,3],null]"), ("$.a[1].b[-1]", "3"), ("a[1:].b", "[[2,3],null]"), ("a[-9:-2]", '[{"b":1}]'), ("a[7]", None), ('c["f"]', "7"), ("c['d e']", None),
    ("c.*", "[null,7]"), ("{c.f, a[0].b}", '{"a[0].b":1,"c.f":7}'), ("a{b}", '[{"b":1},{"b":[2,3]},null]'), ("a[*].b", "[1,[2,3],null]"), ("a.b.x", "[null,[null,null],null]"), ("c.f.g", None), ("nope", None), ("a[2:1]", "[]"),
])
def test_json_project(spark, path, want):
    doc = '{"a":[{"b":1},{"b":[2,3]},5],"c":{"d e":null,"f":7}}'
    got = spark.createDataFrame([(doc,), ("{",), (None,)], "x string").select(P.json_project(F.col("x"), path)).collect()
    assert [r[0] for r in got] == [want, None, None]


@pytest.mark.parametrize("path", ["a b", "a[", "{}", "{a", "a..b", "a]", "a[1:x]"])
def test_json_path_errors(path):
    with pytest.raises(ValueError):
        P.parse(path)


def test_hls_protection_and_gaps(spark):
    body = '#EXTM3U\n#EXT-X-KEY:METHOD=NONE\n#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k",KEYFORMAT="com.x"\n#EXTINF:2,\n\n#EXT-X-BYTERANGE:1\na.ts\nstray.ts\n#EXTINF:3.5,title\nb.ts'
    df = spark.createDataFrame([(1, body), (2, ""), (3, None)], "id int, body string")
    assert [tuple(r) for r in manifests.hls_segments(df, "id", "body").orderBy("place").collect()] == [(1, 0, "a.ts", 0.0, 2.0), (1, 1, "b.ts", 2.0, 3.5)]
    assert [r[0] or None for r in df.orderBy("id").select(manifests.hls_protection(F.col("body"))).collect()] == ["SAMPLE-AES com.x", None, None]
