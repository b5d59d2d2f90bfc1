"""What the fourth review's finding was about: how often the node rows of a record query are sorted."""

import random
import re

from pyspark.sql import functions as F

from tidemark.operators import schema
from tidemark.sources import nodes


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_cut_from_one_group(spark):
    """Node rows are sorted for siblings and by page, then gathered once: not again for each level of nesting."""
    f = schema.Field
    pages = spark.createDataFrame([(1, "<p>no</p><section><ol><li><b>1</b> <i>a</i><u>x</u></li><li><b>2</b><ol><li><b>3</b></li></ol></li></ol></section>")], "id int, html string")
    lines = f("lines", "ol li", "nested", fields=[f("n", "b", "number"), f("open", "i + u", "exists"), f("below", "li", "nested", fields=[f("n", "b")])])
    got = schema.extract(nodes.node_rows(pages, "id", only=schema.READ), "section", [lines])
    assert len(re.findall(r"\bSort \[", plan_of(got))) == 2 and len(re.findall(r"ObjectHashAggregate|SortAggregate", plan_of(got))) <= 2
    (r,) = got.collect()
    assert [(x.n, x.open, [y.n for y in x.below]) for x in r.lines] == [(1.0, True, []), (2.0, False, ["3"]), (3.0, False, [])]


def test_page_columns_beside_fields_of_their_names(spark):
    pages = spark.createDataFrame([(7, "<p id=a>x</p><p>y</p>")], "k int, html string")
    got = schema.extract(nodes.node_rows(pages, "k"), "p", [schema.Field("id", None, "attribute", attribute="id"), schema.Field("item")]).collect()
    assert sorted((r.page_id, r.page_item, r.id, r["item"]) for r in got) == [(7, 0, "a", "x"), (7, 1, None, "y")]


def test_links_of_lists_and_nested_records(spark):
    f = schema.Field
    html = '<div class="r"><a href="x?q=1">one</a><ul><li><a href="/y"> t </a></li><li>none</li></ul><em>z</em></div>'
    pages = spark.createDataFrame([(1, html, "https://e.test/d/p"), (2, html, None)], "id int, html string, url string")
    link = {"kind": "attribute", "attribute": "href", "absolute": True}
    fields = [f("all", "em", "list", absolute=True), f("sub", "li", "nested", fields=[f("to", "a", **link), f("host", "a", regex="//([a-z.]+)/", **link)]), f("first", "a", **link)]
    a, b = schema.extract(nodes.node_rows(pages, "id"), ".r", fields, pages).orderBy("id").collect()
    assert a["all"] == ["https://e.test/d/z"] and [tuple(x) for x in a["sub"]] == [("https://e.test/y", "e.test"), (None, None)] and a.first == "https://e.test/d/x?q=1"
    assert b["all"] == ["z"] and [tuple(x) for x in b["sub"]] == [("/y", None), (None, None)] and b.first == "x?q=1"


def test_rows_inside(spark):
    """``inside`` counts the rows below an element, and the chosen columns are those of the whole rows."""
    draw = random.Random(4)
    pieces = ["<b>", "</b>", "<p>", "</p>", "<div class=a>", "</div>", "x", " ", "<br>", "<li>", "<ul>", "</ul>", "<table>", "<td>y</td>", "</table>", "<a href=1 id=q>", "</a>"]
    pages = spark.createDataFrame([(k, "".join(draw.choice(pieces) for _ in range(40))) for k in range(60)], "id int, html string")
    rows = nodes.node_rows(pages, "id").cache()
    for r in rows.groupBy("id").agg(F.collect_list(F.struct("enter", "leave", "inside")).alias("n")).collect():
        assert all(x.inside == sum(x.enter < y.enter < x.leave for y in r.n) for x in r.n)
    some = nodes.node_rows(pages, "id", only=("tag", "attrs", "enter"))
    assert some.columns == ["id", "enter", "tag", "attrs"]
    key = lambda r: (r.id, r.enter)
    assert sorted(some.collect(), key=key) == sorted(rows.select("id", "enter", "tag", "attrs").collect(), key=key)


def test_folded_rows_give_the_same_records(spark):
    """Fewer rows, the same records: texts alone in an element, beside others, blank, in formatting that goes on."""
    draw = random.Random(5)
    pieces = ["<div class=r>", "</div>", "<b>", "</b>", "<p>", "</p>", "x", " ", "&lt;&nbsp;", "<b>k</b>", "<br>", "<i title='\"'>z</i>", "<ul>", "<li>", "</ul>", "<em> </em>"]
    pages = spark.createDataFrame([(k, "".join(draw.choice(pieces) for _ in range(50))) for k in range(150)], "id int, html string")
    f = schema.Field
    fields = [f("one", "b"), f("all", "b", "list"), f("own"), f("markup", None, "html"), f("inner", "p", "html"), f("near", "b + i", "list"), f("sub", "li", "nested", fields=[f("t"), f("h", "b", "html")])]
    whole, few = nodes.node_rows(pages, "id").cache(), nodes.node_rows(pages, "id", only=schema.READ, folded=True).cache()
    assert few.count() < whole.count() and few.filter("tag is not null").count() == whole.filter("tag is not null").count()
    want, got = (schema.extract(n, "div.r", fields).orderBy("id", "item").collect() for n in (whole, few))
    assert want == got and len(got) > 150 and any(r.markup and "&lt;&nbsp;" in r.markup for r in got)


def test_order_pages_are_folded(spark):
    """A line of an order is five or six node rows; the texts of its elements have none."""
    from tidemark import catalog

    made = []

    class Seen(Exception):
        pass

    def seen(rows, *_):
        made.append(rows)
        raise Seen

    own = schema.extract
    schema.extract = seen
    try:
        catalog.QUERIES["hx15_nested_orders"](spark, "/root/testdata/sf0.001")
    except Seen:
        pass
    finally:
        schema.extract = own
    assert made[0].filter("tag is null and text <> ' '").count() == 0 and made[0].filter("tag = 'b'").count() > 0
