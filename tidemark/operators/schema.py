"""Records from pages: selectors as structural joins, schema extraction, induction of schemas, healing of selectors.

A selector is compiled to one flag column over the node rows of :mod:`tidemark.sources.nodes`: a compound is a predicate on
tag and attributes, and each combinator a window over the tour (an open ancestor, the parent, earlier siblings). What lies
in which record is found by running counts over the tour, whatever the nesting; no pairs of nodes are made.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.operators.structure import HEADINGS, in_page
from tidemark.scratch import written

# Selectors --------------------------------------------------------------------------------------------------

_PART = re.compile(r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<q>["']?)(?P<val>[^"'\]]*)(?P=q)\s*)?\]|:(?P<nth>first-child|last-child|nth-child\(\d+\)|nth-of-type\(\d+\))""")
_OUT = r"(?![^\[]*\])"  # not within brackets
_STEP = re.compile(rf"\s*([>+~])\s*{_OUT}|\s+{_OUT}")


def _classes() -> Column:
    return F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+")


def _compound(text: str) -> Column:
    """The predicate of one compound selector. Positions among siblings are the columns of :func:`sibling_places`."""
    tests, at = [F.col("tag").isNotNull()], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"not a selector: {text!r}")
        at, g = m.end(), m.groupdict()
        if g["tag"] and g["tag"] != "*":
            tests.append(F.col("tag") == g["tag"].lower())
        if g["cls"]:
            tests.append(F.array_contains(_classes(), g["cls"]))
        if g["id"]:
            tests.append(F.coalesce(F.col("attrs")["id"], F.lit("")) == g["id"])
        if g["attr"]:
            v = F.col("attrs")[g["attr"].lower()]
            op, want = g["op"], g["val"] or ""
            same = {None: v.isNotNull(), "=": v == want, "^=": v.startswith(want), "$=": v.endswith(want), "*=": v.contains(want), "~=": F.array_contains(F.split(v, r"\s+"), want), "|=": (v == want) | v.startswith(f"{want}-")}[op]
            tests.append(F.coalesce(same, F.lit(False)) if op is None or want else F.coalesce(v == want, F.lit(False)) if op == "=" else F.lit(False))
        if g["nth"]:
            n = re.search(r"\d+", g["nth"])
            kind = g["nth"].split("(")[0]
            tests.append({"first-child": F.col("_nth") == 1, "last-child": F.col("_left") == 1}.get(kind, (F.col("_nth") if kind == "nth-child" else F.col("_kind_nth")) == int(n[0]) if n else None))
    return reduce(lambda a, b: a & b, tests)


def sibling_places(nodes: DataFrame) -> DataFrame:
    """Element rows with their place among siblings, from either end, and among those of their tag."""
    return _placed(nodes.filter("tag is not null"))


def _placed(rows: DataFrame) -> DataFrame:
    """As :func:`sibling_places`; text rows stay and count for nothing."""
    w = Window.partitionBy("id", "parent", F.col("tag").isNull())
    return rows.withColumns({
        "_nth": F.row_number().over(w.orderBy("enter")), "_left": F.row_number().over(w.orderBy(F.desc("enter"))), "_kind_nth": F.row_number().over(Window.partitionBy("id", "parent", "tag").orderBy("enter")),
    })


def marked(elements: DataFrame, selector: str, out: str) -> DataFrame:
    """``elements`` with ``out``: whether the selector matches. Text rows among them match nothing and are no siblings."""
    done = []
    for k, one in enumerate(re.split(f",{_OUT}", selector)):
        steps = _STEP.split(one.strip())
        name = f"{out}_{k}"
        elements = elements.withColumn(name, _compound(steps[0]))
        for how, step in zip(steps[1::2], steps[2::2], strict=True):
            before = Window.unboundedPreceding, -1
            mates = Window.partitionBy("id", "parent", F.col("tag").isNull()).orderBy("enter")
            if how is None:
                ok = F.coalesce(F.max(F.when(F.col(name), F.col("leave"))).over(in_page("enter").rowsBetween(*before)), F.lit(-1)) > F.col("enter")
            elif how == ">":  # the parent's flag reaches its children with them
                family = Window.partitionBy("id", "_family").orderBy("enter").rowsBetween(Window.unboundedPreceding, Window.currentRow)
                both = elements.select("*", F.explode(F.array(F.struct(F.col("enter").alias("_family"), F.lit(True).alias("_head")), F.struct(F.col("parent").alias("_family"), F.lit(False).alias("_head")))).alias("_f")).select("*", "_f.*").drop("_f")
                held = F.first(F.when(F.col("_head"), F.col(name)), ignorenulls=True).over(family)
                elements = both.withColumn("_held", F.coalesce(held, F.lit(False))).filter("not _head").drop("_family", "_head")
                ok = F.col("_held")
            elif how == "+":
                ok = F.coalesce(F.lag(name).over(mates), F.lit(False))
            else:
                ok = F.coalesce(F.max(name).over(mates.rowsBetween(*before)), F.lit(False))
            elements = elements.withColumn("_ok", ok).withColumn(name, F.col("_ok") & _compound(step)).drop("_ok", "_held")
        done.append(name)
    return elements.withColumn(out, reduce(lambda a, b: a | b, [F.col(c) for c in done])).drop(*done)


def holders(bases: DataFrame, points: DataFrame, nearest: bool = False) -> DataFrame:
    """``points`` (id, enter, ...) with ``at``: the ``enter`` of a base (id, enter, leave) around it, a row for each.

    At a point as many bases are open as were opened less closed before it; on each level that is the last one opened.
    ``nearest``: only the innermost.
    """
    extra = [c for c in points.columns if c not in ("id", "enter")]
    blank = F.lit(None)
    ends = bases.select("id", F.explode(F.array(F.struct(F.col("enter").alias("pos"), F.lit(1).alias("turn")), F.struct(F.col("leave").alias("pos"), F.lit(-1).alias("turn")))).alias("e")).select("id", "e.pos", "e.turn")
    here = points.select("id", F.col("enter").alias("pos"), F.lit(0).alias("turn"), F.struct("enter", *extra).alias("point"))
    kind = here.schema["point"].dataType
    tour = ends.withColumn("point", blank.cast(kind)).unionByName(here)
    # a base that is a point too does not hold itself: points come first
    w = Window.partitionBy("id").orderBy("pos", F.abs("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tour = tour.withColumn("open", F.sum("turn").over(w)).filter("turn >= 0 and open > 0")
    level = F.when(F.col("turn") == 1, F.array("open")).otherwise(F.array("open") if nearest else F.sequence(F.lit(1).cast("long"), F.col("open")))
    tour = tour.withColumn("level", F.explode(level))
    of_level = Window.partitionBy("id", "level").orderBy("pos", F.abs("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tour.withColumn("at", F.last(F.when(F.col("turn") == 1, F.col("pos")), ignorenulls=True).over(of_level)).filter("turn = 0").select("id", "at", "point.*")


def texts_of(nodes: DataFrame, elements: DataFrame, out: str = "said") -> DataFrame:
    """(id, enter, ``out``): the text below each element (id, enter, leave), in order, not yet collapsed."""
    texts = nodes.filter("tag is null").select("id", "enter", "text")
    inner = holders(elements.select("id", "enter", "leave").distinct(), texts)
    parts = F.array_sort(F.collect_list(F.struct("enter", "text")))
    return inner.groupBy("id", "at").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias(out)).withColumnRenamed("at", "enter").hint("merge")


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s\x{85}\x{a0}]+", " "))


def _marks() -> tuple[Column, Column, Column]:
    """How a node is written out: its start tag, its text, and its end tag, each if any."""
    from tidemark.sources.nodes import VOID

    def escaped(x: Column, quote: bool) -> Column:
        x = F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("\u00a0"), F.lit("&nbsp;"))
        return F.replace(x, F.lit('"'), F.lit("&quot;")) if quote else F.replace(F.replace(x, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    named = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escaped(e["value"], True), F.lit('"'))), "")
    start = F.when(F.col("tag").isNotNull(), F.concat(F.lit("<"), "tag", named, F.lit(">")))
    return start, escaped(F.col("text"), False), F.when(~F.col("tag").isin(*sorted(VOID)), F.concat(F.lit("</"), "tag", F.lit(">")))


# Extraction -------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """A column of a record. ``kind``: text, html, attribute, exists, number, list or nested."""

    name: str
    selector: str | None = None
    kind: str = "text"
    attribute: str | None = None
    absolute: bool = False
    regex: str | None = None
    default: object = None
    fields: list[Field] = field(default_factory=list)


def joined_urls(base: Column, links: Column) -> Column:
    """The links of each row resolved against its page's address."""

    @F.pandas_udf("array<string>")
    def join(bases: pd.Series, links: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        def one(b, u):
            try:
                return urljoin(b, u.strip()) if b else u
            except ValueError:
                return u

        return pd.Series([[one(b, u) for u in row] for b, row in zip(bases, links, strict=True)], dtype=object)

    return join(base, links)


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once however often it is named."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _selectors(fields: list[Field], name: str) -> list[tuple[str, str]]:
    """(flag, selector) of the fields that have one, nested ones too. The flag of field k of ``name`` is ``name`` with ``nk``."""
    return [x for k, f in enumerate(fields) for x in [*([(f"{name}n{k}", f.selector)] if f.selector else []), *_selectors(f.fields, f"{name}n{k}")]]


def _all(fields: list[Field]) -> list[Field]:
    """The fields, nested ones too."""
    return [x for f in fields for x in [f, *_all(f.fields)]]


#: The columns of the node rows that :func:`extract` reads.
READ = ("enter", "leave", "inside", "parent", "tag", "attrs", "text")


def extract(nodes: DataFrame, base: str, fields: list[Field], urls: DataFrame | None = None) -> DataFrame:
    """(id, item, a column for each field): one row for each match of the base selector, in page order.

    Text, html, attribute and number take the first match inside the record, else the default; list takes all; nested gives
    an array of records of its own fields; a field without a selector reads the record itself. ``urls`` (id, url) resolves
    ``absolute`` links. Beside a field called id or item the page's own column is ``page_id`` or ``page_item``.

    The node rows are shuffled once, by page. Selectors are windows within pages; then the rows of an outermost record are
    gathered into one array in page order, where what lies inside an element is the stretch after it. Fields are cut from that.
    ``nodes`` may be ``folded``, which makes fewer rows of the same records.
    """
    todo = [("_base", base), *_selectors(fields, "_f")]
    wanted = sorted({f.attribute or "" for f in _all(fields) if f.kind == "attribute"})
    rows = nodes.select("id", *READ).repartition("id")
    if any(":" in re.sub(r"\[[^\]]*\]", "", x) for _, x in todo):
        rows = _placed(rows)
    for flag, selector in sorted(todo, key=lambda x: _first_step(x[1])):
        rows = marked(rows, selector, flag)
    so_far = in_page("enter").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # of the bases opened so far the outermost one around a row closes last: its ``leave`` names the group
    rows = rows.withColumns({"_row": F.row_number().over(in_page("enter")), "_item": F.sum(F.when(F.col("_base"), 1)).over(so_far) - 1, "_held": F.max(F.when(F.col("_base"), F.col("leave"))).over(so_far)})
    rows = rows.filter(F.col("_held") > F.col("enter"))
    columns = [F.col("_row"), F.col("inside"), F.col("text"), F.col("_item"), *[F.col(flag) for flag, _ in todo], *[F.col("attrs")[a].alias(f"_a{k}") for k, a in enumerate(wanted)]]
    if any(f.kind == "html" for f in _all(fields)):
        start, said, end = _marks()
        columns += [said.alias("_said"), F.struct(F.col("enter").alias("pos"), F.concat_ws("", start, said).alias("mark")).alias("_start"), F.struct(F.col("leave").alias("pos"), end.alias("mark")).alias("_end")]
    groups = rows.groupBy("id", "_held").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("n"))
    each = F.transform(F.filter("n", lambda x: x["_base"]), lambda x: F.struct(x.alias("_x"), _inside(F.col("n"), x).alias("_sub")))
    records = groups.select("id", F.explode(each).alias("r")).select("id", "r._x", "r._sub")
    x, sub, at = F.col("_x"), F.col("_sub"), None
    if any(f.absolute for f in _all(fields)):
        if urls is not None:
            records = records.join(urls.select("id", F.col("url").alias("_url")), "id", "left")
        else:
            records = records.withColumn("_url", F.lit(None).cast("string"))
        records = records.withColumn("_links", F.array_distinct(F.array_compact(_links(fields, "_f", wanted, sub, x))))
        records = records.withColumn("_at", F.map_from_arrays("_links", joined_urls(F.col("_url"), F.col("_links"))))
        at = F.col("_at")
    names = [f.name for f in fields]
    page = [c.alias(f"page_{n}" if n in names else n) for c, n in ((F.col("id"), "id"), (F.col("_x._item").cast("int"), "item"))]
    return records.select(*page, *[_taken(f, f"_fn{k}", wanted, sub, x, at).alias(f.name) for k, f in enumerate(fields)])


def _first_step(selector: str) -> int:
    """Selectors that begin with siblings are marked first and those of ancestors last: these need the page order, which
    stays for what follows."""
    how = [_STEP.split(one.strip())[1:2] for one in re.split(f",{_OUT}", selector)]
    return min(2 if h in ([], [None]) else 1 if h == [">"] else 0 for h in how)


def _inside(nodes: Column, x: Column) -> Column:
    """What lies inside node ``x`` of ``nodes``: the rows of a stretch of a page, none left out."""
    return F.slice(nodes, x["_row"] - F.get(nodes, F.lit(0))["_row"] + 2, x["inside"])


def _raw(f: Field, wanted: list[str], own: Column, x: Column) -> Column:
    """What the node ``x`` with ``own`` inside it gives, before links are resolved."""
    if f.kind == "attribute":
        return x[f"_a{wanted.index(f.attribute or '')}"]
    if f.kind == "html":
        marks = F.filter(F.flatten(F.transform(own, lambda n: F.array(n["_start"], n["_end"]))), lambda m: m["mark"].isNotNull())
        return F.array_join(F.concat(F.array(x["_said"]), F.array_sort(marks)["mark"]), "")
    return collapsed(F.array_join(F.concat(F.array(x["text"]), own["text"]), ""))


def _read(f: Field, wanted: list[str], own: Column, x: Column, at: Column | None) -> Column:
    """The value of a matched node: null where the pattern doesn't match or the attribute is missing."""
    raw = _raw(f, wanted, own, x)
    if f.absolute:
        raw = _let(raw, lambda v: at[v])
    if f.regex:
        group = 1 if re.compile(f.regex).groups else 0
        raw = _let(raw, lambda v: F.when(v.rlike(f.regex), F.regexp_extract(v, f.regex, group)))
    return F.trim(raw)


def _hits(flag: str, sub: Column) -> Column:
    return F.filter(sub, lambda n: n[flag])


def _taken(f: Field, flag: str, wanted: list[str], sub: Column, x: Column, at: Column | None) -> Column:
    """The field of the record ``x`` with ``sub`` inside it."""
    if f.kind == "exists":
        return F.exists(sub, lambda n: n[flag]) if f.selector else F.lit(True)
    if f.kind == "nested":

        def one(own: Column, h: Column) -> Column:
            return F.struct(*[_taken(g, f"{flag}n{k}", wanted, own, h, at).alias(g.name) for k, g in enumerate(f.fields)])
    else:

        def one(own: Column, h: Column) -> Column:
            return _read(f, wanted, own, h, at)

    if f.kind in ("list", "nested"):
        if f.selector:
            return F.transform(_hits(flag, sub), lambda h: _let(_inside(sub, h), lambda own: one(own, h)))
        return F.array(one(sub, x)) if f.kind == "list" else one(sub, x)
    v = F.get(F.transform(F.slice(_hits(flag, sub), 1, 1), lambda h: one(_inside(sub, h), h)), F.lit(0)) if f.selector else one(sub, x)
    v = _let(T.number_signs(v), T.signs_number) if f.kind == "number" else v
    return v if f.default is None else F.coalesce(v, F.lit(f.default))


def _links(fields: list[Field], name: str, wanted: list[str], sub: Column, x: Column) -> Column:
    """All that ``absolute`` fields of the record read, nested ones too."""
    def of(f: Field, flag: str) -> Column:
        def one(own: Column, h: Column) -> Column:
            return _links(f.fields, flag, wanted, own, h) if f.kind == "nested" else F.array(_raw(f, wanted, own, h))

        return F.flatten(F.transform(_hits(flag, sub), lambda h: _let(_inside(sub, h), lambda own: one(own, h)))) if f.selector else one(sub, x)

    found = [of(f, f"{name}n{k}") for k, f in enumerate(fields) if f.absolute or any(g.absolute for g in _all(f.fields))]
    return F.concat(*found)


# Induction --------------------------------------------------------------------------------------------------

# Class tokens that name a state or a layout, not a thing.
NOISE = ["active", "selected", "current", "open", "closed", "hover", "focus", "first", "last", "odd", "even", "hidden", "show", "visible", "col", "row", "container", "wrapper", "inner", "outer"]
LEAST_RECORDS, LEAST_TEXT, PRESENCE, MARGIN, MOST_FIELDS = 3, 20, 0.75, 0.15, 8
MONEY = r"(?s)^(?=.*([$€£¥]|(?i:EUR|USD))).*[0-9]"


def stable_classes() -> Column:
    return F.filter(_classes(), lambda c: (F.length(c) >= 3) & (F.length(c) <= 40) & ~c.isin(*NOISE) & c.rlike(r"^[A-Za-z_-]+$"))


def _selector(tag: Column, classes: Column) -> Column:
    return F.concat_ws(".", F.concat(F.array(tag), classes))


def induce(nodes: DataFrame) -> DataFrame:
    """(id, base_selector, matched, margin, fields): the record set that a page repeats, and what its records share.

    Children of one parent with one tag and the same stable classes are a set; of sets of three or more with 20 bytes of text
    each the one of most records and text wins, if it leads the next by 15%. A slot that three records in four fill is a
    field: ``fields`` is an array of name, selector, kind and attribute, in the order they first come. Pages without a clear
    answer have no row.
    """
    kinds = nodes.filter("tag is not null").withColumn("classes", stable_classes()).select("id", "enter", "leave", "parent", "tag", "attrs", "classes")
    kinds = written(kinds, "induce-elements")
    alike = kinds.filter("size(classes) > 0").withColumn("sign", _selector(F.col("tag"), F.array_sort("classes")))
    w = Window.partitionBy("id", "parent", "sign")
    sets = alike.withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("n") >= LEAST_RECORDS)
    sets = written(sets.join(texts_of(nodes, sets), ["id", "enter"], "left").withColumn("bytes", F.octet_length(collapsed(F.col("said")))), "induce-sets")
    ranked = sets.groupBy("id", "parent", "sign").agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bytes"), F.min(F.struct("enter", "classes", "tag")).alias("f"))
    ranked = ranked.filter(F.floor(F.col("bytes") / F.col("members")) >= LEAST_TEXT).withColumn("score", F.sqrt("members") * F.sqrt("bytes"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "f.enter")
    ranked = ranked.withColumn("next", F.coalesce(F.lead("score").over(order), F.lit(0.0))).withColumn("r", F.row_number().over(order)).filter("r = 1 and score > 0")
    best = ranked.withColumn("margin", (F.col("score") - F.col("next")) / F.col("score")).filter(F.col("margin") >= MARGIN)
    best = written(best.select("id", "margin", F.col("f.tag").alias("btag"), F.col("f.classes").alias("bclasses"), _selector(F.col("f.tag"), F.col("f.classes")).alias("base_selector")), "induce-best")
    every = F.col("tag") == F.col("btag")
    records = kinds.join(best, "id").filter(every & (F.size(F.array_except("bclasses", _classes())) == 0)).select("id", "enter", "leave", "base_selector")
    matched = records.groupBy("id").agg(F.count(F.lit(1)).alias("matched")).filter(F.col("matched") >= LEAST_RECORDS)
    records = written(records.join(matched, "id"), "induce-records")
    slots = _slots(nodes, kinds, records)
    return best.join(matched, "id").join(slots, "id").select("id", "base_selector", "matched", "margin", "fields")


def _slots(nodes: DataFrame, kinds: DataFrame, records: DataFrame) -> DataFrame:
    """(id, fields) of record sets."""
    parts = written(holders(records.select("id", "enter", "leave"), kinds.select("id", "enter", "leave", "tag", "attrs", "classes")), "induce-parts")
    itself = records.select("id", F.col("enter").alias("at"), "enter", "leave").join(kinds.select("id", "enter", "tag", "attrs", "classes"), ["id", "enter"])
    # the nearest element with classes around each, inside the record or the record itself
    signed = parts.select("id", "enter", "leave", "tag", "classes").unionByName(itself.select("id", "enter", "leave", "tag", "classes")).filter("size(classes) > 0").distinct()
    over = holders(signed.select("id", "enter", "leave"), parts.select("id", "enter").distinct(), nearest=True).select("id", "enter", F.col("at").alias("over"))
    around = signed.select("id", F.col("enter").alias("over"), _selector(F.col("tag"), F.col("classes")).alias("around"))
    held = parts.join(over, ["id", "enter"], "left").join(around, ["id", "over"], "left").join(records.select("id", "base_selector", "matched").distinct(), "id")
    outer = F.when(F.col("over") >= F.col("at"), F.col("around"))  # not beyond the record
    slot = F.when(F.size("classes") > 0, _selector(F.col("tag"), F.col("classes"))).when(outer.isNull() | (outer == F.col("base_selector")), F.col("tag")).otherwise(F.concat_ws(" ", outer, F.col("tag")))
    held = held.withColumn("slot", slot).filter(F.col("slot") != F.col("base_selector"))
    first = F.row_number().over(Window.partitionBy("id", "at", "slot").orderBy("enter"))
    held = written(held.withColumn("r", first).filter("r = 1").drop("r"), "induce-slots")
    held = held.join(texts_of(nodes, held.select("id", "enter", "leave")), ["id", "enter"], "left").withColumn("said", collapsed(F.col("said")))

    def count(test: Column, name: str) -> Column:
        return F.sum(F.when(test, 1).otherwise(0)).alias(name)

    per = held.groupBy("id", "slot", "matched").agg(
        F.min(F.struct("at", "enter")).alias("place"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("said")).alias("bytes"), count(F.col("attrs")["href"].isNotNull(), "href"),
        count(F.col("attrs")["src"].isNotNull(), "src"), count(F.col("tag").isin(*HEADINGS), "heading"), count((F.col("tag") == "time") | F.col("attrs")["datetime"].isNotNull(), "time"),
        count(F.col("said").rlike(MONEY), "money"),
    )
    mean = F.floor(F.col("bytes") / F.col("n"))
    per = per.filter((F.col("n") >= F.ceil(F.col("matched") * PRESENCE)) & ~((mean == 0) & (F.col("href") == 0) & (F.col("src") == 0))).withColumn("mean", mean)

    def mostly(c: str) -> Column:
        return F.col(c) * 2 >= F.col("n")

    last = F.element_at(F.split("slot", r"\."), -1)
    borrowed = F.when((last != F.col("slot")) & (F.length(last) >= 3), F.replace(last, F.lit("-"), F.lit("_"))).otherwise("text")
    name = F.when(mostly("href"), "url").when(mostly("src"), "image").when(mostly("heading"), "title").when(mostly("time"), "date").when(mostly("money"), "price").when(F.col("mean") > 120, "summary").otherwise(borrowed)
    per = per.withColumn("base", name)
    same = Window.partitionBy("id", "base")
    per = per.withColumn("won", F.row_number().over(same.orderBy(F.desc("mean"), "place")) == 1)
    turn = F.sum(F.when(~F.col("won"), 1).otherwise(0)).over(same.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1
    per = per.withColumn("name", F.when(F.col("won"), F.col("base")).otherwise(F.concat_ws("_", "base", turn.cast("string"))))
    per = per.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("place"))).filter(F.col("r") <= MOST_FIELDS)
    attribute = F.when(mostly("href"), "href").when(mostly("src"), "src")
    one = F.struct("r", "name", F.col("slot").alias("selector"), F.when(attribute.isNotNull(), "attribute").otherwise("text").alias("kind"), attribute.alias("attribute"))
    return per.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("r")).alias("fields"))


# Healing ----------------------------------------------------------------------------------------------------

ACCEPT, LEAD, ANCESTORS = 0.6, 0.15, 6


def prints(nodes: DataFrame) -> DataFrame:
    """(id, enter, tag, name, classes, keys, bucket, tenths, depth, above) of every element: what it looks like."""
    texts = texts_of(nodes, nodes.filter("tag is not null"))
    own = nodes.filter("tag is not null")
    said = F.trim(F.regexp_replace(F.coalesce("said", F.lit("")), r"^\s+|\s+$", ""))
    chars = F.length(said)
    digits = F.length(F.regexp_replace(said, "[^0-9]", ""))
    tags = own.select("id", F.col("enter").alias("up1"), F.col("tag").alias("t"))
    line = own.select("id", "enter", F.posexplode("up").alias("k", "up1"))
    named = line.join(tags, ["id", "up1"]).groupBy("id", "enter").agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("l"))
    named = named.select("id", "enter", F.transform("l", lambda x: x["t"]).alias("above")).hint("merge")  # as many rows as elements: not for the driver
    out = own.join(texts, ["id", "enter"], "left").join(named, ["id", "enter"], "left")
    classes = F.array_sort(F.array_distinct(F.filter(_classes(), lambda c: c != "")))
    keys = F.array_sort(F.filter(F.map_keys("attrs"), lambda k: ~k.isin("id", "class")))
    return out.select(
        "id", "enter", "tag", F.col("attrs")["id"].alias("name"), classes.alias("classes"), keys.alias("keys"), F.when(chars == 0, 0).otherwise(F.floor(F.log2(chars + 0.5)) + 1).cast("int").alias("bucket"),
        F.when(chars == 0, 0).otherwise(F.floor(digits * 10 / chars)).cast("int").alias("tenths"), (F.col("depth") + 1).alias("depth"), F.coalesce("above", F.array().cast("array<string>")).alias("above"),
    )


def similarity(a: str, b: str) -> Column:
    """How much element ``b`` looks like what ``a`` remembers, 0 to 1."""
    def x(n: str) -> Column:
        return F.col(f"{a}.{n}")

    def y(n: str) -> Column:
        return F.col(f"{b}.{n}")

    def both(n: str) -> Column:
        shared = F.size(F.array_intersect(x(n), y(n)))
        return F.when((F.size(x(n)) == 0) & (F.size(y(n)) == 0), 1.0).otherwise(shared / (F.size(x(n)) + F.size(y(n)) - shared))

    def near(n: str, most: int) -> Column:
        return 1.0 - F.least(F.abs(x(n) - y(n)), F.lit(most)) / most

    tag = F.when(x("tag") == y("tag"), 0.25).when(x("tag").isin(*HEADINGS) & y("tag").isin(*HEADINGS), 0.15).otherwise(0.0)
    name = F.when(x("name") == y("name"), 0.15).otherwise(0.0)
    classes = F.when((F.size(x("classes")) == 0) & (F.size(y("classes")) == 0), 0.10).otherwise(0.20 * both("classes"))
    above = F.size(F.filter(x("above"), lambda t: F.array_contains(y("above"), t))) / F.greatest(F.size(x("above")), F.size(y("above")), F.lit(1))
    return tag + name + classes + 0.05 * both("keys") + 0.10 * near("bucket", 4) + 0.05 * near("tenths", 5) + 0.15 * above + 0.05 * near("depth", 6)


def _features(row: str) -> Column:
    """What two elements must share one of to come near the bar: without, they reach 0.40 and not 0.45."""
    def c(n: str) -> Column:
        return F.col(f"{row}.{n}")

    tag = F.when(c("tag").isin(*HEADINGS), "h").otherwise(c("tag"))
    return F.concat(F.array(F.concat(F.lit("t:"), tag)), F.transform(c("classes"), lambda k: F.concat(F.lit("c:"), k)), F.when(F.size(c("classes")) == 0, F.array(F.lit("c:"))).otherwise(F.array()), F.when(c("name").isNotNull(), F.array(F.concat(F.lit("n:"), c("name")))).otherwise(F.array()))


def heal(remembered: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, slot, enter, score): where on the page of the same id each remembered element (id, slot and the columns of
    :func:`prints`) is now, if the best match reaches 0.6 and leads the next by 0.15.

    Elements of the same tag and classes as the best are its twins and no rivals. Pairs that share no tag, class or name can
    neither win nor come within the lead of a winner, so an inverted index on those finds all that count.
    """
    seen = written(prints(nodes), "heal-prints")
    old, new = remembered.alias("a"), seen.alias("b")
    left = old.select("a.id", "a.slot", F.explode(F.array_distinct(_features("a"))).alias("f"))
    right = new.select("b.id", "b.enter", F.explode(F.array_distinct(_features("b"))).alias("f"))
    pairs = left.join(right, ["id", "f"]).select("id", "slot", "enter").distinct()
    full = pairs.hint("merge").join(remembered.select("id", "slot", F.struct(*[c for c in remembered.columns if c not in ("id", "slot", "enter")]).alias("a")), ["id", "slot"])
    full = full.hint("merge").join(seen.select("id", "enter", F.struct(*[c for c in seen.columns if c not in ("id", "enter")]).alias("b")), ["id", "enter"])
    scored = full.select("id", "slot", "enter", similarity("a", "b").alias("score"), F.coalesce(F.concat(F.lit("#"), F.col("b.name")), _selector(F.col("b.tag"), F.col("b.classes"))).alias("shape"))
    per = Window.partitionBy("id", "slot")
    best = F.first("shape").over(per.orderBy(F.desc("score"), "enter"))
    scored = scored.withColumn("best", best)
    rival = F.max(F.when(F.col("shape") != F.col("best"), F.col("score"))).over(per)
    top = F.row_number().over(per.orderBy(F.desc("score"), "enter"))
    won = scored.withColumn("rival", F.coalesce(rival, F.lit(0.0))).withColumn("r", top).filter("r = 1")
    lead = F.col("score") - F.col("rival")
    return won.filter((F.col("score") >= ACCEPT) & (lead >= LEAD)).select("id", "slot", "enter", "score")
