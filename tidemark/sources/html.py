"""HTML pages to columns: one pass over the markup per page gives text, markdown, links, tables and metadata.

The pass is a small event handler; Spark partitions the pages, and everything further (same-site links,
rankings, table rows, site statistics) is expressed over the struct's columns.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.nodes import ended_refs, fed

SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "canvas", "object", "embed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}
CHROME = {"nav", "header", "footer", "aside", "form"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$)|font-size\s*:\s*0", re.I)
INVISIBLE = re.compile("[​-‏‪-‮⁠-⁤﻿­]")
SPACE = re.compile(r"\s+")

_TABLES = "tables:array<struct<caption:string,header:array<string>,rows:array<array<string>>>>"
TABLES = f"struct<{_TABLES}>"
PARTS = (
    "struct<title:string,text:string,main_text:string,markdown:string,lang:string,canonical:string,meta:map<string,string>,json_ld:array<string>,json_ld_truncated:boolean,feeds:array<string>,"
    "links:array<struct<url:string,text:string,nofollow:boolean>>,media:array<struct<src:string,alt:string>>,headings:array<struct<level:int,text:string>>,"
    f"{_TABLES},paragraphs:int,blocks:array<struct<text:string,linked:double>>>"
)


#: Tags that end an open one of their kind.
ENDING = {"p", "li", "td", "th", "tr", "option"}


def _is_gone(a: dict) -> bool:
    return "hidden" in a or a.get("aria-hidden") == "true" or bool(HIDDEN.search(a.get("style", "")))


def _span(value: str | None, most: int) -> int:
    return max(1, min(most, int(value))) if value and value.isdecimal() else 1


class _Table:
    """Cells of one table as they come: [text parts, is header, columns, rows]."""

    def __init__(self, role: str):
        self.role, self.rows, self.head, self.caption, self.nested = role, [], None, None, False

    def data(self) -> dict | None:
        """{caption, header, rows}, spans filled in; None where the table lays out a page.

        Layout: another table inside, a presentational role, one column, a single row without header cells, or
        unlabelled cells of over 200 bytes on average. The header is the last row of ``thead``, else a first row of
        header cells only. Rows and columns without text go, and columns that repeat an earlier one.
        """
        at = {}
        for r, cells in enumerate(self.rows):
            c = 0
            for parts, _, wide, high in cells:
                while (r, c) in at:
                    c += 1
                text = " ".join("".join(parts).split())
                for y in range(r, min(r + high, len(self.rows))):
                    for x in range(c, c + wide):
                        at[y, x] = text
                c += wide
        width = 1 + max((x for _, x in at), default=-1)
        labelled = self.role in ("table", "grid") or self.caption is not None or any(cell[1] for r in self.rows for cell in r)
        single = len(self.rows) < 2 and not any(cell[1] for r in self.rows for cell in r)
        prose = not labelled and sum(len(t.encode()) for t in at.values()) > 200 * len(at)
        if self.nested or self.role in ("presentation", "none") or width < 2 or single or prose:
            return None
        grid = [[at.get((r, c), "") for c in range(width)] for r in range(len(self.rows))]
        head = self.head
        if head is None and self.rows[0] and all(cell[1] for cell in self.rows[0]):
            head = 0
        header = [""] * width if head is None else grid.pop(head)
        grid = [row for row in grid if any(row)]
        columns = list(dict.fromkeys((h, *col) for h, col in zip(header, zip(*grid), strict=True) if any(col))) if grid else []
        if not columns:
            return None
        return {"caption": self.caption, "header": [c[0] for c in columns], "rows": [list(r) for r in zip(*(c[1:] for c in columns), strict=True)]}


#: Bounds of what is read of a page's linked data; ``json_ld_truncated`` says that there was more.
LD_BLOBS, LD_BYTES = 20, 256 * 1024


def _ld_items(blob: str) -> list[str]:
    """The objects of a JSON-LD blob as JSON: lists and ``@graph`` unwrapped; what stands beside
    a ``@graph`` comes after it, without its ``@`` keys but ``@type``."""
    if len(blob) > LD_BYTES:
        return []
    try:
        todo = [json.loads(blob)]
    except ValueError:
        return []
    out = []
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo = x + todo
        elif isinstance(x, dict) and "@graph" in x:
            beside = {k: v for k, v in x.items() if not k.startswith("@") or k == "@type"}
            todo = [x["@graph"], *([beside] if beside else []), *todo]
        elif isinstance(x, dict):
            out.append(json.dumps(x, ensure_ascii=False))
    return out


class _Page(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.stack = base, []  # open elements as (tag, hidden)
        self.text, self.main, self.md, self.title = [], [], [], None
        self.links, self.media, self.headings, self.tables, self.feeds, self.json_ld = [], [], [], [], [], []
        self.meta: dict[str, str] = {}
        self.lang = self.canonical = None
        self.paragraphs = self.skip = self.hidden = self.chrome = 0
        self.anchor = self.heading = self.cell = self.ld = self.caption = None
        self.open_tables: list[_Table] = []
        self.blocks, self.block, self.linked = [], [], 0
        self.in_title = self.ld_cut = False

    def _url(self, href: str | None) -> str | None:
        href = (href or "").strip()
        if not href or href.startswith("#"):
            return None
        try:
            full = urljoin(self.base, href)
            return full.split("#", 1)[0] if urlsplit(full).scheme in ("http", "https") else None
        except ValueError:
            return None

    def _break(self) -> None:
        for out in (self.text, self.main, self.md):
            out.append("\n")

    def _end_block(self) -> None:
        text = SPACE.sub(" ", "".join(self.block)).strip()
        if text:
            self.blocks.append((text, min(1.0, self.linked / len(text))))
        self.block, self.linked = [], 0

    def _end_alike(self, tag) -> None:
        """An open one of its kind ends here."""
        for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 4), -1):
            if self.stack[i][0] == tag:
                self.handle_endtag(tag)
                break
            if self.stack[i][0] in ("table", "ul", "ol"):
                break

    def _closed(self, tag) -> list:
        """What the end tag closes, the innermost first, taken from the stack."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                closed = self.stack[i:]
                del self.stack[i:]
                return closed[::-1]
        return []

    def _unseen(self) -> bool:
        return bool(self.skip or self.hidden) or "head" in [t for t, _ in self.stack[:3]]

    def _in_table(self, tag, a) -> None:
        if tag == "table":
            for outer in self.open_tables[-1:]:
                outer.nested = True
            self.open_tables.append(_Table(a.get("role", "").lower()))
            self.cell = None
        if self.open_tables:
            t = self.open_tables[-1]
            if tag == "caption":
                self.caption = []
            if tag == "tr":
                t.rows.append([])
                if any(x == "thead" for x, _ in self.stack):
                    t.head = len(t.rows) - 1
            if tag in ("td", "th"):
                if not t.rows:
                    t.rows.append([])
                self.cell = []
                t.rows[-1].append([self.cell, tag == "th", _span(a.get("colspan"), 32), _span(a.get("rowspan"), 64)])

    def _table_end(self, tag) -> None:
        if tag == "caption":
            if self.caption is not None and self.open_tables:
                self.open_tables[-1].caption = SPACE.sub(" ", "".join(self.caption)).strip() or None
                self.caption = None
        elif tag == "table":
            if self.open_tables:
                data = self.open_tables.pop().data()
                if data:
                    self.tables.append(data)
        else:
            self.cell = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang") or self.lang
        if tag == "meta" and (a.get("property") or a.get("name")) and "content" in a:
            self.meta.setdefault((a.get("property") or a["name"]).lower(), a["content"])
        if tag == "link":
            rel = a.get("rel", "").lower()
            if rel == "canonical":
                self.canonical = self.canonical or self._url(a.get("href"))
            if "alternate" in rel and re.search("rss|atom", a.get("type", "")) and self._url(a.get("href")):
                self.feeds.append(self._url(a.get("href")))
        if tag == "script" and "ld+json" in a.get("type", ""):
            self.ld = []
        if tag in ENDING:
            self._end_alike(tag)
        if tag == "img" and not self.skip:
            src = self._url(a.get("src") or a.get("data-src"))
            if src:
                self.media.append((src, a.get("alt", "")))
                if a.get("alt"):
                    self.md.append(f"![{a['alt']}]({src})")
        if tag in BLOCK or tag == "br":
            self._break()
        if tag in BLOCK:
            self._end_block()
        if tag in VOID:
            return
        gone = _is_gone(a)
        self.stack.append((tag, gone))
        self.skip += tag in SKIP
        self.hidden += gone
        self.chrome += tag in CHROME
        if tag == "title" and self.title is None:
            self.in_title, self.title = True, ""
        if tag == "p":
            self.paragraphs += 1
        if tag == "a" and self.anchor is None:
            self.anchor = [a.get("href"), "nofollow" in a.get("rel", ""), []]
        if re.fullmatch("h[1-6]", tag):
            self.heading = [int(tag[1]), []]
            self.md.append("#" * int(tag[1]) + " ")
        if tag == "li":
            self.md.append("- ")
        if tag in ("b", "strong"):
            self.md.append("**")
        if tag == "table" or self.open_tables:
            self._in_table(tag, a)

    def handle_endtag(self, tag):
        for t, gone in self._closed(tag):
            self.skip -= t in SKIP
            self.hidden -= gone
            self.chrome -= t in CHROME
            if t == "title":
                self.in_title = False
            if t == "a" and self.anchor is not None:
                url, label = self._url(self.anchor[0]), SPACE.sub(" ", "".join(self.anchor[2])).strip()
                if url:
                    self.links.append((url, label, self.anchor[1]))
                self.anchor = None
            if re.fullmatch("h[1-6]", t) and self.heading is not None:
                self.headings.append((self.heading[0], SPACE.sub(" ", "".join(self.heading[1])).strip()))
                self.heading = None
            if t in ("b", "strong"):
                self.md.append("**")
            if t in ("td", "th", "caption", "table"):
                self._table_end(t)
            if t == "script" and self.ld is not None:
                blob = "".join(self.ld)
                self.json_ld += _ld_items(blob)
                self.ld_cut |= len(blob) > LD_BYTES or len(self.json_ld) > LD_BLOBS
                self.ld = None
            if t in BLOCK:
                self._break()
                self._end_block()

    def handle_data(self, data):
        if self.ld is not None:
            self.ld.append(data)
        if self.in_title:
            self.title += data
            return
        if self._unseen():
            return
        flat = SPACE.sub(" ", data)
        self.text.append(flat)
        self.md.append(flat)
        if not self.chrome:
            self.main.append(flat)
        self.block.append(flat)
        self.linked += len(flat.strip()) if self.anchor is not None else 0
        for sink in (self.anchor and self.anchor[2], self.heading and self.heading[1], self.cell, self.caption):
            if sink is not None:
                sink.append(data)


class _Tables(_Page):
    """Only the tables of a page, and of the rest what decides which text is in them."""

    def handle_starttag(self, tag, attrs):
        if tag in ENDING:
            self._end_alike(tag)
        if tag in VOID:
            return
        a = {k: v or "" for k, v in attrs} if attrs else {}
        gone = bool(attrs) and _is_gone(a)
        self.stack.append((tag, gone))
        self.skip += tag in SKIP
        self.hidden += gone
        if tag == "title" and self.title is None:
            self.in_title, self.title = True, ""
        if tag == "table" or self.open_tables:
            self._in_table(tag, a)

    def handle_cell(self, tag, attrs, data) -> bool:
        """A cell of text at its usual place, right in a row of a table, without its way over the stack."""
        stack = self.stack
        if len(stack) < 2 or stack[-1][0] != "tr" or not self.open_tables or self.in_title or self.caption is not None:
            return False
        if stack[-2][0] != "table" and (stack[-2][0] not in ("tbody", "thead", "tfoot") or len(stack) < 3 or stack[-3][0] != "table"):
            return False
        a = {k: v or "" for k, v in attrs} if attrs else {}
        seen = data and not (a and _is_gone(a)) and not self._unseen()
        rows = self.open_tables[-1].rows or self._first_row()
        rows[-1].append([[data] if seen else [], tag == "th", _span(a.get("colspan"), 32), _span(a.get("rowspan"), 64)])
        self.cell = None
        return True

    def _first_row(self) -> list:
        self.open_tables[-1].rows.append([])
        return self.open_tables[-1].rows

    def handle_endtag(self, tag):
        for t, gone in self._closed(tag):
            self.skip -= t in SKIP
            self.hidden -= gone
            if t == "title":
                self.in_title = False
            elif t in ("td", "th", "caption", "table"):
                self._table_end(t)

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif (self.cell is not None or self.caption is not None) and not self._unseen():
            for sink in (self.cell, self.caption):
                if sink is not None:
                    sink.append(data)


def _tidy(parts: list[str]) -> str:
    lines = [INVISIBLE.sub("", re.sub(" +", " ", x)).strip() for x in "".join(parts).split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()


def page_parts(html: str | None, url: str | None, bare_refs: bool = True) -> dict:
    p = _Page(url or "")
    html = html if bare_refs else ended_refs(html or "")
    fed(p, html or "")
    while p.stack:
        p.handle_endtag(p.stack[-1][0])
    p._end_block()
    title = SPACE.sub(" ", p.title or "").strip() or None
    return {
        "title": title, "text": _tidy(p.text), "main_text": _tidy(p.main), "markdown": _tidy(p.md), "lang": p.lang, "canonical": p.canonical, "meta": p.meta, "json_ld": p.json_ld[:LD_BLOBS], "json_ld_truncated": p.ld_cut,
        "feeds": p.feeds, "links": [dict(zip(("url", "text", "nofollow"), x, strict=True)) for x in p.links], "media": [dict(zip(("src", "alt"), x, strict=True)) for x in p.media],
        "headings": [dict(zip(("level", "text"), x, strict=True)) for x in p.headings], "tables": p.tables, "paragraphs": p.paragraphs,
        "blocks": [dict(zip(("text", "linked"), x, strict=True)) for x in p.blocks],
    }


def page_tables(html: str | None, url: str | None = None, bare_refs: bool = True) -> dict:
    """The ``tables`` of :func:`page_parts` alone."""
    p = _Tables(url or "")
    fed(p, (html if bare_refs else ended_refs(html or "")) or "")
    while p.stack:
        p.handle_endtag(p.stack[-1][0])
    return {"tables": p.tables}


def _lists(lists: list, values):
    """An Arrow array of lists, ``values`` making that of their items together."""
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values([x for one in lists for x in one]))


def _tables_array(tables: list[dict]):
    import pyarrow as pa

    def texts(x):
        return pa.array(x, pa.string())

    columns = [texts([t["caption"] for t in tables]), _lists([t["header"] for t in tables], texts), _lists([t["rows"] for t in tables], lambda rows: _lists(rows, texts))]
    return pa.StructArray.from_arrays(columns, ["caption", "header", "rows"])


#: Characters of markup whose parse makes a batch.
BATCH = 1 << 20


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bare_refs: bool = True, only_tables: bool = False) -> DataFrame:
    """(id, url, parts): every page parsed once, in Arrow batches; keep the result to share the parse. ``only_tables``: the
    parts are the tables and nothing else, for a fraction of the work.

    A batch goes on when what it was made from or of has grown, so that a task holds few pages at a time. ``bare_refs`` as
    in :func:`tidemark.sources.nodes.node_rows`.
    """

    def run(batches):
        import pyarrow as pa

        def made(rows):
            if not only_tables:
                return pa.RecordBatch.from_pylist(rows, schema=schema)
            # by columns: rows of nested dicts take longer to convert than to parse
            parts = pa.StructArray.from_arrays([_lists([r["parts"]["tables"] for r in rows], _tables_array)], ["tables"])
            return pa.RecordBatch.from_arrays([*[pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[:2]], parts], names=schema.names)

        for batch in batches:
            rows, size = [], 0
            for i, u, h in zip(*(batch.column(k) for k in range(3)), strict=True):
                u, h = u.as_py(), h.as_py()
                parts = (page_tables if only_tables else page_parts)(h, u, bare_refs)
                rows.append({"id": i.as_py(), "url": u, "parts": parts if only_tables else {**parts, "meta": list(parts["meta"].items())}})
                size += 500 + len(h or "")
                if size > BATCH:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = f"id {pages.schema[id_col].dataType.simpleString()}, url string, parts {TABLES if only_tables else PARTS}"
    schema = to_arrow_schema(StructType.fromDDL(kind))
    return pages.select(id_col, url_col, html_col).mapInArrow(run, kind)


def first_of(parts: str, *keys: str) -> Column:
    """The first non-empty of several meta keys."""
    return F.coalesce(*[F.when(F.col(f"{parts}.meta")[k] != "", F.col(f"{parts}.meta")[k]) for k in keys])


def metadata(parsed: DataFrame) -> DataFrame:
    """JSON-LD before OpenGraph before plain tags."""

    def from_ld(*paths: str) -> Column:
        """The first item that has any of them."""
        return F.get(F.array_compact(F.transform("parts.json_ld", lambda x: F.coalesce(*[F.get_json_object(x, p) for p in paths]))), F.lit(0))

    return parsed.select(
        "id", F.coalesce(from_ld("$.headline", "$.name"), first_of("parts", "og:title"), F.col("parts.title"), F.get(F.col("parts.headings"), F.lit(0))["text"]).alias("title"),
        F.coalesce(from_ld("$.description"), first_of("parts", "og:description", "description")).alias("description"),
        F.coalesce(from_ld("$.author.name", "$.author"), first_of("parts", "article:author", "author")).alias("author"),
        F.coalesce(from_ld("$.datePublished", "$.dateCreated"), first_of("parts", "article:published_time")).alias("published"),
        F.coalesce("parts.canonical", first_of("parts", "og:url")).alias("canonical"), F.coalesce("parts.lang", first_of("parts", "og:locale")).alias("lang"),
    )


def link_edges(parsed: DataFrame) -> DataFrame:
    """(id, pos, target, label, nofollow, internal): the web graph as rows."""
    from tidemark.functions import urls as U

    e = parsed.select("id", U.domain(F.col("url")).alias("site"), F.posexplode("parts.links").alias("pos", "l"))
    return e.select("id", "pos", F.col("l.url").alias("target"), F.col("l.text").alias("label"), F.col("l.nofollow").alias("nofollow"), U.same_site(U.domain(F.col("l.url")), F.col("site")).alias("internal"))


def table_rows(parsed: DataFrame) -> DataFrame:
    """(id, table, row, cells): data tables as rows, row 0 being the header, empty where there is none."""
    t = parsed.select("id", F.posexplode("parts.tables").alias("table", "grid"))
    every = F.concat(F.array("grid.header"), "grid.rows")
    return t.select("id", (F.col("table") + 1).alias("table"), F.posexplode(every).alias("row", "cells"))


def table_records(parsed: DataFrame) -> DataFrame:
    """(id, table, row, record): each data row as a map from header name, ``col_{n}`` where it has none. Of columns of
    one name the last stays."""
    t = parsed.select("id", F.posexplode("parts.tables").alias("table", "grid"))
    names = F.transform("grid.header", lambda h, i: F.when(h == "", F.concat(F.lit("col_"), i + 1)).otherwise(h))
    rows = t.select("id", (F.col("table") + 1).alias("table"), names.alias("names"), F.posexplode("grid.rows").alias("row", "cells"))
    last = F.filter(F.arrays_zip("names", "cells"), lambda x, i: F.array_position(F.slice("names", i + 2, F.greatest(F.size("names") - i - 1, F.lit(0))), x["names"]) == 0)
    return rows.select("id", "table", (F.col("row") + 1).alias("row"), F.map_from_entries(last).alias("record"))


def table_markdown(parsed: DataFrame) -> DataFrame:
    """(id, table, markdown): pipe tables with the caption in bold above; pipes inside cells are escaped."""

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))

    t = parsed.select("id", F.posexplode("parts.tables").alias("table", "grid"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("grid.header")))
    head = F.when(F.col("grid.caption").isNotNull(), F.array(F.concat(F.lit("**"), "grid.caption", F.lit("**")), F.lit(""))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(head, F.array(line(F.col("grid.header")), rule), F.transform("grid.rows", line))
    return t.select("id", (F.col("table") + 1).alias("table"), F.array_join(lines, "\n").alias("markdown"))


def signals(parsed: DataFrame) -> DataFrame:
    """Structural counts of a page, and how far its headings repeat its title."""
    from tidemark.functions import urls as U

    words = F.array_distinct(F.split(F.lower(F.coalesce("parts.title", F.lit(""))), r"\W+"))
    said = F.array_distinct(F.split(F.lower(F.array_join(F.transform("parts.headings", lambda h: h["text"]), " ")), r"\W+"))
    echo = F.size(F.array_intersect(words, said)) / F.greatest(F.size(words), F.lit(1))
    return parsed.select("id", F.size("parts.links").alias("anchors"), F.size(F.filter("parts.links", lambda x: U.is_affiliate(x["url"]))).alias("affiliate"), F.size("parts.media").alias("images"), F.size("parts.headings").alias("headings"), "parts.paragraphs", F.round(echo, 6).alias("heading_echo"))
