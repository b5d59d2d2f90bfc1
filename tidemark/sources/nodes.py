"""HTML pages as node rows: one row for each element and text, numbered by an Euler tour.

``enter`` and ``leave`` are an element's places in the tour: an element lies inside another if its places do, so subtree
totals are differences of running sums and ancestors are interval joins, in plain Spark. The parser only emits rows;
it closes what a new tag ends (paragraphs, items, cells), supplies ``html``, ``head``, ``body``, ``tbody`` and ``tr``, and
opens again the formatting that a closed block cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
FORMAT = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
CELLS = {"td", "th", "caption"}
#: Tags whose start ends an open paragraph.
ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul", "dd", "dt",
}
#: What a start tag ends, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "a": ({"a"}, CELLS | {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption"}, {"table"}), "body": ({"head"}, set()),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "caption"}, {"table"}),
}
#: Tags that do not bring back the formatting that a closed block cut off.
NOT_RESUMING = (ENDS_P | ENDS.keys() | HEAD | {"html", "head", "body"}) - {"a"}
#: Of equal formatting elements so many go on after what holds them has closed.
MOST_ALIKE = 3
#: Ancestors that a node row names, nearest first.
NEAREST = 6
#: Characters that the parser takes at a time: what is finished then leaves, so that a page of any length needs little memory.
PIECE = 1 << 20
#: A sign that begins no reference ended by a semicolon; scripts, styles and comments have no references.
_BARE = re.compile(r"(<(script|style)\b(?:.*?</\2|.*)|<!--(?:.*?-->|.*))|&(?!(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);)", re.I | re.S)


def ended_refs(html: str) -> str:
    """The markup with each ``&`` written out that begins no reference with a semicolon: ``&amp`` stays text."""
    return _BARE.sub(lambda m: m[1] or "&amp;", html) if "&" in html else html


_VALUE = r"""(?:="[^"&<>]*"|='[^'&<>]*')?"""
_SPECIAL = "script|style|title|textarea|xmp|iframe|noembed|noframes|noscript|plaintext|svg|math"
#: Markup as most of it is written. Groups: the whole; a cell of text, its
#: attributes and text; a start or end tag's slash, name and attributes; the name, attributes and text of
#: a script or style; a title's; a text. Anything else is for the full parser.
_PLAIN = re.compile(
    rf"(<(td|th)((?:[ \t\n\r\f]+[a-z][a-z0-9-]*{_VALUE})*)>([^<]*)</\2>|<(/?)(?!(?:{_SPECIAL})\b)([a-z][a-z0-9]*)((?:[ \t\n\r\f]+[a-z][a-z0-9-]*{_VALUE})*)[ \t\n\r\f]*>|([^<]+)|<(script|style)((?:[ \t\n\r\f]+[a-z][a-z0-9-]*{_VALUE})*)>(.*?)</\9>|<(title)>([^<]*)</title>|<!doctype [a-z ]*>|<!--[^<>-]*-->)",
    re.S | re.I | re.A,
)
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9-]*)(?:="([^"]*)"|='([^']*)')?""", re.I | re.A)


def _attributes(text: str) -> list[tuple[str, str | None]]:
    return [(m[1].lower(), m[2] if m[2] is not None else m[3]) for m in _ATTRIBUTE.finditer(text)]


def fed(parser: HTMLParser, html: str) -> None:
    """Feeds and closes the parser. Plain markup is cut by one expression and handed to the parser's handlers as the parser
    itself would; a page with anything else in it (references in attributes, ``<`` in texts, empty-element slashes) goes
    through the parser as a whole, and so does one of over ``PIECE`` characters. A handler ``handle_cell`` is offered cells
    with nothing but text and says whether it took them."""
    found = _PLAIN.findall(html) if len(html) <= PIECE else []
    if sum([len(m[0]) for m in found]) < len(html):  # something was passed over
        parser.feed(html)
        parser.close()
        return
    start, end, data = parser.handle_starttag, parser.handle_endtag, parser.handle_data
    cell = getattr(parser, "handle_cell", None)
    for _, box, box_attrs, boxed, slash, tag, attrs, text, raw, raw_attrs, code, title, words in found:
        if box:
            box, boxed = box.lower(), unescape(boxed) if "&" in boxed else boxed
            if not cell or not cell(box, box_attrs and _attributes(box_attrs), boxed):
                start(box, _attributes(box_attrs))
                if boxed:
                    data(boxed)
                end(box)
        elif tag:
            if slash:
                end(tag.lower())
            else:
                start(tag.lower(), _attributes(attrs) if attrs else [])
        elif text:
            data(unescape(text) if "&" in text else text)
        elif raw or title:
            name, code = (raw or title).lower(), code if raw else unescape(words)
            start(name, _attributes(raw_attrs))
            if code:
                data(code)
            end(name)


class _Tree(HTMLParser):
    """Node lists [enter, leave, depth, parent, up, tag, attrs, text, elements, parts, inside]; ``done`` has those that are
    closed. Beside the open ones on the ``stack`` are their ``tags`` and ``lines``: what ``up`` is below them; ``nodes`` counts all so far.
    ``folded``: an element that holds one text and nothing else has it in its own node."""

    def __init__(self, folded: bool = False):
        super().__init__(convert_charrefs=True)
        self.folded = folded
        self.done, self.stack, self.tags, self.lines, self.again, self.place, self.nodes, self.bodies = [], [], [], [], [], 0, 0, 0

    def _open(self, tag, attrs):
        stack, place, up, parent = self.stack, self.place, [], -1
        if stack:
            holder, up = stack[-1], self.lines[-1]
            holder[8] += 1
            holder[9] += 1
            parent = holder[0]
        stack.append([place, place, len(stack), parent, up, tag, attrs, None, 0, 0, self.nodes])
        self.tags.append(tag)
        self.lines.append([place, *up[: NEAREST - 1]])
        self.place = place + 1
        self.nodes += 1
        self.bodies += tag == "body"

    def _say(self, text, blank):
        stack, place, up, parent = self.stack, self.place, [], -1
        if stack:
            holder, up = stack[-1], self.lines[-1]
            holder[9] += not blank
            parent = holder[0]
        self.done.append([place, place, len(stack), parent, up, None, None, text, 0, 0, 0])
        self.place = place + 1
        self.nodes += 1

    def _ended(self, node):
        node[1], inside = self.place, self.nodes - node[10] - 1
        self.place += 1
        if inside == 1 and self.folded and self.done and self.done[-1][5] is None and self.done[-1][3] == node[0]:
            node[7], inside = self.done.pop()[7], 0
            self.nodes -= 1
        node[10] = inside

    def _close(self, depth, own=None):
        """Closes the elements from ``depth`` on; formatting that its own end tag did not close goes on after it."""
        if own and depth == len(self.stack) - 1:
            node = self.stack.pop()
            self._ended(node)
            self.done.append(node)
            self.tags.pop()
            self.lines.pop()
            return
        gone = self.stack[depth:]
        for node in reversed(gone):
            self._ended(node)
        self.done += gone
        if len(gone) > (own is not None) and gone[0][5] not in CELLS:
            for node in gone[(own is not None) :]:
                if node[5] in FORMAT:
                    one = (node[5], node[6])
                    if self.again.count(one) == MOST_ALIKE:
                        self.again.remove(one)
                    self.again.append(one)
        del self.stack[depth:], self.tags[depth:], self.lines[depth:]

    def _place_in(self, tag):
        """The parents that markup may leave out."""
        if not self.stack:
            self._open("html", {})
        if "body" not in self.tags and tag not in ("head", "body"):
            if tag in HEAD and "head" not in self.tags and not self.bodies:
                self._open("head", {})
            elif tag not in HEAD:
                if "head" in self.tags:
                    self._close(self.tags.index("head"))
                self._open("body", {})

    def _resume(self):
        todo, self.again = self.again, []
        for tag, attrs in todo:
            self._open(tag, attrs)

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in reversed(attrs)} if attrs else {}
        tags = self.tags
        if tag == "html" and self.stack:
            return
        if tag != "html":
            self._place_in(tag)
        if tag == "body" and "body" in tags:
            return
        if tag in ENDS_P and "p" in tags:
            for i in range(len(tags) - 1, -1, -1):
                if tags[i] == "p":
                    self._close(i)
                    break
                if tags[i] in CELLS or tags[i] in ("button", "table"):
                    break
        if tag in ENDS:
            ended, stops = ENDS[tag]
            for i in range(len(tags) - 1, -1, -1):
                if tags[i] in ended:
                    self._close(i, own=tag == "a" or None)
                    break
                if tags[i] in stops:
                    break
            if tag in ("tr", "td", "th"):
                if tags[-1:] == ["table"]:
                    self._open("tbody", {})
                if tag != "tr" and tags[-1:] and tags[-1] in ("tbody", "thead", "tfoot"):
                    self._open("tr", {})
        if self.again and tag not in NOT_RESUMING:
            self._resume()
        self._open(tag, found)
        if tag in VOID:
            self._close(len(self.stack) - 1, own=True)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "circle", "rect", "line", "use", "g"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        tags = self.tags
        if tag in ("html", "body"):
            return
        for i in range(len(tags) - 1, -1, -1):
            if tags[i] == tag:
                self._close(i, own=True)
                return
            if tags[i] in CELLS and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                break
        for i in range(len(self.again) - 1, -1, -1):
            if self.again[i][0] == tag:
                del self.again[i]
                return

    def handle_data(self, data):
        tags, blank = self.tags, not data.strip()
        if not blank:
            if not tags or tags[-1] not in HEAD:
                self._place_in("#text")
        elif not tags:
            return
        if self.again and (not tags or tags[-1] not in HEAD):
            self._resume()
        self._say(data, blank)


def node_lists(html: str | None, folded: bool = False) -> Iterator[list[list]]:
    """The nodes of a page, part by part as they close. Parts end before a ``<``, where a text ends anyway."""
    tree, html, at = _Tree(folded), html or "", 0
    if len(html) <= PIECE:
        fed(tree, html)
        at = len(html)
    while at < len(html):
        end = len(html)
        if end - at > PIECE:
            end = html.rfind("<", at + 1, at + PIECE + 1)
            end = end if end > 0 else html.find("<", at + PIECE)
            end = end if end > 0 else len(html)
        tree.feed(html[at:end])
        at = end
        done, tree.done = tree.done, []
        yield done
    tree.close()
    tree.again.clear()
    tree._close(0)
    yield tree.done


def page_nodes(html: str | None) -> list[list]:
    """The nodes of a page in its order, without ``inside``."""
    return sorted((node[:10] for part in node_lists(html) for node in part), key=lambda node: node[0])


SCHEMA = "enter int, leave int, depth int, parent int, up array<int>, tag string, attrs map<string,string>, text string, elements int, parts int, inside int"


def node_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", bare_refs: bool = True, only: tuple[str, ...] = (), folded: bool = False) -> DataFrame:
    """(id, enter, leave, depth, parent, up, tag, attrs, text, elements, parts, inside): the nodes of every page.

    ``parent`` is the parent's ``enter``, -1 at the top; ``up`` those of the six nearest ancestors; text rows have no tag;
    ``elements`` counts element children, ``parts`` those and texts that are not blank, ``inside`` all rows below an element.
    Null markup has no nodes.
    Without ``bare_refs`` only references that a semicolon ends are read as such; browsers read some without.
    ``only`` names the columns that are handed on beside the id, all if empty. ``folded``: an element that holds one text and
    nothing else has it as its own ``text``, and the text has no row; places stay as they are.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    listed = [c for c in SCHEMA.split(", ") if not only or c.split()[0] in only]
    names = [c.split()[0] for c in listed]
    kept = [k for k, c in enumerate(SCHEMA.split(", ")) if c in listed]

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for i, html in zip(batch.column(0), batch.column(1), strict=True):
                key, text = i.as_py(), html.as_py() or ""
                for found in node_lists(text if bare_refs else ended_refs(text), folded):
                    ids += [key] * len(found)
                    rows += found
                    if len(rows) > 20_000:
                        yield made(batch, ids, rows)
                        ids, rows = [], []
            if rows:
                yield made(batch, ids, rows)

    def made(batch, ids, rows):
        import pyarrow as pa

        types = {"up": pa.list_(pa.int32()), "tag": pa.string(), "text": pa.string()}
        columns = list(zip(*rows, strict=True))
        arrays = [maps(columns[k]) if name == "attrs" else pa.array(columns[k], types.get(name, pa.int32())) for k, name in zip(kept, names, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *arrays], names=["id", *names])

    def maps(attrs):
        import pyarrow as pa

        starts, keys, values = [], [], []
        for one in attrs:
            starts.append(None if one is None else len(keys))
            if one:
                keys += one
                values += one.values()
        return pa.MapArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))

    return pages.select(id_col, html_col).mapInArrow(run, f"id {kind}, {', '.join(listed)}")
