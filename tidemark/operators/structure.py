"""What the parts of a page are made of, and which of them are its content: statistics, density pruning, candidates.

All work on node rows of :mod:`tidemark.sources.nodes`. A page's rows are one window partition: its nodes are a bounded
group, and pages are dealt by their id. Inside is "between enter and leave"; nothing walks a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.scratch import written

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
PARAGRAPHS = ["p", *HEADINGS, "li", "blockquote"]
TRIM = r"^\s+|\s+$"

# Names of furniture and of content, in classes and ids.
FURNITURE = (
    "nav|navbar|menu|sidebar|side-bar|footer|foot|header|masthead|breadcrumb|comments?|disqus|share|social|related|recommend|promo|banner|advert|ads?|popup|modal|cookie|"
    "consent|newsletter|subscribe|signup|pagination|pager|widget|toolbar|skip-link|sr-only|screen-reader|offscreen"
)
ON_A_THREAD = "comments?|disqus|"
CONTENT_NAMES = "article|post|content|entry|main|story|body|markdown|prose|docs?|readme"
CANDIDATE_TAGS = ["div", "section", "aside", "nav", "ul", "ol", "li", "form", "header", "footer", "figure", "table", "dl"]
CHROME_TAGS = ["nav", "header", "footer", "aside", "form", "dialog"]
UNLIKELY = (
    "-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|"
    "social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote"
)
MAYBE = "and|article|body|column|content|main|mathjax|shadow"
GOOD = "article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story"
BAD = (
    "-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|"
    "sponsor|shopping|tags|widget"
)
UNLIKELY_ROLES = ["menu", "menubar", "complementary", "navigation", "alert", "alertdialog", "dialog"]
SCORED_TAGS = ["section", "h2", "h3", "h4", "h5", "h6", "p", "td", "pre"]
BASE_SCORES = {"div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0} | dict.fromkeys(["address", "ol", "ul", "dl", "dd", "dt", "li", "form"], -3.0) | dict.fromkeys([*HEADINGS, "th"], -5.0)
DIVIDERS = [1.0, 2.0, 6.0, 9.0, 12.0]


def in_page(*order: str) -> Window:
    return Window.partitionBy("id").orderBy(*order)


def node_stats(nodes: DataFrame) -> DataFrame:
    """Element rows with totals over their subtrees: text and link_text (bytes of trimmed text), tags (itself included),
    blocks, commas, has_pre, has_table.

    A text is inside links if more links were opened than closed before it. One shuffle, by page.
    """
    tag = F.col("tag")
    own = F.struct("leave", "depth", "parent", "up", "tag", "attrs", "elements", "parts")
    trimmed = F.regexp_replace("text", TRIM, "")
    ends = F.when(tag.isNull(), F.array(F.struct(F.col("enter").alias("at"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("enter").alias("at"), F.lit(1).alias("side")), F.struct(F.col("leave").alias("at"), F.lit(-1).alias("side")))
    )
    tour = nodes.select(
        "id", "enter", F.explode(ends).alias("e"), own.alias("own"), F.coalesce(F.octet_length(trimmed), F.lit(0)).alias("bytes"),
        F.coalesce(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(","), F.lit(""))), F.lit(0)).alias("commas"),
    )
    opens, side = F.col("e.side") == 1, F.col("e.side")
    tag = F.col("own.tag")

    def opened(*tags: str) -> Column:
        return F.when(opens & tag.isin(*tags), 1).otherwise(0)

    w = Window.partitionBy("id").orderBy("e.at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tour = tour.withColumn("links", F.sum(F.when(tag == "a", side).otherwise(0)).over(w))
    sums = {
        "text": F.col("bytes"), "link_text": F.when(F.col("links") > 0, F.col("bytes")).otherwise(0), "tags": F.when(opens, 1).otherwise(0), "blocks": opened(*PARAGRAPHS),
        "commas": F.col("commas"), "pre": opened("pre", "code"), "table": opened("table"),
    }
    tour = tour.select("id", "enter", "e", "own", *[F.sum(v).over(w).alias(k) for k, v in sums.items()]).filter("own.tag is not null")
    # what ran up between an element's two places; its own opening counts at both, so once more
    between = [F.sum(-F.col("e.side") * F.col(k)).cast("int").alias(k) for k in sums]
    per = tour.groupBy("id", "enter").agg(F.any_value("own").alias("own"), *between)
    out = per.select("id", "enter", "own.*", *sums)
    return out.select(
        "id", "enter", "leave", "depth", "parent", "up", "tag", "attrs", "elements", "parts", "text", "link_text", (F.col("tags") + 1).alias("tags"),
        (F.col("blocks") + F.when(F.col("tag").isin(*PARAGRAPHS), 1).otherwise(0)).alias("blocks"), "commas",
        ((F.col("pre") > 0) | F.col("tag").isin("pre", "code")).alias("has_pre"), ((F.col("table") > 0) | (F.col("tag") == "table")).alias("has_table"),
    )


def link_density() -> Column:
    return F.col("link_text") / F.greatest("text", F.lit(1))


def names_of(attrs: str = "attrs") -> Column:
    """Class and id as one string, null where there is neither."""
    c, i = F.col(attrs)["class"], F.col(attrs)["id"]
    return F.when(c.isNotNull() | i.isNotNull(), F.concat(F.coalesce(F.concat(c, F.lit(" ")), F.lit("")), F.coalesce(i, F.lit(""))))


def class_bonus(thread: bool) -> Column:
    """-1 for the name of furniture as a whole word, 1 for one of content, else 0."""
    furniture = FURNITURE.replace(ON_A_THREAD, "") if thread else FURNITURE
    return F.when(names_of().rlike(rf"(?i)(^|[-_ ])({furniture})([-_ ]|$)"), -1).when(names_of().rlike(f"(?i)({CONTENT_NAMES})"), 1).otherwise(0)


def outermost(df: DataFrame, flag: str, out: str) -> DataFrame:
    """``out``: the flagged rows that lie inside no other flagged row."""
    before = F.max(F.when(F.col(flag), F.col("leave"))).over(in_page("enter").rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(out, F.col(flag) & (F.coalesce(before, F.lit(-1)) < F.col("enter")))


def inside(df: DataFrame, flag: str, out: str) -> DataFrame:
    """``out``: the rows that are flagged or lie inside a flagged one."""
    so_far = F.max(F.when(F.col(flag), F.col("leave"))).over(in_page("enter").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.coalesce(so_far, F.lit(-1)) >= F.col("enter"))


def page_text(stats: DataFrame) -> DataFrame:
    """``page_text``: of the top elements together. An element holds all below it, so that is the largest total too."""
    return stats.withColumn("page_text", F.sum(F.when(F.col("parent") == -1, F.col("text")).otherwise(0)).over(Window.partitionBy("id")))


def record_headings(stats: DataFrame, thread: bool) -> DataFrame:
    """``record_heading``: a lone heading, and the chain of plain ``div`` around it, in a record with prose.

    Each ``div`` of a chain has one child. In order of opening the chain is therefore a run of such ``div`` up to the
    heading, which the next other element names; its top is the first of the run, and the record is the top's parent.
    """
    role = F.coalesce(F.col("attrs")["role"], F.lit("")).isin("navigation", "menu", "menubar")
    plain = (F.col("bonus") >= 0) & ~role
    wrap = (F.col("tag") == "div") & plain & (F.col("parts") == 1) & (F.col("elements") == 1)
    lone = F.col("tag").isin(*HEADINGS) & (F.col("blocks") == 1)
    record = F.col("tag").isin("article", "section", "div", "li", "main") & plain & (F.col("blocks") >= 2) & (F.col("text") - F.col("link_text") >= 200) & (link_density() <= 0.5)
    after = F.first(F.when(~F.col("wrap"), F.struct("enter", "lone")), ignorenulls=True).over(in_page("enter").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = stats.withColumn("wrap", wrap).withColumn("lone", lone).withColumn("record", record).withColumn("end", after)
    s = s.withColumn("chain", F.when(F.coalesce(F.col("end.lone"), F.lit(False)), F.col("end.enter")))
    top = F.first("parent").over(Window.partitionBy("id", "chain").orderBy("enter"))
    s = s.withColumn("holder", F.when(F.col("chain").isNotNull(), top))
    records = s.filter("record").select("id", F.col("enter").alias("holder"), F.lit(True).alias("record_heading"))
    return s.drop("wrap", "lone", "record", "end", "chain").join(records, ["id", "holder"], "left").withColumn("record_heading", F.coalesce("record_heading", F.lit(False))).drop("holder")


def density_pruned(nodes: DataFrame, min_text: int = 25, max_link_density: float = 0.5, min_score: float = 0.35, thread: bool = False, stats: DataFrame | None = None) -> DataFrame:
    """Element rows with ``score``, ``dropped`` (the outermost of what goes) and, by page, ``kept_text`` and ``skip_chrome``.

    Code, data tables, headings of records, ``main``, ``article``, ``body`` and ``html`` stay. Where under 200 bytes or a
    tenth of the page would be left, nothing goes. ``skip_chrome``: over 30 bytes stand outside of navigation and the like.
    ``stats``: those of the nodes, if they are there already.
    """
    s = record_headings(page_text(node_stats(nodes) if stats is None else stats).withColumn("bonus", class_bonus(thread)), thread)
    share, linked = F.col("text") / F.greatest("page_text", F.lit(1)), link_density()
    score = 0.45 * (1 - linked) + 0.30 * F.least(F.col("text") / F.greatest("tags", F.lit(1)) / 10, F.lit(1.0)) + 0.15 * F.least(F.col("commas") / 5, F.lit(1.0)) + 0.10 * F.col("bonus")
    s = s.withColumn("score", score)
    goes = (
        ((F.col("text") < min_text) & (F.col("blocks") == 0)) | ((linked > max_link_density) & (F.col("text") < 200)) | ((linked > 0.8) & (share < 0.4))
        | ((F.col("score") < min_score) & (share < 0.2)) | ((F.col("bonus") < 0) & (share < 0.25))
    )
    judged = F.col("tag").isin(*CANDIDATE_TAGS) & ~F.col("has_pre") & ~F.col("has_table") & ~F.col("record_heading") & (F.col("page_text") > 0)
    s = outermost(s.withColumn("goes", judged & goes), "goes", "dropped")
    s = outermost(s.withColumn("chrome", F.col("tag").isin(*CHROME_TAGS)), "chrome", "chrome")
    whole = Window.partitionBy("id")
    s = s.withColumn("kept_text", F.col("page_text") - F.sum(F.when(F.col("dropped"), F.col("text")).otherwise(0)).over(whole))
    s = s.withColumn("skip_chrome", (F.col("page_text") > 0) & (F.col("page_text") - F.sum(F.when(F.col("chrome"), F.col("text")).otherwise(0)).over(whole) >= 30))
    enough = F.col("kept_text") >= F.greatest(F.lit(200), F.floor(F.col("page_text") * 0.1))
    s = s.withColumn("dropped", F.col("dropped") & enough).withColumn("kept_text", F.when(enough, F.col("kept_text")).otherwise(F.col("page_text")))
    return s.drop("goes", "chrome", "page_text")


# Text blocks ------------------------------------------------------------------------------------------------

BLOCK_TAGS = [
    "p", "div", "section", "article", "aside", "nav", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "blockquote", "pre", "td", "th", "figcaption", "form",
    "fieldset", "table", "tr", "ul", "ol", "dl",
]
#: Scripts written without spaces: each sign is a word.
IDEOGRAPHS = r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿\x{20000}-\x{2FA1F}]"


def word_count(text: Column) -> Column:
    """Runs between blanks, a run with ideographs counting as many as it has."""
    runs = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    return F.aggregate(F.transform(runs, lambda x: F.greatest(F.lit(1), F.regexp_count(x, F.lit(IDEOGRAPHS)))), F.lit(0), lambda a, x: a + x)


def text_units(nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, enter, leave, tag, words, linked, content): block elements with text, judged by the shallow tree.

    An element's text is its own; where that is blank, what stands before the first block inside it. The last block that
    opened before a text is the element itself just in that case.
    """
    block = F.col("tag").isin(*BLOCK_TAGS)
    last = F.last(F.when(block, F.struct("enter", "leave")), ignorenulls=True).over(in_page("enter").rowsBetween(Window.unboundedPreceding, -1))
    texts = nodes.withColumn("last", last).filter("tag is null").select("id", "enter", "parent", "text", "last")

    def joined(rows: DataFrame, out: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("enter", "text")))
        return rows.groupBy("id", "at").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias(out)).withColumnRenamed("at", "enter")

    own = joined(texts.select("id", F.col("parent").alias("at"), "enter", "text"), "own")
    first = joined(texts.filter(F.col("enter") < F.col("last.leave")).select("id", F.col("last.enter").alias("at"), "enter", "text"), "first")
    units = stats.filter(block).select("id", "enter", "leave", "tag", link_density().alias("linked")).join(own, ["id", "enter"], "left").join(first, ["id", "enter"], "left")
    own_words, words = word_count(F.coalesce("own", F.lit(""))), F.col("words")
    units = units.withColumn("words", F.when(own_words > 0, own_words).otherwise(word_count(F.coalesce("first", F.lit(""))))).filter("words > 0")
    w = in_page("enter")
    near = {"before": F.lag("words", 1, 0).over(w), "was": F.lag("linked", 1, 0.0).over(w), "after": F.lead("words", 1, 0).over(w)}
    after_text = (words > 16) | (F.col("after") > 15) | (F.col("before") > 4)
    content = (F.col("linked") <= 0.333333) & F.when(F.col("was") <= 0.555556, after_text).otherwise((words > 40) | (F.col("after") > 17))
    return units.withColumns(near).select("id", "enter", "leave", "tag", "words", "linked", content.alias("content"))


# Candidates and the vote ------------------------------------------------------------------------------------


def class_weight() -> Column:
    def of(name: str) -> Column:
        v = F.coalesce(F.col("attrs")[name], F.lit(""))
        return F.when((v != "") & v.rlike(f"(?i){GOOD}"), 25.0).otherwise(0.0) - F.when((v != "") & v.rlike(f"(?i){BAD}"), 25.0).otherwise(0.0)

    return of("class") + of("id")


def container_scores(stats: DataFrame, strip_unlikely: bool = True, weigh_classes: bool = True) -> DataFrame:
    """(id, enter, leave, raw, value) of elements that paragraphs speak for: their points fall off over five ancestors,
    and links take their share of the whole."""
    named = F.coalesce(names_of(), F.lit(""))
    unlikely = F.coalesce(F.col("attrs")["role"], F.lit("")).isin(*UNLIKELY_ROLES) | (~F.col("tag").isin("body", "a") & named.rlike(f"(?i){UNLIKELY}") & ~named.rlike(f"(?i){MAYBE}"))
    s = inside(stats.withColumn("unlikely", unlikely if strip_unlikely else F.lit(False)), "unlikely", "stripped")
    points = 1.0 + F.col("commas") + F.least(F.floor(F.col("text") / 100), F.lit(3))
    said = s.filter(~F.col("stripped") & F.col("tag").isin(*SCORED_TAGS) & (F.col("text") >= 25)).select("id", points.alias("points"), F.posexplode(F.slice("up", 1, len(DIVIDERS))).alias("level", "enter"))
    got = said.groupBy("id", "enter").agg(F.sum(F.col("points") / F.get(F.array(*map(F.lit, DIVIDERS)), F.col("level"))).alias("got"))
    base = F.lit(0.0)
    for tag, value in BASE_SCORES.items():
        base = F.when(F.col("tag") == tag, value).otherwise(base)
    raw = F.col("got") + base + (class_weight() if weigh_classes else 0.0)
    return stats.join(got, ["id", "enter"]).select("id", "enter", "leave", raw.alias("raw"), (raw * (1 - link_density())).alias("value"))


def content_root(nodes: DataFrame, stats: DataFrame, strip_unlikely: bool = True, weigh_classes: bool = True) -> DataFrame:
    """One row a page that has a candidate: id, root, root_leave, score, dropped (enter and leave of the root's children
    that are not of the article).

    The best container wins; where three near rivals lie under one of its ancestors, the nearest such ancestor does. Only
    children give way to their parents, and siblings of the winner stay if they score, carry its class, or read as prose.
    """
    scores = container_scores(stats, strip_unlikely, weigh_classes)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("value"), "enter"))
    best = scores.withColumn("r", rank).filter("r <= 5").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "enter", "leave", "value"))).alias("b"))
    top = F.get("b", F.lit(0))
    rivals = F.filter("b", lambda x: (x["r"] > 1) & (x["value"] / top["value"] >= 0.75))
    best = best.select("id", top.alias("top"), rivals.alias("rivals")).filter("top.value > 0")
    # the winner and what holds it, nearest first
    held = stats.join(best, "id").filter((F.col("enter") <= F.col("top.enter")) & (F.col("leave") >= F.col("top.leave")))
    over = (F.col("enter") < F.col("top.enter")) & (F.size(F.filter("rivals", lambda r: (r["enter"] > F.col("enter")) & (r["leave"] < F.col("leave")))) >= 3)
    step = F.struct((-F.col("enter")).alias("key"), "enter", "leave", "elements", F.coalesce(F.col("attrs")["class"], F.lit("")).alias("class"), over.alias("shared"))
    line = held.groupBy("id").agg(F.any_value("top").alias("top"), F.array_sort(F.collect_list(step)).alias("line"))
    shared = F.get(F.filter("line", lambda x: x["shared"]), F.lit(0))["enter"]
    line = line.withColumn("line", F.filter("line", lambda x: x["enter"] <= F.coalesce(shared, F.col("top.enter"))))
    wide = F.get(F.filter("line", lambda x, i: (i > 0) & (x["elements"] != 1)), F.lit(0))
    line = line.withColumn("parent", wide).withColumn("won", F.element_at(F.filter("line", lambda x: F.col("parent").isNull() | (x["enter"] > F.col("parent.enter"))), -1))
    # only children climb: the parent of the winner has other children, or there is none
    line = line.select("id", F.col("top.value").alias("score"), "parent", "won")
    mates = stats.alias("s").join(line.filter("parent is not null").alias("l"), (F.col("s.id") == F.col("l.id")) & (F.col("s.parent") == F.col("l.parent.enter")) & (F.col("s.enter") != F.col("l.won.enter")))
    mates = mates.select("s.id", "s.enter", "s.leave", "s.tag", "s.text", "s.link_text", "s.attrs", "l.score", F.col("l.won.class").alias("won_class"))
    mates = mates.join(scores.select("id", "enter", "raw"), ["id", "enter"], "left")
    words = nodes.filter("tag is null").select("id", F.col("enter").alias("at"), F.col("text").alias("words"))
    short = mates.filter("tag = 'p' and text > 0 and text < 80").select("id", "enter", "leave").join(words, "id").filter("at > enter and at < leave")
    short = short.groupBy("id", "enter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"]), "").rlike(r"\.( |$(?!\n))").alias("sentence"))
    mates = mates.join(short, ["id", "enter"], "left")
    bonus = F.when((F.col("won_class") != "") & (F.col("attrs")["class"] == F.col("won_class")), F.col("score") * 0.2).otherwise(0.0)
    scored = F.coalesce(F.col("raw") + bonus, F.lit(0.0)) >= F.greatest(F.col("score") * 0.2, F.lit(10.0))
    prose = (F.col("tag") == "p") & (((F.col("text") > 80) & (link_density() < 0.25)) | (F.coalesce("sentence", F.lit(False)) & (F.col("link_text") == 0)))
    gone = mates.filter(~(scored | prose)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("enter", "leave"))).alias("dropped"))
    root = F.coalesce("parent", "won")
    return line.join(gone, "id", "left").select("id", root["enter"].alias("root"), root["leave"].alias("root_leave"), "score", F.coalesce("dropped", F.array().cast("array<struct<enter:int,leave:int>>")).alias("dropped"))


def voted(nodes: DataFrame, majority: bool = False, candidates: bool = True, shallow: bool = True, density: bool = True) -> DataFrame:
    """(id, enter, tag, words, votes, voters, dropped, agreement) of each text unit.

    Three voters condemn units: the candidates all outside of the content root, the shallow tree what it calls furniture,
    and density pruning what it drops; a voter without an answer for a page has no voice there. A unit goes if all say so,
    or two thirds with ``majority``. ``agreement``: of the units that any voter condemned, the share that all did.
    """
    stats = written(node_stats(nodes), "vote-stats")  # three voters and the units read them
    units = text_units(nodes, stats)
    none = F.lit(None).cast("boolean")
    by_root, by_density = none, none
    if candidates:
        root = content_root(nodes, stats).withColumnRenamed("dropped", "mates")
        units = units.join(root, "id", "left")
        outside = (F.col("enter") < F.col("root")) | (F.col("enter") > F.col("root_leave")) | F.exists("mates", lambda m: (m["enter"] <= F.col("enter")) & (m["leave"] >= F.col("enter")))
        by_root = F.when(F.col("root").isNotNull(), outside)
    if density:
        gone = density_pruned(nodes, stats=stats).filter("dropped").groupBy("id").agg(F.collect_list(F.struct("enter", "leave")).alias("pruned"))
        units = units.join(gone, "id", "left")
        by_density = F.when(F.col("pruned").isNotNull(), F.exists("pruned", lambda m: (m["enter"] <= F.col("enter")) & (m["leave"] >= F.col("enter"))))
    says = F.array(by_root, ~F.col("content") if shallow else none, by_density)
    units = units.withColumn("says", says).withColumn("voters", F.size(F.array_compact("says"))).withColumn("votes", F.size(F.filter("says", lambda x: F.coalesce(x, F.lit(False)))))
    page = Window.partitionBy("id")
    needed = (F.ceil(F.col("voters") / 3) * 2).cast("int") if majority else F.col("voters")
    some, every = F.sum(F.when(F.col("votes") > 0, 1).otherwise(0)).over(page), F.sum(F.when(F.col("votes") == F.col("voters"), 1).otherwise(0)).over(page)
    dropped = (F.col("voters") > 0) & (F.col("votes") >= needed)
    return units.select("id", "enter", "tag", "words", "votes", "voters", dropped.alias("dropped"), F.when(some == 0, 1.0).otherwise(every / some).alias("agreement"))
