"""Quotation linking: quoted passages find the messages they come from; conversations in reply order. Native.

A line's quote level is the number of ``>`` before it. Lines of one level are joined, cut into sentences,
normalised and hashed; so are a message's own lines. A quoted sentence belongs to the earliest message of the
conversation that says it itself; a message answers the one of which it quotes most characters, at the lowest
level. Links point back in turn order, so they form trees; roots and depths come by pointer jumping.

Null text is an empty message; null turns never link and sort first; a null conversation is one of its own;
identical rows are one message with ``n_rows`` counted; ties go to the later turn; an empty table gives no rows;
further columns are ignored. No step gathers a conversation: links are equi-joins on (conversation, hash) or
(conversation, turn) with much-quoted messages dealt out, places in the reply order are prefix sums, and
conversations are built in parts of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exclusive_prefix, join_hot, materialize, ordered_bucket, pick, quantile_bounds, range_bucket

BREAK = "\x1e"
PREFIX = r"^[ \t]*((?:>[ \t]?)*)"
LEAD_IN = r"(?i)^(?:on\b.{0,200}\bwrote|le\b.{0,200}a écrit|am\b.{0,200}schrieb|el\b.{0,200}escribió)[ \t]*:[ \t]*$"
CUT = rf"[.!?]\s+|\s*{BREAK}\s*"


def quote_lines(text: Column) -> Column:
    """array<struct<level,body>>; lines that only announce a quote have level -1."""
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, PREFIX, 1)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        body = F.regexp_replace(x, PREFIX, "")
        return F.struct(F.when(x.rlike(LEAD_IN), -1).otherwise(level).alias("level"), F.when(level == 0, x).otherwise(body).alias("body"))

    return F.transform(F.split(text, r"\r?\n", -1), line)


def sentences(lines: Column, level: Column) -> Column:
    """Normalised sentences of one level: lines rejoined, other levels as breaks, letters and digits only."""
    flow = F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, x["body"]).otherwise(F.lit(BREAK))), " ")
    plain = F.transform(F.split(flow, CUT), lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")))
    return F.array_distinct(F.filter(plain, lambda s: s != ""))


def _digest(*cols: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in cols]))


def link_quotes(messages: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per distinct message: conv, turn, role, text (own words only), n_rows, n_quoted, n_linked,
    parent_turn, root_turn, depth, mid (the message's digest), pos (its place in the conversation in reply order:
    by root, then turn, so that replies follow what they answer)."""
    m = pick(messages, conv=conv_col, turn=turn_col, role=role_col, raw=text_col)
    m = m.groupBy("conv", "turn", "role", "raw").agg(F.count(F.lit(1)).alias("n_rows"))
    m = m.withColumn("lines", quote_lines(F.coalesce("raw", F.lit(""))))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    m = m.select("conv", F.unhex(_digest("conv")).alias("ck"), "turn", "role", _digest("conv", "turn", "role", "raw").alias("mid"), "n_rows", F.trim(own).alias("text"), "lines")
    m = materialize(m, "quote-messages")

    levels = F.array_distinct(F.transform("lines", lambda x: x["level"]))
    said = m.withColumn("level", F.explode(F.filter(levels, lambda x: x >= 0)))
    said = said.select("ck", "turn", "mid", "level", F.explode(sentences(F.col("lines"), F.col("level"))).alias("s"))
    said = said.select(F.struct("ck", F.xxhash64("s").alias("h")).alias("k"), "turn", "mid", "level", F.length("s").alias("chars"))
    source = said.filter("level = 0 and turn is not null").groupBy("k").agg(F.min("turn").alias("from_turn"))
    quoted = materialize(said.filter("level > 0").groupBy("k", "turn", "mid").agg(F.min("level").alias("level"), F.max("chars").alias("chars")), "quote-said")
    pairs = join_hot(quoted, source.join(quoted.select("k").distinct(), "k", "left_semi"), "k", "mid", "left")
    pairs = pairs.select("mid", "level", "chars", F.when(F.col("from_turn") < F.col("turn"), F.col("from_turn")).alias("from_turn"))
    per = pairs.groupBy("mid", "from_turn").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.min("level").alias("level"))
    best = F.max(F.when(F.col("from_turn").isNotNull(), F.struct((-F.col("level")).alias("near"), "chars", "from_turn")))
    linked = F.sum(F.when(F.col("from_turn").isNotNull(), F.col("n")).otherwise(0))
    links = per.groupBy("mid").agg(F.sum("n").alias("n_quoted"), linked.alias("n_linked"), best["from_turn"].alias("parent_turn"))
    out = materialize(m.drop("lines").join(links, "mid", "left"), "quote-links")

    # roots by pointer jumping; only turns that answer something take part
    up = out.filter("parent_turn is not null").groupBy(F.struct("ck", "turn").alias("k")).agg(F.min("parent_turn").alias("anc"))
    up = materialize(up.withColumn("depth", F.lit(1).cast("long")), "quote-up")
    moved = not up.isEmpty()
    while moved:
        over = up.select(F.col("k").alias("next"), F.col("anc").alias("over"), F.col("depth").alias("more"))
        step = join_hot(up.withColumn("next", F.struct(F.col("k.ck").alias("ck"), F.col("anc").alias("turn"))), over, "next", "k", "left")
        step = step.select("k", F.coalesce("over", "anc").alias("anc"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("over").isNotNull().alias("moved"))
        step = materialize(step, "quote-up")
        moved = not step.filter("moved").isEmpty()
        up = step.drop("moved")
    # the chain of the message itself, not of another message of its turn
    answers = materialize(out.withColumn("k", F.when(F.col("parent_turn").isNotNull(), F.struct("ck", F.col("parent_turn").alias("turn")))), "quote-answers")
    tree = join_hot(answers.filter("k is not null"), up, "k", "mid", "left").unionByName(answers.filter("k is null"), allowMissingColumns=True)
    tree = tree.select(
        "conv", "ck", "turn", "role", "text", "mid", "n_rows", F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn", F.coalesce("anc", "parent_turn", "turn").alias("root_turn"), F.when(F.col("parent_turn").isNull(), 0).otherwise(F.coalesce("depth", F.lit(0)) + 1).cast("long").alias("depth"),
    )
    tree = materialize(tree, "quote-tree")
    parts = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns, _ = quantile_bounds(tree, "turn", parts)
    bucket = ordered_bucket(F.col("root_turn"), *quantile_bounds(tree, "root_turn", parts), range_bucket(F.col("turn"), turns) + 1, len(turns) + 2)
    order = [F.col("root_turn"), F.col("turn"), F.col("mid")]
    placed = exclusive_prefix(tree.withColumn("bucket", bucket).withColumn("one", F.lit(1).cast("long")), "one", "pos", ["ck"], "bucket", order)
    return placed.drop("ck", "bucket", "one")


def conversations(linked: DataFrame, per_part: int = 1000) -> DataFrame:
    """(conv, part, messages): the messages of :func:`link_quotes` in reply order as array<struct<role,text>>. A long
    conversation is several parts of at most ``per_part`` messages, so that none is gathered whole."""
    part = F.floor(F.col("pos") / per_part).cast("long")
    listed = F.array_sort(F.collect_list(F.struct("pos", "role", "text")))
    return linked.groupBy("conv", part.alias("part")).agg(F.transform(listed, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))


def op10_quote_link(spark, sf_dir: str) -> DataFrame:
    """All messages, one row each, with their place in the reply order; an empty table gives no rows."""
    out = link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.withColumnRenamed("conv", "conv_id").drop("mid")


_LEVEL = "length({m}) - length(replace({m}, '>', ''))".format(m=f"regexp_extract(x, '{PREFIX}', 1)")
SQL = rf"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text AS raw, count(*) AS n_rows,
  md5(concat_ws('|', coalesce('=' || conv_id, '~'), coalesce('=' || turn, '~'), coalesce('=' || role, '~'), coalesce('=' || text, '~'))) AS mid
  FROM conversations GROUP BY conv_id, turn, role, text),
lines AS (SELECT *, list_transform(regexp_split_to_array(coalesce(raw, ''), '\r?\n'), lambda x: struct_pack(
  level := CASE WHEN regexp_matches(x, '{LEAD_IN}') THEN -1 ELSE {_LEVEL} END,
  body := CASE WHEN {_LEVEL} = 0 THEN x ELSE regexp_replace(x, '{PREFIX}', '') END)) AS ls FROM m),
flows AS (SELECT conv_id, turn, mid, level, array_to_string(list_transform(ls, lambda x: CASE WHEN x.level = level THEN x.body ELSE chr(30) END), ' ') AS flow
  FROM (SELECT *, unnest(list_distinct(list_transform(ls, lambda x: x.level))) AS level FROM lines) t WHERE level >= 0),
said AS (SELECT DISTINCT conv_id, turn, mid, level, s FROM (SELECT conv_id, turn, mid, level,
  trim(regexp_replace(lower(unnest(regexp_split_to_array(flow, '[.!?]\s+|\s*\x1e\s*'))), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS s FROM flows) t WHERE s <> ''),
source AS (SELECT conv_id, s, min(turn) AS from_turn FROM said WHERE level = 0 AND turn IS NOT NULL GROUP BY conv_id, s),
quoted AS (SELECT conv_id, turn, mid, s, min(level) AS level FROM said WHERE level > 0 GROUP BY conv_id, turn, mid, s),
pairs AS (SELECT q.mid, q.level, length(q.s) AS chars, CASE WHEN f.from_turn < q.turn THEN f.from_turn END AS from_turn
  FROM quoted q LEFT JOIN source f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.s = q.s),
per AS (SELECT mid, from_turn, count(*) AS n, sum(chars) AS chars, min(level) AS level FROM pairs GROUP BY mid, from_turn),
links AS (SELECT mid, sum(n) AS n_quoted, sum(CASE WHEN from_turn IS NOT NULL THEN n ELSE 0 END) AS n_linked,
  arg_max(from_turn, row(-level, chars, from_turn)) FILTER (WHERE from_turn IS NOT NULL) AS parent_turn FROM per GROUP BY mid),
o AS (SELECT l.*, k.n_quoted, k.n_linked, k.parent_turn FROM lines l LEFT JOIN links k ON k.mid = l.mid),
up AS (SELECT conv_id, turn, min(parent_turn) AS anc FROM o WHERE parent_turn IS NOT NULL GROUP BY conv_id, turn),
chain AS (SELECT conv_id, turn, anc, 1 AS depth FROM up UNION ALL
  SELECT c.conv_id, c.turn, u.anc, c.depth + 1 FROM chain c JOIN up u ON u.conv_id IS NOT DISTINCT FROM c.conv_id AND u.turn = c.anc),
tops AS (SELECT conv_id, turn, arg_max(anc, depth) AS anc, max(depth) AS depth FROM chain GROUP BY conv_id, turn),
t AS (SELECT o.conv_id, o.turn, o.role, o.mid, trim(array_to_string(list_transform(list_filter(o.ls, lambda x: x.level = 0), lambda x: x.body), chr(10))) AS text, o.n_rows,
  coalesce(o.n_quoted, 0)::bigint AS n_quoted, coalesce(o.n_linked, 0)::bigint AS n_linked, o.parent_turn, coalesce(p.anc, o.parent_turn, o.turn) AS root_turn,
  CASE WHEN o.parent_turn IS NULL THEN 0 ELSE coalesce(p.depth, 0) + 1 END::bigint AS depth
  FROM o LEFT JOIN tops p ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.turn = o.parent_turn)
SELECT conv_id, turn, role, text, n_rows, n_quoted, n_linked, parent_turn, root_turn, depth,
  row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS FIRST, turn NULLS FIRST, mid) - 1 AS pos FROM t"""
