"""Sinks: CSV with a formula guard, JSON lines, llms.txt indexes and budgeted dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.functions import urls as U


def guarded(cell: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets an apostrophe; negative numbers do not."""
    risky = cell.rlike(r"^[=+@]") | (cell.rlike("^-") & cell.try_cast("double").isNull())
    return F.when(risky, F.concat(F.lit("'"), cell)).otherwise(cell)


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, strings guarded."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, StringType):
            c = guarded(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write(df: DataFrame, path: str) -> None:
    """Format by extension: csv, json lines (json, jsonl, ndjson) or parquet."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        csv_ready(df).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)
    elif kind in ("json", "jsonl", "ndjson"):
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").parquet(path)


def section(url: Column) -> Column:
    """First path segment, capitalised; 'Pages' if there is none or it is a file name."""
    first = F.regexp_extract(U.path(url), r"^/([^/]*)/", 1)
    return F.when((first == "") | F.contains(first, F.lit(".")), "Pages").otherwise(F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1000)))


def llms_index(pages: DataFrame, site: str, url: str, title: str, key: str) -> DataFrame:
    """(site, section, size, lines): a section's links in the order of URL and key."""
    label = F.regexp_replace(F.col(title), r"([\[\]])", r"\\$1")
    line = F.concat(F.lit("- ["), label, F.lit("]("), F.col(url), F.lit(")"))
    p = pages.select(F.col(site).alias("site"), section(F.col(url)).alias("section"), F.col(url).alias("u"), F.col(key).alias("k"), line.alias("line"))
    return p.groupBy("site", "section").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u", "k", "line"))), lambda x: x["line"]), "\n").alias("lines"))


def until_budget(docs: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """Rows of each group in order until one does not fit: nothing after it is taken either."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    spent = docs.withColumn("tokens", T.token_estimate(F.col(text))).withColumn("spent", F.sum("tokens").over(w))
    return spent.filter(F.col("spent") <= budget)


# Ragged records ---------------------------------------------------------------------------------------------


def flat_rows(pages: DataFrame, key: str, url: str, items: str, tables: str) -> DataFrame:
    """(key, place, record): a JSON object for each extracted item and each table row of a page, with the page's ``url``.

    ``items`` is an array of JSON objects; ``tables`` an array of struct<header,rows>, whose rows carry the table's number
    and are keyed by their header cells, ``col1`` and so on where one is missing; of cells of one name the last stays.
    Items come before tables.
    """
    of_item = pages.select(key, url, F.posexplode(items).alias("a", "item"))
    # the page's url leads unless the item names one
    own = F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(url).alias("u"))), r'(?s)^\{"u":(.*)\}$', 1), F.lit(""))
    body = F.regexp_replace("item", r"^\s*\{\s*", "")
    led = F.concat(F.lit('{"url":'), F.when(own == "", "null").otherwise(own), F.when(body.startswith("}"), "").otherwise(","), body)
    named = F.array_contains(F.coalesce(F.json_object_keys("item"), F.array().cast("array<string>")), "url")
    from_items = of_item.select(key, F.lit(0).alias("t"), "a", F.when(named, F.col("item")).otherwise(led).alias("record"))
    of_table = pages.select(key, url, F.posexplode(tables).alias("t", "grid")).select(key, url, (F.col("t") + 1).alias("t"), F.col("grid.header").alias("head"), F.posexplode("grid.rows").alias("a", "cells"))
    names = F.transform("cells", lambda c, i: F.coalesce(F.when(F.trim(F.get("head", i)) != "", F.trim(F.get("head", i))), F.concat(F.lit("col"), i + 1)))
    every = F.concat(F.array(F.struct(F.lit("url").alias("k"), F.col(url).alias("v")), F.struct(F.lit("table").alias("k"), F.col("t").cast("string").alias("v"))), F.zip_with(names, "cells", lambda n, c: F.struct(n.alias("k"), c.alias("v"))))
    keys = F.transform(every, lambda e: e["k"])
    last = F.filter(every, lambda e, i: F.array_position(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), e["k"]) == 0)
    from_tables = of_table.select(key, "t", "a", F.to_json(F.map_from_entries(last)).alias("record"))
    w = Window.partitionBy(key).orderBy("t", "a")
    return from_items.unionByName(from_tables).select(key, (F.row_number().over(w) - 1).alias("place"), "record")


def union_columns(rows: DataFrame, order: list[str], record: str) -> list[str]:
    """The names that any JSON object has, by where they are first seen. They are a table's columns: few beside its rows."""
    names = rows.select(*order, F.posexplode(F.json_object_keys(record)).alias("_k", "_name"))
    first = names.groupBy("_name").agg(F.min(F.struct(*order, "_k")).alias("_first"))
    return [r["_name"] for r in first.orderBy("_first", "_name").collect()]


def ragged_table(rows: DataFrame, order: list[str], record: str, columns: list[str] | None = None) -> DataFrame:
    """``order`` and a string column for each name of the JSON objects: nested values as JSON, missing ones null."""
    columns = union_columns(rows, order, record) if columns is None else columns
    v = rows.select(*order, F.from_json(record, "map<string,string>").alias("_v"))
    return v.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], *[F.try_element_at("_v", F.lit(c)).alias(c) for c in columns])


def csv_lines(rows: DataFrame, order: list[str], record: str) -> DataFrame:
    """(order, line): a header, whose order columns are null, and a line a record; every line has all columns. Cells that a
    spreadsheet would run get an apostrophe."""
    columns = union_columns(rows, order, record)

    def cell(c: Column) -> Column:
        safe = guarded(F.coalesce(c, F.lit("")))
        return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)

    table = ragged_table(rows, order, record, columns)
    body = table.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(order)], F.concat_ws(",", *[cell(F.col(f"`{c}`")) for c in columns]).alias("line"))
    head = rows.sparkSession.range(1 if columns else 0).select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order], F.concat_ws(",", *[cell(F.lit(c)) for c in columns]).alias("line"))
    return head.unionByName(body)
