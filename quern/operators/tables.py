"""Tables of positioned cells into text: headers, columns, continuations and headings.

Cells are (doc, page, table_no, row_no, cell_no, x0, x1, text) rows; header merging is a fold
over a few leading rows of each table, all else is joins and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

MIN_OVERLAP = 0.30
HEADER_ROWS = 6
SUBCOLUMN = 0.6
TABLE = ["doc", "page", "table_no"]


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How much of the narrower of two intervals the other covers; an interval without width counts as 1 wide."""
    common = F.least(a1, b1) - F.greatest(a0, b0)
    width = F.least(a1 - a0, b1 - b0)
    return F.when(common <= 0, 0.0).otherwise(common / F.when(width == 0, 1.0).otherwise(width))


def clean_cells(cells: DataFrame) -> DataFrame:
    """Cells with their newlines as spaces, without empty ones."""
    return cells.withColumn("text", F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))).where("text <> ''")


def real_tables(cells: DataFrame, declared: DataFrame) -> DataFrame:
    """Tables of two rows or more, two filled cells a row or more, and 15 % of the declared grid filled."""
    stats = cells.groupBy(*TABLE).agg(F.countDistinct("row_no").alias("rows"), F.count(F.lit(1)).alias("filled")).join(declared, TABLE, "left")
    dense = F.coalesce(F.col("filled") / F.nullif(F.col("grid"), F.lit(0)) >= 0.15, F.lit(True))
    return stats.where((F.col("rows") >= 2) & (F.col("filled") / F.col("rows") >= 2.0) & dense).select(*TABLE)


def split_header(cells: DataFrame) -> DataFrame:
    """``cells`` with ``is_header``: rows before a table's first row with a digit, six at most."""
    rows = cells.groupBy(*TABLE, "row_no").agg(F.max(F.col("text").rlike(r"(?U)\d").cast("int")).alias("digits"))
    order = Window.partitionBy(*TABLE).orderBy("row_no")
    before = F.sum("digits").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.select(*TABLE, "row_no", ((before == 0) & (F.row_number().over(order) <= HEADER_ROWS)).alias("is_header"))
    return cells.join(marked, [*TABLE, "row_no"])


def merged_name(parts: Column) -> Column:
    """Fragments (an array) of a column's name: each once, and of words that differ by case only the first."""
    words = F.filter(F.split(F.array_join(F.array_distinct(parts), " "), r"(?U)\s+"), lambda w: w != "")
    lowered = F.transform(words, F.lower)
    return F.array_join(F.filter(words, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1), " ")


_COLUMN = "struct<x0: double, x1: double, parts: array<string>>"


def _with_fragment(found: Column, r: Column) -> Column:
    """The columns found so far with one more fragment: in the first that it overlaps, as a sub-column of a much wider one, or as one of its own."""
    at = F.array_position(F.transform(found, lambda c: overlap(r["x0"], r["x1"], c["x0"], c["x1"]) >= MIN_OVERLAP), True).cast("int")
    near = F.get(found, at - 1)
    column = lambda x0, x1, parts: F.struct(x0.alias("x0"), x1.alias("x1"), parts.alias("parts")).cast(_COLUMN)
    own = column(r["x0"], r["x1"], F.array(r["text"]))
    below = column(r["x0"], r["x1"], F.array(merged_name(near["parts"]), r["text"]))
    wider = lambda c: column(F.least(c["x0"], r["x0"]), F.greatest(c["x1"], r["x1"]), F.concat(c["parts"], F.array(r["text"])))
    narrow = r["x1"] - r["x0"] < (near["x1"] - near["x0"]) * SUBCOLUMN
    return F.when(at == 0, F.concat(found, F.array(own))).when(narrow, F.concat(found, F.array(below))).otherwise(F.transform(found, lambda c, i: F.when(i == at - 1, wider(c)).otherwise(c)))


def header_columns(cells: DataFrame) -> DataFrame:
    """(table, col, x0, x1, name): the columns of every table's header rows; a single one is no header.

    Fragments are taken by row and cell, in one fold a table: header rows are few.  Long ones name no column.
    """
    short = (F.length("text") <= 60) & (F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")) <= 8)
    fragments = F.array_sort(F.collect_list(F.struct("row_no", "cell_no", "x0", "x1", "text")))
    held = cells.where("is_header").where(short).groupBy(*TABLE).agg(fragments.alias("f"))
    found = held.select(*TABLE, F.aggregate("f", F.array().cast(f"array<{_COLUMN}>"), _with_fragment).alias("found")).where(F.size("found") > 1)
    ordered = F.array_sort(F.transform("found", lambda c, i: F.struct(c["x0"].alias("x0"), i.alias("i"), c["x1"].alias("x1"), merged_name(c["parts"]).alias("name"))))
    return found.select(*TABLE, F.posexplode(ordered).alias("col", "c")).select(*TABLE, "col", "c.x0", "c.x1", "c.name")


def stitched(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(table, block): tables without a header continue the one before them in the document."""
    tables = cells.where("NOT is_header").select(*TABLE).distinct()
    marked = tables.join(columns.select(*TABLE).distinct().withColumn("has", F.lit(1)), TABLE, "left")
    order = Window.partitionBy("doc").orderBy("page", "table_no")
    first = F.row_number().over(order) == 1
    opens = F.when(F.col("has").isNotNull() | F.col("first"), 1).otherwise(0)
    return marked.withColumn("first", first).withColumn("block", F.sum(opens).over(order)).drop("has", "first")


def cells_to_columns(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """``cells`` with the name of the narrowest column (of equal ones the first) that they overlap enough; null if there is none."""
    c = columns.select("doc", "block", "col", F.col("x0").alias("c0"), F.col("x1").alias("c1"), "name")
    joined = cells.join(c, ["doc", "block"], "left")
    fits = overlap(F.col("x0"), F.col("x1"), F.col("c0"), F.col("c1")) >= MIN_OVERLAP
    cell = ["doc", "block", "page", "table_no", "row_no", "cell_no"]
    best = F.min_by(F.when(fits, F.col("name")), F.when(fits, F.struct((F.col("c1") - F.col("c0")).alias("w"), F.col("col"))))
    return joined.groupBy(*cell, "x0", "x1", "text").agg(best.alias("name"))


def rows_to_text(named: DataFrame) -> DataFrame:
    """(doc, block, page, table_no, row_no, line): a row's cells as ``name: value``, without row numbers."""
    number = F.col("text").rlike(r"(?U)^\d{1,3}\.?$") & F.lower("name").contains(P.ROW_NUMBER_COLUMN)
    shown = F.when(F.col("name").isNull(), F.col("text")).when(~number, F.concat("name", F.lit(": "), "text"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct("cell_no", shown.alias("s"))))), lambda x: x["s"])
    return named.groupBy("doc", "block", "page", "table_no", "row_no").agg(F.array_join(parts, " | ").alias("line"))


def headings(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """``tables`` (table, top) with ``section``: the nearest line ending above within 60 points, unless it has more than 8 digits; else a short one of the page's first 5 lines; else ``?``."""
    gap = F.col("top") - F.col("bottom")
    near = tables.join(lines, ["doc", "page"], "left")
    above = F.when((F.col("bottom") <= F.col("top") + 2) & gap.between(0, 59.999999), F.col("bottom"))
    digits = lambda c: F.length(F.regexp_replace(c, r"(?U)\D", ""))
    words = F.size(F.filter(F.split(F.trim("line"), r"\s+"), lambda w: w != ""))
    fallback = F.when((F.col("line_no") < 5) & words.between(3, 14) & (digits(F.col("line")) < 5), F.col("line_no"))
    picked = near.groupBy(*TABLE, "top").agg(F.max_by(F.when(above.isNotNull(), F.trim("line")), above).alias("near"), F.min_by(F.when(fallback.isNotNull(), F.trim("line")), fallback).alias("early"))
    usable = (F.col("near") != "") & (digits(F.col("near")) <= 8)
    return picked.select(*TABLE, F.coalesce(F.when(usable, F.substring("near", 1, 120)), F.col("early"), F.lit("?")).alias("section"))


def table_blocks(cells: DataFrame, declared: DataFrame, tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Blocks of text (source, table_index, text, section, page_start, page_end, columns, n_rows) for table_chunks.

    Rows that repeat the header in short go; a row of one short cell without digits at its start
    is a subtitle; a block's title names its section and pages.
    """
    cells = clean_cells(cells)
    cells = split_header(cells.join(real_tables(cells, declared), TABLE, "left_semi"))
    columns = header_columns(cells)
    blocks = stitched(cells, columns)
    body = cells.where("NOT is_header").join(blocks, TABLE)
    columns = columns.join(blocks, TABLE)
    names = columns.groupBy("doc", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "name"))), lambda x: x["name"]).alias("columns"))
    per_row = body.groupBy("doc", "block", "page", "table_no", "row_no").agg(F.collect_list("text").alias("values"))
    low = F.transform(F.coalesce("columns", F.array().cast("array<string>")), lambda n: F.lower(n))
    stub = F.forall("values", lambda v: (F.length(v) <= 3) & F.exists("low", lambda n: n.contains(F.lower(v))))
    only = F.get("values", F.lit(0))
    subtitle = (F.size("values") == 1) & ~F.substring(only, 1, 4).rlike(r"(?U)\d") & (F.size(F.split(F.trim(only), r"\s+")) <= 10)
    kept = per_row.join(names, ["doc", "block"], "left").withColumn("low", low).where(~stub).withColumn("subtitle", F.when(subtitle, F.concat(F.lit("— "), only, F.lit(" —"))))
    lined = kept.drop("values", "low", "columns").join(rows_to_text(cells_to_columns(body, columns)), ["doc", "block", "page", "table_no", "row_no"])
    lined = lined.withColumn("line", F.coalesce("subtitle", "line")).where("line <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "table_no", "row_no", "line"))), lambda x: x["line"])
    packed = lined.groupBy("doc", "block").agg(ordered.alias("lines"))
    extent = blocks.groupBy("doc", "block").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.min_by("table_no", F.struct("page", "table_no")).alias("table_no"))
    sections = headings(tables, lines).withColumnRenamed("page", "page_start")
    out = packed.join(extent, ["doc", "block"]).join(names, ["doc", "block"], "left").join(sections, ["doc", "page_start", "table_no"], "left")
    pages = F.concat(F.col("page_start").cast("string"), F.when(F.col("page_end") != F.col("page_start"), F.concat(F.lit("–"), F.col("page_end").cast("string"))).otherwise(""))
    section = F.coalesce("section", F.lit("?"))
    return out.select(
        F.col("doc").alias("source"), (F.col("block") - 1).cast("int").alias("table_index"),
        F.concat(F.lit("["), section, F.lit(f", {P.PAGE_LABEL} "), pages, F.lit("]\n"), F.array_join("lines", "\n")).alias("text"),
        section.alias("section"), "page_start", "page_end", F.coalesce("columns", F.array().cast("array<string>")).alias("columns"), F.size("lines").alias("n_rows"),
    )
