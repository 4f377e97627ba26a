"""Tables inside messy grids: header rows, best sheets, records, regions of one width, merged headers, identities.

A grid is (file, row, cells): rows of string arrays, counted from 0. All files are read in one plan; what comes out are
cells in the long form of `columns`. A window here is one file's rows, or one region's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.scratch import written

# What values look like in a row that is no header, and rows that are sums of others.
DATEISH = r"\b[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}\b"
MONEYISH = r"(?i)^\s*[-+(]?\s*(?:₹|rs\.?|inr)?\s*[0-9]{1,3}(?:,[0-9]{2,3})+(?:\.[0-9]+)?\s*(?:cr|dr)?\)?\s*$|^\s*[0-9]+\.[0-9]{2}\s*(?:cr|dr)?\s*$"
LONG_DIGITS = "[0-9]{9,}"
DERIVED = r"(?i)^\s*(?:page\s+)?(?:sub\s*)?total\b|^\s*grand\s+total\b|^\s*(?:opening|closing)\s+bal|^\s*(?:carried|brought)\s+(?:forward|over)\b|^\s*b[/\\]?f\b|^\s*c[/\\]?f\b"

#: Rows of a region, named cells of a header, rows of a header at most; rows of a width that make it a table's own.
REGION_ROWS, HEADER_CELLS, HEADER_ROWS, OWN_WIDTH = 3, 2, 8, 3
#: A row under this share of the usual width is a page's artefact; share of the rows that regions must account for.
MINOR, ACCOUNTED = 0.6, 0.5


def tidy(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: c != "")


def is_data(cells: Column) -> Column:
    return F.exists(cells, lambda c: c.rlike(DATEISH) | c.rlike(MONEYISH) | c.rlike(LONG_DIGITS))


def is_label(cells: Column) -> Column:
    """Whether a row's cells read as titles of columns: no values, and letters in half of the filled ones."""
    own = filled(cells)
    return (F.size(own) > 0) & ~is_data(own) & (2 * F.size(F.filter(own, lambda c: c.rlike(r"\p{L}"))) >= F.size(own))


def _widths(grid: DataFrame) -> DataFrame:
    """(file, width, n): how many rows that aren't empty have each number of cells."""
    return grid.where(F.size(filled(tidy(F.col("cells")))) > 0).groupBy("file", F.size("cells").alias("width")).agg(F.count("*").alias("n"))


def needs_recovery(grid: DataFrame) -> DataFrame:
    """(file, broken): grids of three rows or more in which two widths have three rows each, or none of whose first eight
    rows is a header of two cells."""
    wide = _widths(grid).where(F.col("n") >= OWN_WIDTH).groupBy("file").agg(F.count("*").alias("widths"))
    cells = tidy(F.col("cells"))
    head = (F.col("row") < HEADER_ROWS) & is_label(cells) & (F.size(filled(cells)) >= HEADER_CELLS)
    g = grid.groupBy("file").agg(F.count("*").alias("rows"), F.max(head.cast("int")).alias("headed")).join(wide, "file", "left")
    return g.select("file", ((F.col("rows") >= REGION_ROWS) & ((F.coalesce("widths", F.lit(0)) >= 2) | (F.col("headed") == 0))).alias("broken"))


def spans(grid: DataFrame) -> DataFrame:
    """(file, row, cells, span, place, start): rows in stretches of one width, cells tidied, place counted within. Empty
    rows and those far narrower than the file's usual width lie inside a stretch without ending it; stretches of under
    three rows, and rows before the first, are left out."""
    own = _widths(grid)
    usual = own.groupBy("file").agg(F.coalesce(F.max(F.when(F.col("n") >= OWN_WIDTH, F.col("width"))), F.max("width")).alias("usual"))
    order = Window.partitionBy("file").orderBy("row")
    g = grid.join(usual, "file").select("file", "row", tidy(F.col("cells")).alias("cells"), "usual")
    counts = (F.size(filled(F.col("cells"))) > 0) & (F.size("cells") >= MINOR * F.col("usual"))
    g = g.withColumn("_w", F.when(counts, F.size("cells")))
    before = F.last("_w", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("_new", (F.col("_w").isNotNull() & ~F.col("_w").eqNullSafe(before)).cast("int"))
    g = g.withColumn("span", F.sum("_new").over(order)).where("span > 0")
    one = Window.partitionBy("file", "span")
    g = g.withColumn("_n", F.count("*").over(one)).withColumn("place", F.row_number().over(one.orderBy("row")) - 1).withColumn("start", F.min("row").over(one))
    return g.where(F.col("_n") >= REGION_ROWS).select("file", "row", "cells", "span", "place", "start", F.col("_n").alias("rows"))


def _shown_width(cells: Column) -> Column:
    """Cells up to the last that isn't empty."""
    return F.coalesce(F.array_max(F.transform(cells, lambda c, i: F.when(c != "", i + 1))), F.lit(0))


def merged_headers(rows: DataFrame) -> DataFrame:
    """(file, span, header_rows, headers): the leading label rows of each stretch, eight at most, joined column by column,
    a text once; unnamed columns are column_i. Null headers where there are none, or too few names."""
    order = Window.partitionBy("file", "span").orderBy("row")
    h = rows.withColumn("_stop", F.sum((~is_label(F.col("cells"))).cast("int")).over(order))
    head = (F.col("_stop") == 0) & (F.col("place") < HEADER_ROWS)
    g = h.groupBy("file", "span").agg(F.array_sort(F.collect_list(F.when(head, F.struct("row", "cells")))).alias("hs"), F.min(F.when(F.col("place") == 0, _shown_width(F.col("cells")))).alias("width"))
    widest = F.coalesce(F.array_max(F.transform("hs", lambda r: F.size(r["cells"]))), F.lit(0))
    at = F.when(F.least("width", widest) > 0, F.sequence(F.lit(0), F.least("width", widest) - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda c: F.array_join(F.array_distinct(filled(F.transform("hs", lambda r: F.coalesce(F.get(r["cells"], c), F.lit(""))))), " ")
    named = F.transform(at, lambda c: F.coalesce(F.nullif(name(c), F.lit("")), F.concat(F.lit("column_"), c.cast("string"))))
    enough = F.size(F.filter(named, lambda n: ~n.startswith("column_"))) >= HEADER_CELLS
    return g.select("file", "span", F.size("hs").alias("header_rows"), F.when((F.size("hs") > 0) & enough, named).alias("headers"))


# Fixed value: a labelled value inside a cell.
LABELLED = r"([A-Za-z][A-Za-z0-9./]*(?:\s+[A-Za-z0-9./]+){0,3})\s*(?:-\s*:|:)\s*(.{1,60}?)(?=\s{2,}|$|\s+[A-Za-z][A-Za-z0-9./]*(?:\s+[A-Za-z0-9./]+){0,3}\s*(?:-\s*:|:))"
#: Records that a label must stand in to be a column, and such columns of a region at most (the reference's own limit).
LABEL_RECORDS, LABELS = 2, 12


def recovered(grid: DataFrame, promote: bool = True) -> tuple[DataFrame, DataFrame]:
    """(regions, cells) of every file of grid.

    regions: (file, region, start, header_rows, headers, records). A stretch without a header goes on with the one
    before it. Files of which regions hold under half of the filled rows have none at all.
    cells: (file, region, row, col, header, value), a record a row: rows whose first cell is empty belong to the record
    above, sums and carried balances to none. Labels with a value inside cells, if they stand in two records, become
    columns of their own.
    """
    rows = written(spans(grid), "spans")
    heads = merged_headers(rows)
    at = Window.partitionBy("file").orderBy("span")
    known = heads.withColumn("named", F.last("headers", True).over(at))
    known = known.withColumn("headers", F.when(F.col("header_rows") > 0, F.col("headers")).otherwise(F.col("named"))).where("headers IS NOT NULL").drop("named")
    known = written(known, "heads")

    body = rows.join(known, ["file", "span"]).where("place >= header_rows")
    first = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    body = body.where((F.size(filled(F.slice("cells", F.lit(1), F.size("headers")))) > 0) & ~F.coalesce(first.rlike(DERIVED), F.lit(False)))
    order = Window.partitionBy("file", "span").orderBy("row")
    body = body.withColumn("record", F.sum((first != "").cast("int")).over(order) + F.when(F.first(first).over(order) == "", 1).otherwise(0) - 1)
    records = body.groupBy("file", "span", "record").agg(F.first("headers").alias("headers"), F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rs"))
    value = lambda c: F.array_join(filled(F.transform("rs", lambda r: F.coalesce(F.get(r["cells"], c), F.lit("")))), " ")
    records = records.select("file", "span", "record", "headers", F.transform("headers", lambda h, c: value(c)).alias("values"))
    records = written(records, "records")

    held = rows.groupBy("file", "span").agg(F.first("rows").alias("rows"), F.first("start").alias("start"))
    counts = records.groupBy("file", "span").agg(F.count("*").alias("records"))
    found = known.join(held, ["file", "span"]).join(counts, ["file", "span"])
    whole = grid.where(F.size(filled(tidy(F.col("cells")))) > 0).groupBy("file").agg(F.count("*").alias("filled"))
    enough = found.groupBy("file").agg(F.sum("rows").alias("rows")).join(whole, "file").where(F.col("rows") >= ACCOUNTED * F.col("filled")).select("file")
    found = found.join(enough, "file", "left_semi").select("file", F.col("span").alias("region"), "start", "header_rows", "headers", "records")
    kept = records.join(enough, "file", "left_semi").withColumnRenamed("span", "region")
    cells = kept.select("file", "region", F.col("record").alias("row"), F.posexplode(F.arrays_zip(F.col("headers").alias("header"), F.col("values").alias("value"))).alias("col", "c"))
    cells = cells.select("file", "region", "row", "col", "c.header", "c.value")
    if not promote:
        return found, cells
    pairs = promoted(cells)
    widths = found.select("file", "region", "headers")
    more = pairs.join(widths, ["file", "region"]).where(~F.array_contains("headers", F.col("label")))
    count = more.groupBy("file", "region", "label").agg(F.count("*").alias("n"), F.min(F.struct("row", "col", "at")).alias("first"), F.first(F.size("headers")).alias("width")).where(F.col("n") >= LABEL_RECORDS)
    rank = F.row_number().over(Window.partitionBy("file", "region").orderBy(F.desc("n"), "first"))
    best = count.withColumn("k", rank).where(F.col("k") <= LABELS).select("file", "region", "label", (F.col("width") + F.col("k") - 1).cast("int").alias("col"))
    extra = more.drop("col").join(best, ["file", "region", "label"]).select("file", "region", "row", "col", F.col("label").alias("header"), "value")
    return found, cells.unionByName(extra)


def promoted(cells: DataFrame) -> DataFrame:
    """(file, region, row, label, value, col, at): `Label: value` texts inside cells, each label once a record, by the last
    two words before the colon."""
    pair = F.arrays_zip(F.regexp_extract_all("value", F.lit(LABELLED), 1).alias("l"), F.regexp_extract_all("value", F.lit(LABELLED), 2).alias("v"))
    c = cells.where(F.col("value").contains(":")).select("file", "region", "row", "col", F.posexplode(pair).alias("at", "p"))
    words = F.split(F.trim(F.regexp_replace("p.l", r"\s+", " ")), " ")
    label = F.trim(F.regexp_replace(F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), " "), r"\.+$", ""))
    value = F.trim(F.regexp_replace(F.trim("p.v"), "[,;]+$", ""))
    c = c.select("file", "region", "row", label.alias("label"), value.alias("value"), "col", "at").where("label <> '' AND value <> '' AND lower(label) <> 'layer'")
    first = c.groupBy("file", "region", "row", "label").agg(F.min(F.struct("col", "at", "value")).alias("m"))
    return first.select("file", "region", "row", "label", "m.value", "m.col", "m.at")


def preambles(grid: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of grid above the first region of their file."""
    first = found.groupBy("file").agg(F.min("start").alias("first"))
    return grid.join(first, "file").where(F.col("row") < F.col("first")).drop("first")


# ---------------------------------------------------------------- header rows, sheets, records

#: Rows among which a header is looked for.
TOP = 40


def _hits(cells: Column, aliases: list[str]) -> Column:
    own = F.array(*map(F.lit, aliases)) if aliases else F.array().cast("array<string>")
    return F.size(F.filter(cells, lambda c: F.array_contains(own, F.lower(F.trim(F.coalesce(c, F.lit("")))))))


def header_rows(grid: DataFrame, aliases: list[str], by: tuple[str, ...] = ("file",)) -> DataFrame:
    """(file, header, hits): of the first forty rows that with most cells that are header words, the first of equals; row
    0 where none has two. Every file of grid in one pass, whose rows are reduced before they are shuffled."""
    h = grid.select(*by, "row", F.when(F.col("row") < TOP, _hits(F.col("cells"), aliases)).otherwise(0).alias("hits"))
    best = h.groupBy(*by).agg(F.max(F.struct("hits", (-F.col("row")).alias("r"))).alias("m"))
    return best.select(*by, F.when(F.col("m.hits") >= 2, -F.col("m.r")).otherwise(0).cast("int").alias("header"), F.col("m.hits").alias("hits"))


def best_sheets(sheets: DataFrame, aliases: list[str]) -> DataFrame:
    """sheets (file, sheet, row, cells), of each file only the sheet whose header row has most header words, then most
    rows, then that which comes first."""
    head = header_rows(sheets, aliases, ("file", "sheet"))
    own = sheets.join(head, ["file", "sheet"]).groupBy("file", "sheet").agg(F.count("*").alias("rows"), F.max(F.when(F.col("row") == F.col("header"), _hits(F.col("cells"), aliases)).otherwise(0)).alias("hits"))
    best = own.groupBy("file").agg((-F.max(F.struct("hits", "rows", (-F.col("sheet")).alias("s")))["s"]).alias("sheet"))
    return sheets.join(best, ["file", "sheet"], "left_semi")


def unique_headers(names: Column) -> Column:
    """Names of columns, blank ones column_i, repeated ones with __2, __3 and so on."""
    named = F.transform(names, lambda c, i: F.coalesce(F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")), F.concat(F.lit("column_"), i.cast("string"))))

    def one(c: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(named, F.lit(1), i + 1), lambda x: x == c))
        return F.when(nth > 1, F.concat(c, F.lit("__"), nth.cast("string"))).otherwise(c)

    return F.transform(named, one)


def grid_records(grid: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, rejects): the records below each file's header row as cells in long form, counted from 0, and how many
    rows were blank or had nothing in their first two cells. heads: file, header."""
    g = grid.join(heads.select("file", "header"), "file")
    names = g.where("row = header").select("file", unique_headers(F.col("cells")).alias("names"))
    body = g.where("row > header").select("file", "row", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("cells"))
    blank = (F.size(filled(F.col("cells"))) == 0) | (F.size(filled(F.slice("cells", 1, 2))) == 0)
    kept = body.where(~blank).withColumn("record", F.row_number().over(Window.partitionBy("file").orderBy("row")) - 1).join(names, "file")
    at = F.posexplode(F.transform("names", lambda n, i: F.struct(n.alias("header"), F.coalesce(F.get("cells", i), F.lit("")).alias("value"))))
    cells = kept.select("file", F.col("record").alias("row"), at.alias("col", "c")).select("file", "row", "col", "c.header", "c.value")
    return cells, body.where(blank).groupBy("file").agg(F.count("*").alias("blank_rows"))


# ---------------------------------------------------------------- whose statement it is

# Labels of whom a statement is of.
IDENTITY = {
    "account_no": ["account number", "account no", "account no.", "a/c no", "a/c no.", "a/c number"],
    "account_holder": ["account holder", "account name", "customer name", "name"],
    "registered_mobile": ["mobile", "mobile no", "mobile number", "registered mobile", "phone no"],
}
#: Digits that a number needs to be an identifier, more than a country's code.
DIGITS = 6


def _number(value: Column) -> Column:
    bare = F.regexp_replace(F.trim(value), r"[\s\-()]", "")
    return F.when(F.length(F.regexp_replace(bare, "[^0-9]", "")) >= DIGITS, bare)


def identities(above: DataFrame, text: DataFrame | None = None, labels: dict[str, list[str]] | None = None) -> DataFrame:
    """(file, field, value): account, holder and mobile from the rows above a table, a label cell and what stands to its
    right (the last such row), else from `Label: value` in text (file, text).

    Numbers are what all cells to the right hold together, since exports split off the country's code, and need six
    digits; names are the first cell to the right."""
    labels = labels or IDENTITY
    numeric = {f: any(k in f for k in ("no", "number", "mobile", "phone")) for f in labels}
    spark = above.sparkSession
    names = F.broadcast(spark.createDataFrame([(f, a, numeric[f]) for f, own in labels.items() for a in own], "field string, label string, numeric boolean"))
    cells = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    at = above.select("file", "row", cells.alias("cells")).select("file", "row", "cells", F.posexplode("cells").alias("col", "cell"))
    at = at.withColumn("label", F.regexp_replace(F.lower("cell"), ":+$", "")).join(names, "label")
    rest = filled(F.slice("cells", F.col("col") + 2, F.size("cells")))
    value = F.when(F.col("numeric"), _number(F.array_join(rest, ""))).otherwise(F.get(rest, F.lit(0)))
    by_cell = at.select("file", "field", "row", "col", value.alias("value")).where("value IS NOT NULL AND value <> ''").groupBy("file", "field").agg(F.max(F.struct("row", "col", "value"))["value"].alias("value"))
    if text is None:
        return by_cell
    found = []
    for field, own in labels.items():
        form = r"(\+?[0-9][0-9\s\-()]{4,24}[0-9]|\+?[0-9]+)" if numeric[field] else r"([A-Za-z][A-Za-z .]+?)"
        raw = [F.trim(F.regexp_extract("text", rf"(?i)\Q{a}\E[.:\-\s]*{form}(?:\s{{2,}}|\n|$| IFSC| A/C)", 1)) for a in own]
        value = F.coalesce(*(_number(r) if numeric[field] else F.nullif(r, F.lit("")) for r in raw))
        found.append(text.select("file", F.lit(field).alias("field"), value.alias("value")).where("value IS NOT NULL"))
    by_text = reduce(DataFrame.unionByName, found)
    return by_cell.unionByName(by_text.join(by_cell, ["file", "field"], "left_anti"))


def identified(cells: DataFrame, whose: DataFrame, fields: list[str]) -> DataFrame:
    """cells with a column for each of the fields of their file's identities (file, field, value); null where unknown."""
    wide = whose.groupBy("file").pivot("field", fields).agg(F.first("value"))
    return cells.join(wide, "file", "left")
