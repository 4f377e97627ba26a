"""Printed fixed-width reports: which files they are, where their columns lie, what they are called, and their records.

lines: (file, row, line), rows counted from 0. All files are read in one plan; windows are those of one file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A line that begins a record, one that is a page's banner, a labelled line, a rule, and values in a line.
RECORD = r"^\s{0,10}[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}(?:\s|$)"
BANNER = r"^\s{0,10}[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\b"
LABELLED = r"[A-Za-z]\s*:\s"
RULE = r"^[\s\-=_]+$"
VALUES = r"[0-9]{2}[-/][0-9]{2}[-/][0-9]{2,4}|[0-9],[0-9]{2,3}"

#: Lines that a file is judged by; records and columns it must have; share of them that must be aligned, or delimited.
SNIFFED, LEAST, COLUMNS, SHARE = 400, 4, 3, 0.7
#: Share of record lines that are blank where a gap is, and places of a gap.
BLANK, GAP = 0.98, 2
#: Lines above the first record among which a header may be, lines of a header, named columns it needs; cells of a line
#: that goes on with the record above, at most.
ABOVE, HEADER_LINES, NAMED, WRAPPED = 14, 3, 3, 3


def is_record(line: Column) -> Column:
    return line.rlike(RECORD) & ~line.rlike(BANNER)


def looks_fixed_width(lines: DataFrame) -> DataFrame:
    """(file, fixed): four records or more, 70 % of them with runs of spaces, three columns, and no delimiter that stands
    equally often, twice or more, in 70 % of the lines."""
    head = lines.where(F.col("row") < SNIFFED)
    body = head.where(F.trim("line") != "")
    counted = []
    for d in (",", "\t", "|", ";"):
        n = F.length("line") - F.length(F.replace("line", F.lit(d), F.lit("")))
        counted.append(body.select("file", F.lit(d).alias("d"), n.alias("k")))
    all_ = body.groupBy("file").agg(F.count("*").alias("lines"))
    modes = reduce(DataFrame.unionByName, counted).where("k >= 2").groupBy("file", "d", "k").agg(F.count("*").alias("n"))
    delimited = modes.join(all_, "file").where(F.col("n") >= SHARE * F.col("lines")).select("file").distinct().withColumn("delimited", F.lit(True))
    records = head.where(is_record(F.col("line"))).groupBy("file").agg(F.count("*").alias("records"), F.avg(F.col("line").rlike(r"\S {2,}\S").cast("int")).alias("aligned"))
    wide = columns(head).groupBy("file").agg(F.count("*").alias("columns"))
    g = all_.join(records, "file", "left").join(wide, "file", "left").join(delimited, "file", "left")
    fixed = (F.col("lines") >= LEAST) & (F.col("records") >= LEAST) & (F.col("aligned") >= SHARE) & (F.col("columns") >= COLUMNS) & F.col("delimited").isNull()
    return g.select("file", F.coalesce(fixed, F.lit(False)).alias("fixed"))


def columns(lines: DataFrame) -> DataFrame:
    """(file, col, begin, end): stretches of places between gaps of two or more that are blank in 98 % of record lines, so
    that one bad line can't join two columns."""
    r = lines.where(is_record(F.col("line")))
    n = r.groupBy("file").agg(F.count("*").alias("n"))
    used = r.select("file", F.posexplode(F.split("line", "")).alias("at", "sign")).where("sign <> ' ' AND sign <> ''").groupBy("file", "at").agg(F.count("*").alias("k"))
    full = used.join(n, "file").where(F.col("k") > (1 - BLANK) * F.col("n")).select("file", "at")
    w = Window.partitionBy("file").orderBy("at")
    new = F.coalesce((F.col("at") - F.lag("at").over(w) > GAP).cast("int"), F.lit(0))
    runs = full.withColumn("_new", new).withColumn("col", F.sum("_new").over(w).cast("int"))
    return runs.groupBy("file", "col").agg(F.min("at").alias("begin"), (F.max("at") + 1).alias("end"))


def _words(lines: DataFrame) -> DataFrame:
    """(file, row, at, stop, word): the words of lines and their places."""
    signs = lines.select("file", "row", F.posexplode(F.split("line", "")).alias("at", "sign")).where(~F.col("sign").rlike(r"^\s*$"))
    w = Window.partitionBy("file", "row").orderBy("at")
    signs = signs.withColumn("word", F.col("at") - F.row_number().over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sign"))), lambda x: x["sign"]), "")
    return signs.groupBy("file", "row", "word").agg(F.min("at").alias("at"), (F.max("at") + 1).alias("stop"), text.alias("text")).drop("word")


def headers(lines: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(file, col, header): the names of columns from the lines above the first record, else column_i.

    A word belongs to the column in which its middle lies, two places more to both sides, since names are centred over
    their columns. A line of the header has words in three columns; up to three such lines, above rules and notes of
    fewer, are joined from top to bottom; a labelled line or one of values ends the search.
    """
    spans = columns(lines) if spans is None else spans
    first = lines.where(is_record(F.col("line"))).groupBy("file").agg(F.min("row").alias("first"))
    above = lines.join(first, "file").where((F.col("row") < F.col("first")) & (F.col("row") >= F.col("first") - ABOVE) & ~F.col("line").rlike(RULE) & (F.trim("line") != ""))
    words = _words(above).withColumn("mid", F.floor((F.col("at") + F.col("stop")) / 2))
    near = words.join(spans, "file").where((F.col("mid") >= F.col("begin") - 2) & (F.col("mid") < F.col("end") + 2))
    placed = near.groupBy("file", "row", "at", "text").agg(F.min("col").alias("col"))
    cells = placed.groupBy("file", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("cell"))
    per_line = cells.groupBy("file", "row").agg(F.count("*").alias("filled"), F.max(F.col("cell").rlike(VALUES)).alias("values"))
    kept = above.join(per_line, ["file", "row"], "left").withColumn("full", F.coalesce(F.col("filled") >= NAMED, F.lit(False)))
    stop = F.col("line").rlike(LABELLED) | (F.col("full") & (F.col("values") | F.col("line").rlike(RECORD)))
    up = Window.partitionBy("file").orderBy(F.desc("row"))
    kept = kept.withColumn("_stops", F.sum(stop.cast("int")).over(up)).where("_stops = 0 AND full")
    kept = kept.withColumn("_n", F.row_number().over(up)).where(F.col("_n") <= HEADER_LINES).select("file", "row")
    named = cells.join(kept, ["file", "row"], "left_semi").groupBy("file", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "cell"))), lambda x: x["cell"]), " ").alias("name"))
    enough = named.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") >= NAMED).select("file")
    named = named.join(enough, "file", "left_semi")
    return spans.join(named, ["file", "col"], "left").select("file", "col", F.coalesce("name", F.concat(F.lit("column_"), F.col("col").cast("string"))).alias("header"))


def records(lines: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(file, row, col, header, value): the records of every file as cells in long form, row counting records from 0.

    Each line is cut at its file's columns, one column reaching to the next. A line without a date, down to the last
    record, goes on with the record above if it has text in three columns at most and no label; others are headers of
    a page again.
    """
    spans = columns(lines) if spans is None else spans
    nxt = F.lead("begin").over(Window.partitionBy("file").orderBy("col"))
    cuts = spans.withColumn("stop", F.coalesce(nxt, F.lit(1 << 20)))
    order = Window.partitionBy("file").orderBy("row")
    r = lines.withColumn("own", is_record(F.col("line"))).withColumn("record", F.sum(F.col("own").cast("int")).over(order) - 1).where("record >= 0")
    last = r.where("own").groupBy("file").agg(F.max("row").alias("last"))
    r = r.join(last, "file").where("row <= last AND (own OR NOT line RLIKE '[A-Za-z][ \t]*:[ \t]')")
    cells = r.join(cuts, "file").select("file", "record", "row", "own", "col", F.trim(F.col("line").substr(F.col("begin") + 1, F.col("stop") - F.col("begin"))).alias("v"))
    filled = F.sum((F.col("v") != "").cast("int")).over(Window.partitionBy("file", "row"))
    cells = cells.withColumn("filled", filled).where(F.col("own") | (F.col("filled") <= WRAPPED))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("v") != "", F.struct("row", "v")))), lambda x: x["v"]), " ")
    g = cells.groupBy("file", "record", "col").agg(text.alias("value"))
    return g.join(headers(lines, spans), ["file", "col"]).select("file", F.col("record").alias("row"), "col", "header", "value")
