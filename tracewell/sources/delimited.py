"""Delimited text, archives of files and their rejects, as DataFrames of strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.scratch import dealt
from tracewell.sources import regions

#: First bytes of file kinds.
MAGIC = {"zip": "504B0304", "ole2": "D0CF11E0A1B11AE1", "pdf": "25504446", "appledouble": "00051607"}
KNOWN = ("csv", "txt", "tsv", "html", "htm")


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, content) of all files below a folder but for lock files and archive leftovers."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return f.where(~name.startswith("~$") & ~name.startswith("._") & ~F.col("path").contains("__MACOSX")).select("path", "length", "content")


def container(content: Column) -> Column:
    """The kind that a file's first bytes tell, whatever its name; text if none."""
    head = F.hex(F.substring(content, 1, 8))
    return F.coalesce(*(F.when(head.startswith(m), k) for k, m in MAGIC.items()), F.lit("text"))


def first_copies(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with different bytes, rejected copies): of equal files that with the smallest path stays."""
    sha = found.withColumn("sha", F.sha2("content", 256))
    first = sha.groupBy("sha").agg(F.min("path").alias("first"))
    both = sha.join(first, "sha")
    return both.where("path = first").drop("first"), both.where("path <> first").select("path", F.lit("duplicate of ").alias("reason"), "first")


def unsupported(found: DataFrame) -> DataFrame:
    """Rejects for files of no known kind, one row each."""
    kind = F.lower(F.regexp_extract("path", "[.]([A-Za-z0-9]+)$", 1))
    return found.where(~kind.isin(*KNOWN)).select("path", F.concat(F.lit("unsupported file type "), kind).alias("reason"))


#: Delimiters, the first of equally good ones first; lines by which a file's is told.
DELIMITERS, SNIFFED = [",", ";", "|", "\t"], 40


def lines_of(found: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """(file, row, line): the lines of text files (path, content), counted from 0."""
    text = F.regexp_replace(F.decode("content", encoding), "\r\n?", "\n")
    return found.select(F.col("path").alias("file"), F.posexplode(F.split(text, "\n", -1)).alias("row", "line"))


def _count(line: Column, delimiter: str) -> Column:
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))


def delimiters(lines: DataFrame) -> DataFrame:
    """(file, delimiter): the one that stands equally often, outside quotes, in most of a file's first lines; three or more
    times count alike, a comma goes before others."""
    head = lines.where((F.col("row") < SNIFFED) & (F.trim("line") != ""))
    n = head.select("file", F.inline(F.array(*(F.struct(F.lit(-i).alias("place"), F.lit(d).alias("delimiter"), _count(F.col("line"), d).alias("n")) for i, d in enumerate(DELIMITERS)))))
    modes = n.groupBy("file", "place", "delimiter", "n").agg((F.count("*") * F.least("n", F.lit(3))).alias("worth"))
    return modes.groupBy("file").agg(F.max(F.struct("worth", "place", "delimiter"))["delimiter"].alias("delimiter"))


def grid(lines: DataFrame) -> DataFrame:
    """(file, row, cells): lines cut at their file's delimiter, but not inside quotes; doubled quotes are one, blank lines
    are left out. Every line becomes a row, however many cells it has."""
    met = lines.where(F.trim("line") != "").join(delimiters(lines), "file")
    cut = F.coalesce(*(F.when(F.col("delimiter") == d, F.split("line", f'[{d}](?=(?:[^"]*+"[^"]*+")*+[^"]*+$)', -1)) for d in DELIMITERS))
    bare = F.transform(cut, lambda c: F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"')))
    return met.select("file", "row", bare.alias("cells"))


def cells(lines: DataFrame, aliases: list[str]) -> DataFrame:
    """(file, row, col, header, value): the records of all files below the header row of each, as cells in long form."""
    g = dealt(grid(lines), "file")  # cut once: each test of the cells below would cut the lines anew
    return regions.grid_records(g, regions.header_rows(g, aliases))[0]


def wide(one: DataFrame) -> DataFrame:
    """(file, row, a column for each header): cells of files that share one header, whose names come to the driver."""
    names = [r.header for r in one.select("col", "header").distinct().orderBy("col").collect()]
    return one.groupBy("file", "row").pivot("header", names).agg(F.first("value"))


def misfits(lines: DataFrame, aliases: list[str]) -> DataFrame:
    """(file, row, cells, reason): records with other than their header's number of cells. They are read all the same, short
    ones with empty cells at their end."""
    g = grid(lines)
    heads = regions.header_rows(g, aliases)
    width = g.join(heads, "file").where("row = header").select("file", "header", F.size("cells").alias("width"))
    odd = g.join(width, "file").where((F.col("row") > F.col("header")) & (F.size("cells") != F.col("width")))
    return odd.select("file", "row", "cells", F.concat(F.size("cells").cast("string"), F.lit(" cells under a header of "), F.col("width").cast("string")).alias("reason"))


def cap_rows(rows: DataFrame, file_col: str, order: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows within the stated limit per file, a reject row for each file beyond it)."""
    n = rows.withColumn("_n", F.row_number().over(Window.partitionBy(file_col).orderBy(order)))
    over = n.groupBy(file_col).agg(F.count("*").alias("rows")).where(F.col("rows") > most).withColumn("rejected", F.col("rows") - most)
    return n.where(F.col("_n") <= most).drop("_n"), over


def map_columns(rows: DataFrame, targets: dict[str, list[str]]) -> DataFrame:
    """A column per target: the first non-empty of its aliases, in order, among the headers of rows."""
    by_name = {re.sub(r"\s+", " ", c.strip().lower()): c for c in rows.columns}
    blank = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    cols = []
    for target, aliases in targets.items():
        own = [blank(by_name[a]) for a in (re.sub(r"\s+", " ", x.strip().lower()) for x in aliases) if a in by_name]
        cols.append((F.coalesce(*own) if own else F.lit(None).cast("string")).alias(target))
    return rows.select(*cols)


def profile_scores(headers: DataFrame, profiles: DataFrame) -> DataFrame:
    """(table, profile, confidence): the share of a profile's fields with a header, best profile per table, first of
    equals. headers: table, header; profiles: profile, place, field, alias."""
    fields = profiles.groupBy("profile", "place").agg(F.count_distinct("field").alias("fields"))
    h = headers.select("table", F.lower(F.trim(F.regexp_replace("header", "\\s+", " "))).alias("alias"))
    got = h.join(profiles, "alias").groupBy("table", "profile", "place").agg(F.count_distinct("field").alias("hits"))
    scored = got.join(fields, ["profile", "place"]).withColumn("confidence", F.round(F.col("hits") / F.col("fields"), 4))
    best = F.row_number().over(Window.partitionBy("table").orderBy(F.desc("confidence"), "place"))
    return scored.withColumn("_n", best).where("_n = 1").select("table", "profile", "confidence")


def unpivot_flags(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, other): pairs of an id and the headers whose cell says yes, y, 1 or true."""
    others = [c for c in rows.columns if c != id_col]
    long = rows.unpivot(id_col, others, "other", "cell")
    return long.where(F.lower(F.trim("cell")).isin("yes", "y", "1", "true")).select(F.col(id_col).alias("id"), "other").distinct()
