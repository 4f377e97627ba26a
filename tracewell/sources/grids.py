"""Geometry of messy tables: sections and runs of width.

A grid is (file, row, cells): rows of string arrays in the order of their file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rows(by: str = "file") -> Window:
    return Window.partitionBy(by).orderBy("row")


def filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")


def sections(grid: DataFrame, aliases: list[str], least: int = 3, cap: int = 40) -> DataFrame:
    """grid with section: a row begins a new one where `least` cells or more are header words, most cells are no
    numbers, and it isn't the header before it again. Rows above the first header are section 0; the cap is the
    reference's own limit on sections, beyond which rows stay in the last."""
    words = F.transform("cells", lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))))
    hits = F.size(F.array_intersect(words, F.array(*map(F.lit, aliases))))
    numbers = F.size(F.filter(words, lambda w: w.rlike("^[0-9.,/: -]+$")))
    key = F.array_join(words, "|")
    g = grid.withColumn("_head", (hits >= least) & (numbers * 2 < F.size("cells"))).withColumn("_key", F.when(F.col("_head"), key))
    last = F.last("_key", True).over(_rows().rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("_new", F.when(F.col("_head") & ~F.col("_key").eqNullSafe(last), 1).otherwise(0))
    return g.withColumn("section", F.least(F.sum("_new").over(_rows()), F.lit(cap))).drop("_head", "_key", "_new")


def width_runs(grid: DataFrame) -> DataFrame:
    """(file, run, width, first_row, last_row, rows): stretches of rows of one width; rows under 0.6 of the file's most
    common width don't break a stretch and count in none."""
    g = grid.select("file", "row", F.size("cells").alias("width"))
    common = g.groupBy("file", "width").agg(F.count("*").alias("n")).groupBy("file").agg(F.max(F.struct("n", "width"))["width"].alias("common"))
    g = g.join(common, "file").where(F.col("width") >= 0.6 * F.col("common"))
    new = (~F.col("width").eqNullSafe(F.lag("width").over(_rows()))).cast("int")
    g = g.withColumn("_new", new).withColumn("run", F.sum("_new").over(_rows()))
    return g.groupBy("file", "run", "width").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("rows"))
