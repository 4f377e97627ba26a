"""Balanced contiguous shards from global byte prefix sums; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.scratch import written

#: Ranges of doc_id at least; more where the session has more shuffle partitions.
RANGES = 256


def _range_of(bounds: list[int], col: Column) -> Column:
    """Number of bounds below col: 0 for the first range and for null."""
    return F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < col)) if bounds else F.lit(0)


def balanced_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of docs.

    Documents stand in the order of doc_id (nulls first; ties by checksum and size). Each has its UTF-8 bytes plus
    one as its size; the running total over all of them, cut at equal targets, gives the shard. A document belongs to
    the target in which its middle byte lies. slot counts up without gaps in each shard. A null text has size 1 and
    checksum 0. Repeated rows each take a slot. Other columns are ignored; an empty table gives an empty result.

    The texts are read once, down to 20 bytes a row. Running totals are taken within ranges of doc_id, offset by the
    sums of the ranges before; only tables with a row per range or shard are broadcast.
    """
    spark = docs.sparkSession
    ranges = ranges or max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    data = F.encode(F.col(text_col), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("text_crc32"))
    rows = written(rows, "sizes")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    rows = rows.withColumn("range", _range_of(sorted(set(cuts or [])), F.col("doc_id")))

    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    sums = rows.groupBy("range").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    sums = sums.select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"), F.sum("s").over(Window.partitionBy(F.lit(0))).alias("total"))
    own = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.expr("2 * (bytes_before + upto) - size")  # twice the place of the middle byte
    placed = (
        rows.withColumn("upto", F.sum("size").over(own))
        .withColumn("rank", F.count("*").over(own))
        .join(F.broadcast(sums), "range")
        .select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("total")))).cast("int").alias("shard"), (F.col("rows_before") + F.col("rank") - 1).alias("place"))
    )
    placed = written(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
