"""A case's tables in one folder: each data set's rows replaced as a whole, columns added as they come, counts read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def save(tables: dict[str, DataFrame], path: str, dataset: str) -> None:
    """Every table's rows of one data set in the place of its former ones. Other data sets are left alone, whatever columns
    they have."""
    for name, df in tables.items():
        df.withColumn("dataset", F.lit(dataset)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, name: str, dataset: str | None = None) -> DataFrame:
    """A table with the columns of all its data sets; those that a data set was saved without are null in its rows."""
    df = spark.read.option("mergeSchema", True).parquet(f"{path}/{name}")
    return df.where(F.col("dataset") == dataset) if dataset is not None else df


def counts(spark: SparkSession, path: str, names: list[str], dataset: str) -> DataFrame:
    """(table, rows): how many rows of a data set each table holds; a table that was never saved holds none."""
    parts = []
    for name in names:
        try:
            rows = read(spark, path, name, dataset).agg(F.count("*").alias("rows"))
        except AnalysisException:  # no such folder
            rows = spark.range(1).select(F.lit(0).cast("long").alias("rows"))
        parts.append(rows.select(F.lit(name).alias("table"), "rows"))
    return reduce(DataFrame.unionByName, parts)
