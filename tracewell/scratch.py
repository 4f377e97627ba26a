"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset, a local folder, but only for a local master: on a
    cluster, executors could not see each other's."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tracewell-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, most: int = 1 << 17) -> DataFrame:
    """df, written, its rows dealt by keys to tasks of about `most` rows, however many that takes: what one task holds
    doesn't grow with the table, and steps that group, join or order within these keys shuffle no more."""
    one = written(df)
    return one.repartition(max(1, -(-one.count() // most)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that no later step reads; others are left alone."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tracewell-" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder.rsplit("/", 1)[0])
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
