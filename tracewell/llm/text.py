"""Small text helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between Spark and Python. A batch also ends at Spark's own bound of rows.
BATCH_BYTES = 1 << 20
#: Values of a hash by which rows are told apart before a join: the bound of a broadcast.
PICKS = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(data: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text in blocks, so that a very long text never is one list."""
    start, n = 0, len(data)
    while start < n:
        end = start + step
        if end < n:
            gap = _SPACE.search(data, end)
            end = gap.start() if gap else n
        yield data[start:end].split()
        start = end


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from all columns."""
    used, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends Python batches of BATCH_BYTES at most (or of one larger row): a task then
    holds a megabyte of texts at a time, however long they are. A smaller bound that is set already stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int("".join(filter(str.isdigit, conf.get(key)))) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def free() -> None:
    """Gives memory that is no longer used back to the system, where it can tell how: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which frees what it has used when it ends."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        free()

    return own


def split_by(rows: DataFrame, hashed: Column, keys: DataFrame, key_hash: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that may meet one of keys, rows that can't), by what hashes leave modulo PICKS; none is lost.

    hashed and key_hash are the same hash of the join's columns on either side. The remainders of the keys, PICKS of
    them at most, are broadcast: so a join with few keys need not shuffle the texts of all rows, only the first part.
    """
    (pick,) = fresh(rows.columns, "pick")
    picks = F.broadcast(keys.select(F.pmod(key_hash, F.lit(PICKS)).alias(pick)).distinct())
    marked = rows.withColumn(pick, F.pmod(hashed, F.lit(PICKS)))
    return marked.join(picks, pick, "left_semi").drop(pick), marked.join(picks, pick, "left_anti").drop(pick)
