"""Balanced shards against a brute-force version: every row in one order, one running total, cuts at equal targets."""

import zlib

from pyspark.sql import functions as F

from tracewell.llm import shards
from tracewell.llm.queries import op5_sharding


def brute(rows, n):
    own = [(i, zlib.crc32(t.encode()) if t is not None else 0, (len(t.encode()) if t is not None else 0) + 1) for i, t in rows]
    own.sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1], r[2]))
    total, upto, out, first = sum(r[2] for r in own), 0, [], {}
    for place, (i, crc, size) in enumerate(own):
        upto += size
        shard = min(n - 1, (2 * upto - size) * n // (2 * total))
        out.append((i, size, crc, "bytes", shard, place - first.setdefault(shard, place), None))
    return out


def same(got, rows, n=8):
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows, n), key=key)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = op5_sharding(spark, "/root/testdata/sf0.001").collect()
    same(got, rows)
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)


def test_ties_repeats_and_rows_without_id(spark):
    rows = [(1, "a"), (1, "a"), (1, "b" * 50), (None, "x"), (None, None), (None, "x"), (2, ""), (3, None), (4, "é" * 300), (-5, "z")] + [(7, f"t{i % 3}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("q") for c in ("size", "shard", "range", "upto")})
    for n in (1, 3, 8, 60):
        same(shards.balanced_shards(docs, n, ranges=5).collect(), rows, n)
    assert shards.balanced_shards(docs.where("false")).count() == 0
