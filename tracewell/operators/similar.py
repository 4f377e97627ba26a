"""Pairs of labels that look alike."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pieces(label: str, parts: int) -> list[str]:
    cut = [round(i * len(label) / parts) for i in range(parts + 1)]
    return [label[a:b] for a, b in zip(cut, cut[1:], strict=False) if b > a]


def similar_labels(rows: DataFrame, key: str, label: str, least: float = 0.88, most_gap: int = 6) -> DataFrame:
    """(a, b, label_a, label_b, similarity): pairs of different labels whose lengths differ by most_gap at most and whose
    matching-block ratio is `least` or more; a has the smaller key. Labels under four signs pair with none.

    A pair at the ratio has at most d = (1 - least) * (length a + length b) signs that don't match, so of d + 1 pieces
    of one label at least one stands whole in the other: labels meet under pieces, never all with all. Equal labels
    meet once, as their smallest key.
    """
    names = rows.select(F.lower(F.trim(F.col(label))).alias("label"), F.col(key).alias("id")).where(F.length("label") >= 4).groupBy("label").agg(F.min("id").alias("id"))

    def unmatched(n: int) -> int:
        """Signs without a match in the longest pair that a label of n signs can be in."""
        longest = min(n + most_gap, int(n * (2 - least) / least))
        return int((1 - least) * (n + longest) + 1e-9)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += {(text, i, 0, f"{len(text)}:{p}") for p in _pieces(text, unmatched(len(text)) + 1)}
                for n in range(max(4, len(text) - most_gap), len(text) + most_gap + 1):
                    sizes = {len(p) for p in _pieces("x" * n, unmatched(n) + 1)}
                    out += {(text, i, 1, f"{n}:{text[s : s + k]}") for k in sizes for s in range(len(text) - k + 1)}
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate([pa.string(), pa.int64(), pa.int32(), pa.string()])], ["label", "id", "side", "piece"])

    dealt = names.select("label", F.col("id").cast("long")).mapInArrow(deal, "label string, id long, side int, piece string")
    a = dealt.where("side = 0").select("piece", F.col("label").alias("la"), F.col("id").alias("ia"))
    b = dealt.where("side = 1").select("piece", F.col("label").alias("lb"), F.col("id").alias("ib"))
    pairs = a.join(b, "piece").where(f"la <> lb AND abs(length(la) - length(lb)) <= {most_gap}")
    first = F.col("ia") <= F.col("ib")
    pairs = pairs.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), F.when(first, F.col("la")).otherwise(F.col("lb")).alias("label_a"), F.when(first, F.col("lb")).otherwise(F.col("la")).alias("label_b")).distinct()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = [round(SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r, pa.float64())], ["a", "b", "label_a", "label_b", "similarity"])

    return pairs.mapInArrow(measure, "a long, b long, label_a string, label_b string, similarity double").where(F.col("similarity") >= least)
