"""Isolation forest over entity features: trees from small samples, scores in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.scratch import written

#: Rows of a tree's sample and number of trees: together the bound of what is gathered to build them.
SAMPLE, TREES, LEAST = 256, 100, 8


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature, cut, left, right, depth + mean path): inner nodes have a feature of 0 or more."""
    nodes: list = []
    most = int(np.ceil(np.log2(max(2, len(x)))))

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        low, high = rows.min(0), rows.max(0)
        wide = np.flatnonzero(high > low)
        if depth >= most or len(rows) <= 1 or not len(wide):
            nodes[at] = (-1, 0.0, 0, 0, depth + float(_mean_path(len(rows))))
            return at
        f = int(rng.choice(wide))
        cut = float(rng.uniform(low[f], high[f]))
        if cut <= low[f]:  # between neighbouring numbers, such as sums added in another order, there is none
            cut = float(high[f])
        left = rows[:, f] < cut
        nodes[at] = (f, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1), 0.0)
        return at

    grow(x, 0)
    return nodes


def isolation_scores(features: DataFrame, cols: list[str], key: str = "entity_id", seed: int = 42) -> DataFrame:
    """(key, ml_score) from 0 to 1, higher for odder rows: the forest's scores scaled between their least and greatest.

    Trees are built from TREES samples of SAMPLE rows, taken by hash. With fewer than LEAST rows the result is empty;
    if all scores are equal they are 0.
    """
    rows = written(features.select(key, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols)), "rows")
    total = rows.count()
    if total < LEAST:
        return rows.limit(0).select(key, F.lit(0.0).alias("ml_score"))
    drawn = rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(SAMPLE * TREES).toPandas()[cols].to_numpy(float)
    rng = np.random.default_rng(seed)
    size = min(SAMPLE, total)
    trees = [_tree(drawn[rng.choice(len(drawn), min(size, len(drawn)), replace=False)], rng) for _ in range(TREES)]
    kind = features.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, b.num_columns)], 1) if b.num_rows else np.zeros((0, len(cols)))
            depth = np.zeros(len(x))
            for t in trees:
                at, live = np.zeros(len(x), int), np.arange(len(x))
                f, cut, left, right, path = (np.array(c) for c in zip(*t, strict=True))
                while len(live):
                    inner = f[at[live]] >= 0
                    live = live[inner]
                    go = x[live, f[at[live]]] < cut[at[live]]
                    at[live] = np.where(go, left[at[live]], right[at[live]])
                depth += path[at]
            score = 2.0 ** (-depth / len(trees) / max(float(_mean_path(size)), 1e-9))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], [key, "s"])

    s = written(rows.mapInArrow(run, f"`{key}` {kind}, s double"), "scores")
    ends = s.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return s.crossJoin(F.broadcast(ends)).select(key, scaled.alias("ml_score"))
