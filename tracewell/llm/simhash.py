"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import in_small_batches, word_blocks
from tracewell.operators.components import connected_components
from tracewell.scratch import written

BLOCKS, DISTANCE = 6, 3
#: A bucket beyond this many fingerprints is not compared in one task but dealt out again by more bits.
BUCKET = 4096


def simhash64(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the lower-cased (A-Z) word shingles, repeats included; 0 without words."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for block in word_blocks(text.lower()):
        words = tail + block
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            h = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(words) - width + 1)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
        tail = words[-(width - 1) :] if width > 1 else []
    if not n and tail:
        return digest(b" ".join(tail), 42)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per document; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash64(t or b"", width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("b"))
    return in_small_batches(rows).mapInArrow(run, "doc_id long, fp long")


def split_bits(bits: list[int], blocks: int) -> list[list[int]]:
    cut = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def masks(inside: int, blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks that keep the bits of `inside` and blocks - distance of the blocks that the other bits are split into.
    Two fingerprints that agree inside and differ in `distance` bits or fewer agree under one of them."""
    free = [b for b in range(64) if not inside >> b & 1]
    parts = [sum(1 << b for b in p) for p in split_bits(free, blocks)]
    return sorted({inside | sum(c) for c in combinations(parts, blocks - distance)})


def spread(fps: np.ndarray, mask: np.ndarray, blocks: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, mask, key) for each row under each of the next level's masks."""
    at, ms = [], []
    for m in np.unique(mask):
        rows, nxt = np.flatnonzero(mask == m), np.array(masks(int(m), blocks, distance), np.uint64)
        at.append(np.repeat(rows, len(nxt)))
        ms.append(np.tile(nxt, len(rows)))
    row, m = np.concatenate(at), np.concatenate(ms)
    return row, m, fps[row] & m


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the fingerprints within `distance`; no list of all pairs."""
    rest, out = np.arange(len(fps)), []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]) <= distance
            found = rest[near]
            out += [(x, y) for y in found]
            front += list(found)
            rest = rest[~near]
    return out


def _compare(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows sorted by (mask, key): small buckets all at once, larger ones by a spanning forest."""
    new = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
    size = np.diff(np.r_[new, len(key)])
    of = np.repeat(np.arange(len(new)), size)
    a, b = [], []
    small = size[of] <= 8
    for s in range(1, 8):
        hit = np.flatnonzero(small[s:] & (of[s:] == of[:-s]) & (np.bitwise_count(fp[s:] ^ fp[:-s]) <= distance))
        a.append(fp[hit])
        b.append(fp[hit + s])
    for k in np.flatnonzero(size > 8):
        own = fp[new[k] : new[k] + size[k]]
        pairs = np.array(forest(own, distance), int).reshape(-1, 2)
        a.append(own[pairs[:, 0]])
        b.append(own[pairs[:, 1]])
    return np.concatenate(a), np.concatenate(b)


def _links(batches: Iterator[pa.RecordBatch], distance: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (mask, key), a bucket perhaps over several batches. Gives links (src, dst) and, for a
    bucket beyond the bound, its rows again (mask, fp) for the next level. Holds one bucket of bounded size."""

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _compare(*rows, distance)
        pair = np.unique(np.sort(np.stack([a, b], 1).view(np.int64), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        none = pa.nulls(len(pair), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), none, none], ["src", "dst", "mask", "fp"])

    def again(mask: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(fp), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(mask.view(np.int64)), pa.array(fp.view(np.int64))], ["src", "dst", "mask", "fp"])

    kept: list[np.ndarray] = [np.zeros(0, np.uint64)] * 3
    heavy: tuple[int, int] | None = None
    for batch in batches:
        rows = [np.concatenate(x) for x in zip(kept, (batch.column(i).to_numpy().view(np.uint64) for i in range(3)), strict=True)]
        mask, key, fp = rows
        if not len(key):
            continue
        if heavy:  # the rest of a bucket that is being passed on
            n = int(np.argmin(np.r_[(mask == heavy[0]) & (key == heavy[1]), False]))
            if n:
                yield again(mask[:n], fp[:n])
                rows = [x[n:] for x in rows]
                mask, key, fp = rows
            if not len(key):
                kept = rows
                continue
            heavy = None
        new = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[new, len(key)])
        last = new[-1]
        done = np.repeat(size <= bucket, size)
        over = ~done
        if size[-1] > bucket:
            heavy = int(mask[-1]), int(key[-1])
            last = len(key)
        if over.any():
            yield again(mask[over], fp[over])
        done[last:] = False
        yield links([x[done] for x in rows])
        kept = [x[last:] for x in rows]
    if len(kept[0]) > 1:
        yield links(kept)


def links(distinct: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(src, dst): links between the fingerprints of `distinct` (fp), enough to connect all within `distance` bits.

    Level by level: rows meet under shared blocks; buckets beyond the bound, if any, are dealt out again by more bits
    until they are small, so no link is lost and no bucket fills a task.
    """
    as_long = [m - (1 << 64) if m >> 63 else m for m in masks(0, blocks, distance)]
    m = F.explode(F.array(*[F.lit(x).cast("long") for x in as_long]))
    rows = distinct.select("fp", m.alias("mask"))
    rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    out = None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask, fp = (b.column(i).to_numpy() for i in range(2))
            for at in range(0, len(fp), 4096):
                row, m, key = spread(fp[at : at + 4096].view(np.uint64), mask[at : at + 4096].view(np.uint64), blocks, distance)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (m.view(np.int64), key.view(np.int64), fp[at : at + 4096][row])], ["mask", "key", "fp"])

    for _level in range(8):
        met = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
        found = written(met.mapInArrow(lambda b: _links(b, distance, bucket), "src long, dst long, mask long, fp long"), "links")
        got = found.where("src IS NOT NULL").select("src", "dst")
        out = got if out is None else out.unionByName(got)
        over = found.where("src IS NULL").select("mask", "fp")
        if over.isEmpty():
            return out
        rows = over.distinct().mapInArrow(deal, "mask long, key long, fp long").distinct()
    raise RuntimeError(f"buckets of over {bucket} fingerprints remain; the bound is too small")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of docs.

    component_id is the smallest doc_id reachable over links of DISTANCE differing bits or fewer. Null and empty
    texts have no words and fingerprint zero, linked like any other. Equal fingerprints meet once, whatever ids they
    have. Rows with a null doc_id link others and get the smallest doc_id of their group, null if it has none.
    Repeated rows come out repeated; other columns are ignored; an empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = connected_components(links(distinct, bucket=bucket))
    member = written(distinct.join(groups, distinct.fp == groups.node, "left").select("fp", F.coalesce("component", "fp").alias("c"), "least"), "members")
    found = member.join(member.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("fp", "component_id")
    return fps.join(found, "fp").select("doc_id", "fp", "component_id")
