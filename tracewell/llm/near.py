"""Near-duplicates by words: SimHash over sets of five words, pigeonhole blocks, Hamming check, then the sets themselves.

Beside the fingerprints of `simhash`, which link by bits alone, these are wider, since texts of a similarity of 0.8
differ in a seventh of their bits. A fingerprint's bits are put in ROUNDS orders and split into BLOCKS each time; texts
meet that share any block. All within BLOCKS - 1 bits do; of those at the least similarity about nineteen in twenty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import freeing, fresh, in_small_batches, split_by, word_blocks
from tracewell.operators.components import connected_components
from tracewell.scratch import discard, written

#: Words of a shingle, and the least Jaccard similarity of two texts' sets of them.
WIDTH, SIMILAR = 5, 0.8
BITS, BLOCKS, ROUNDS = 128, 6, 16
#: Fingerprints of one block that differ in MEET bits or fewer are candidates; in SURE or fewer they are linked as they
#: are (a similarity of about 0.93), others only after their sets were compared.
MEET, SURE = 36, 8
#: A bucket beyond BUCKET is dealt out anew; rows of a bucket that are held against the others at once.
BUCKET, STEP = 1 << 15, 64


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct XXH64 of the lower-cased (A-Z) word shingles; of fewer words than a shingle, of all of them."""
    found, tail, digest = [np.zeros(0, np.uint64)], [], xxhash.xxh64_intdigest
    for block in word_blocks(text.lower()):
        words = tail + block
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            found = [np.unique(np.concatenate([*found, np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(words) - width + 1)]))]
        tail = words[-(width - 1) :] if width > 1 else []
    if not len(found[0]) and tail:
        return np.array([digest(b" ".join(tail), 42)], np.uint64)
    return found[0]


def set_fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit SimHash of a set of shingle hashes, as two longs; 0 of an empty one."""
    if not len(shingles):
        return 0, 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14)]
        with np.errstate(over="ignore"):
            more = (part ^ part >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            more ^= more >> np.uint64(32)
        both = np.stack([part, more], 1).view(np.uint8).reshape(len(part), -1)
        ones += np.unpackbits(both, axis=1, bitorder="little").sum(0, dtype=np.int64)
    a, b = np.packbits(ones * 2 > len(shingles), bitorder="little").view("<i8")
    return int(a), int(b)


def nodes_of(fps: np.ndarray) -> np.ndarray:
    """One long for each fingerprint (rows of two): its name in links."""
    turned = fps[:, 1] << np.uint64(1) | fps[:, 1] >> np.uint64(63)
    return (fps[:, 0] ^ turned).view(np.int64)


def blocks_of(level: int) -> np.ndarray:
    """A column for each block, with the powers of two of its bits."""
    g, out = np.random.default_rng(level), []
    for _ in range(ROUNDS):
        for bits in np.array_split(g.permutation(BITS), BLOCKS):
            column = np.zeros(BITS, np.float32)
            column[bits] = 2.0 ** np.arange(len(bits))
            out.append(column)
    return np.stack(out, 1)


def dealt(fps: np.ndarray, before: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint under each block; a bucket dealt out again stays apart by its key."""
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    value = (bits @ blocks_of(level)).astype(np.int64)
    key = value | np.arange(value.shape[1]) << 32
    with np.errstate(over="ignore"):
        key = (key + before[:, None]) * np.int64(0x2545F4914F6CDD1D)
    return np.repeat(np.arange(len(fps)), value.shape[1]), key.ravel()


def tree(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges (positions) of a minimum spanning forest of the fingerprints within `distance`: two that are close are
    joined by a path of edges none of which is longer than their own distance."""
    near, source, left, rest = np.full(len(fps), BITS + 1, np.uint8), np.zeros(len(fps), np.int64), np.arange(len(fps)), fps
    out, at, done = [], 0, 0
    for _ in range(len(fps) - 1):
        x = int(left[at])
        d = np.bitwise_count(rest ^ fps[x]).sum(1, dtype=np.uint8)
        closer = (d < near) & (near < 255)
        near[closer], source[closer] = d[closer], x
        near[at] = 255  # in the forest
        done += 1
        if 2 * done > len(near):
            keep = near < 255
            near, source, left, rest, done = near[keep], source[keep], left[keep], rest[keep], 0
        at = int(near.argmin())
        if near[at] <= distance:
            out.append((int(source[at]), int(left[at])))
    return out


def bucket_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Candidate edges of one bucket."""
    return tree(fps, MEET)


def bucket_pairs(fps: np.ndarray, group: np.ndarray) -> Iterator[np.ndarray]:
    """All pairs (positions) of one bucket within MEET that are of different groups, for a few rows at a time."""
    for at in range(0, len(fps), STEP):
        d = np.bitwise_count(fps[at : at + STEP, None] ^ fps[None, at:]).sum(2, dtype=np.uint8)
        x, y = np.nonzero((d <= MEET) & (group[at : at + STEP, None] != group[None, at:]))
        yield np.stack([x, y], 1)[y > x] + at


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b) or (key, a, b, c) come sorted by key. Gives candidates (src, dst, bits) and, for a bucket beyond
    the bound, its rows again for the next level. Holds one bucket of bounded size. Where rows have a group c, the
    candidates are all pairs of different groups."""
    names = ["src", "dst", "bits", "key", "a", "b", "c"]

    def out(fps: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        x, y = fps[edges[:, 0]], fps[edges[:, 1]]
        ends = np.sort(np.stack([nodes_of(x), nodes_of(y)], 1), axis=1)
        none = pa.nulls(len(edges), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(np.bitwise_count(x ^ y).sum(1).astype(np.int64)), none, none, none, none], names)

    def again(key: np.ndarray, fps: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(key), pa.array(fps[:, 0].view(np.int64)), pa.array(fps[:, 1].view(np.int64)), pa.array(group)], names)

    def compared(key: np.ndarray, fps: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[new, len(key)])
        of, edges = np.repeat(np.arange(len(new)), size), []
        small = size[of] <= 4
        for s in range(1, 4):
            row = np.flatnonzero(small[s:] & (of[s:] == of[:-s]))
            near = np.bitwise_count(fps[row + s] ^ fps[row]).sum(1) <= MEET
            if apart:
                near &= group[row + s] != group[row]
            edges.append(np.stack([row[near], row[near] + s], 1))
        for k in np.flatnonzero((size > 4) & (size <= BUCKET)):
            if apart:
                own = slice(new[k], new[k] + size[k])
                yield from (out(fps[own], e) for e in bucket_pairs(fps[own], group[own]) if len(e))
                continue
            edges.append(np.array(bucket_links(fps[new[k] : new[k] + size[k]]), int).reshape(-1, 2) + new[k])
        yield out(fps, np.concatenate(edges))
        over = (size > BUCKET)[of]
        if over.any():
            yield again(key[over], fps[over], group[over])

    key, fps, group, heavy, apart = np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), None, False
    for batch in batches:
        apart = batch.num_columns > 3
        k, a, b = (batch.column(i).to_numpy() for i in range(3))
        key, fps = np.r_[key, k], np.concatenate([fps, np.stack([a, b], 1).view(np.uint64)])
        group = np.r_[group, batch.column(3).to_numpy() if apart else np.zeros(len(k), np.int64)]
        if heavy is not None:  # the rest of a bucket that is being passed on
            n = int(np.argmin(np.r_[key == heavy, False]))
            if n:
                yield again(key[:n], fps[:n], group[:n])
                key, fps, group = key[n:], fps[n:], group[n:]
            heavy = heavy if not len(key) else None
        if not len(key):
            continue
        last = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])  # the last bucket may go on
        if len(key) - last > BUCKET:
            heavy, last = key[-1], len(key)
        yield from compared(key[:last], fps[:last], group[:last])
        key, fps, group = key[last:], fps[last:], group[last:]
    if len(key) > 1:
        yield from compared(key, fps, group)


def candidates(distinct: DataFrame) -> DataFrame:
    """(src, dst, bits): pairs of names of the fingerprints of `distinct` (a, b) that a bucket's spanning forest has; where
    it has a group c too, all pairs of one bucket within MEET that are of different groups.

    A bucket of more than BUCKET fingerprints is dealt out again by blocks of another order, up to four times.
    """
    own = [c for c in ("a", "b", "c") if c in distinct.columns]
    rows, out = distinct.select(F.lit(0).cast("long").alias("key"), *own), None
    kind = "key long, " + ", ".join(f"{c} long" for c in own)
    for level in range(5):

        def deal(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    before, *values = (b.column(i).to_numpy()[at : at + 2048] for i in range(b.num_columns))
                    row, key = dealt(np.stack(values[:2], 1).view(np.uint64), before, level)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(v[row]) for v in values)], ["key", *own])

        met = rows.mapInArrow(freeing(deal), kind).repartition("key").sortWithinPartitions("key")
        found = written(met.mapInArrow(freeing(_pairs), "src long, dst long, bits long, key long, a long, b long, c long"), "links")
        got = found.where("src IS NOT NULL").select("src", "dst", "bits")
        out = got if out is None else out.unionByName(got)
        rows = found.where("src IS NULL").select("key", *own)
        if rows.isEmpty():
            return out.distinct()
    raise RuntimeError(f"buckets of over {BUCKET} fingerprints remain; the bound is too small")


def _similar(docs: DataFrame, text_col: str, prints: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (src, dst) of fingerprints whose texts' shingle sets have a Jaccard similarity of `least`."""
    asked = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
    one = written(prints.join(asked, "node").groupBy("node").agg(F.min("v").alias("v")), "asked")  # one text of each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, WIDTH).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(both >= least * (len(x) + len(y) - both))
            yield b.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts, _ = split_by(docs.select(F.xxhash64(text).alias("v"), F.encode(text, "UTF-8").alias("b")), F.col("v"), one, F.col("v"))
    texts = texts.groupBy("v").agg(F.first("b").alias("b")).join(one, "v").select("node", "b")  # copies meet before the shuffle
    sets = written(in_small_batches(texts).mapInArrow(freeing(run), "node long, shingles binary"), "shingles")
    met = pairs.join(sets.select(F.col("node").alias("src"), F.col("shingles").alias("x")), "src").join(sets.select(F.col("node").alias("dst"), F.col("shingles").alias("y")), "dst")
    return in_small_batches(met.select("src", "dst", "x", "y")).mapInArrow(freeing(jaccard), "src long, dst long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """(id, v, component), one row per row of docs: v is the text's hash, component names its group.

    Texts are linked whose sets of WIDTH words (lower-cased) have a Jaccard similarity of `least` or more, as far as
    their fingerprints meet. Null and empty texts have no words and are one group.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([set_fingerprint(shingle_set(t, WIDTH)) for t in b.column(2).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes_of(fps.view(np.uint64))), pa.array(fps[:, 0]), pa.array(fps[:, 1])], ["id", "v", "node", "a", "b"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("v"), F.encode(text, "UTF-8").alias("b"))
    prints = written(in_small_batches(rows).mapInArrow(freeing(run), "id long, v long, node long, a long, b long"), "fingerprints")
    links = candidates(prints.select("a", "b").distinct())
    found = written(links, "candidates")
    discard(links)
    groups = connected_components(found.where(F.col("bits") <= SURE).select("src", "dst"))
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    asked = found.where(F.col("bits") > SURE).join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    asked = written(asked.where(F.coalesce("_src", "src") != F.coalesce("_dst", "dst")).select("src", "dst"), "asked")
    if not asked.isEmpty():
        joined = lambda more: connected_components(groups.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more))
        groups = joined(_similar(docs, text_col, prints, asked, least))
        # A forest has one path between two fingerprints. Where a link of it was refused, what it held together may still
        # hold by others: of those fingerprints every pair that lies in different groups by now is asked for.
        parted = asked.join(of("src"), "src", "left").join(of("dst"), "dst", "left").where(F.coalesce("_src", "src") != F.coalesce("_dst", "dst"))
        parted = written(parted.select("src", "dst"), "parted")
        if not parted.isEmpty():
            whole = connected_components(found.select("src", "dst"))
            torn = whole.join(parted.select(F.col("src").alias("node")), "node", "left_semi").select("component").distinct()
            nodes = whole.join(torn, "component", "left_semi").select("node")
            again = prints.select("node", "a", "b").distinct().join(nodes, "node", "left_semi").join(groups, "node", "left")
            links = candidates(written(again.select("a", "b", F.coalesce("component", "node").alias("c")), "again"))
            rest = written(links.select("src", "dst").join(asked, ["src", "dst"], "left_anti"), "rest")
            if not rest.isEmpty():
                groups = joined(_similar(docs, text_col, prints, rest, least))
    return prints.join(groups, "node", "left").select("id", "v", F.coalesce("component", "node").alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """docs without near-duplicates (see near_groups): of each group one row stays, with all its columns.

    It is the row with the smallest doc_id, nulls last; of several with that id the one whose text has the smallest
    hash; of rows alike in both one. Rows are told apart by id and text, so different texts under one id, or under
    none, do not stand for each other. A null text counts as an empty one; texts without words are one group. An
    empty table gives an empty result.
    """
    found = written(near_groups(docs, id_col, text_col, least), "components")
    alike = found.groupBy("component", "id", "v").agg(F.count("*").alias("n"))
    alike = written(alike.withColumn("no", F.col("id").isNull()), "alike")
    first = alike.groupBy("component").agg(F.min(F.struct("no", "id", "v")).alias("x"))
    goes = alike.join(first, "component").withColumn("stays", F.struct("no", "id", "v").eqNullSafe(F.col("x"))).where("NOT stays OR n > 1")
    key, version, stays = fresh(docs.columns, "key", "again", "later")
    goes = written(goes.select(F.col("id").alias(key), F.col("v").alias(version), F.col("stays").alias(stays)), "goes")
    text, doc_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    some, none = split_by(docs, F.xxhash64(doc_id, F.xxhash64(text)), goes, F.xxhash64(key, version))
    met = some.join(goes, doc_id.eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(version)), "left")
    once, copies = met.where(F.col(stays).isNull()), met.where(F.col(stays)).dropDuplicates([key, version])
    return none.unionByName(once.unionByName(copies).drop(key, version, stays))
