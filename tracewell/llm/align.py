"""Cross-tokenizer alignment by a sweep over the places where tokens end.

Each document's tokens under two vocabularies become end events, in blocks of one side that lie in a row. The events of
both sides are brought together by document and sorted by their offset; one pass over them, whose state is the tokens
since the last common end, emits the groups between common ends and the links of the two tokens that end there. How
often a pair of ids is linked is then counted over all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import in_small_batches
from tracewell.llm.vocab import BYTE_BPE, PIECE_BPE, Vocabulary, byte_level, pieces
from tracewell.scratch import written

#: Tokens of a block of events.
BLOCK = 1 << 14
#: A pair that holds at least one in so many links is looked up in a broadcast table, which so many pairs bound.
FREQUENT = 1 << 17
A, B = 0, 1


def end_events(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str = BYTE_BPE, path_b: str = PIECE_BPE, block: int = BLOCK) -> DataFrame:
    """(row, doc_id, side, first, ids): blocks of consecutive end events. Each is a token's id; the first token of the
    block begins at byte `first`, the others where the one before ends, as the vocabulary's bytes say.

    row tells rows of docs apart, whatever ids they have. Texts without tokens, and those whose joined bytes are not a
    space and the text, have one empty block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), pieces(path_b)
        for batch in batches:
            rows, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t or "" for t in batch.column(2).to_pylist()]
            out: list[list] = [[], [], [], [], []]
            for row, doc_id, text, own_a, own_b in zip(rows, doc_ids, texts, a.encode([f" {t}" for t in texts]), b.encode(texts), strict=True):
                want = f" {text}".encode("utf-8", "replace")
                whole = text != "" and b.joined(own_b) == want and a.joined(own_a) == want
                for side, vocab, ids in ((A, a, own_a), (B, b, own_b)) if whole else ((A, a, own_a[:0]),):
                    first = 0
                    for k in range(0, len(ids) or 1, block):
                        part = ids[k : k + block]
                        for column, value in zip(out, (row, doc_id, side, first, _packed(part, vocab)), strict=True):
                            column.append(value)
                        first += int(vocab.sizes[part].sum())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], ["row", "doc_id", "side", "first", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(run, "row long, doc_id long, side int, first long, ids binary")


def _kind(vocab: Vocabulary) -> type:
    return np.uint16 if vocab.size <= 1 << 16 else np.uint32


def _packed(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    return ids.astype(_kind(vocab)).tobytes()


class _Names:
    """Decimal ids with the sign that follows them, as rows of bytes filled up with zeros."""

    def __init__(self, size: int, ends: bytes) -> None:
        width = len(str(size)) + 1
        names = [f"{i}{chr(e)}".encode() for i in range(size) for e in ends]
        self.rows = np.frombuffer(b"".join(n.ljust(width, b"\0") for n in names), np.uint8).reshape(-1, width)

    def of(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.rows[2 * ids + last]


class Sweep:
    """The pass over one document's events. State: both sides' tokens since the last common end, three counts, a hash."""

    def __init__(self, names_a: _Names, names_b: _Names) -> None:
        self.names = names_a, names_b
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ends = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.n = [0, 0]
        self.n_groups = 0
        self.hash = hashlib.sha256()

    def feed(self, side: int, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes a block; returns the links (ids of A, ids of B) at the common ends that are now known."""
        self.n[side] += len(ids)
        self.ids[side] = np.concatenate([self.ids[side], ids]) if len(self.ids[side]) else ids
        self.ends[side] = np.concatenate([self.ends[side], ends]) if len(self.ends[side]) else ends
        (a, b), (ends_a, ends_b) = self.ids, self.ends
        if not len(a) or not len(b):
            return a[:0], b[:0]
        low, high = min(ends_a[0], ends_b[0]), min(ends_a[-1], ends_b[-1])
        both = np.zeros((2, high - low + 1), bool)
        both[0, ends_a[: np.searchsorted(ends_a, high, "right")] - low] = True
        both[1, ends_b[: np.searchsorted(ends_b, high, "right")] - low] = True
        count_a, count_b = np.cumsum(both, axis=1)
        at = np.flatnonzero(both.all(0))
        if not len(at):
            return a[:0], b[:0]
        last_a, last_b = count_a[at] - 1, count_b[at] - 1  # the tokens that end there
        n_a, n_b = int(last_a[-1]) + 1, int(last_b[-1]) + 1
        self._write(a[:n_a], b[:n_b], last_a, last_b)
        self.n_groups += len(at)
        links = a[last_a], b[last_b]
        self.ids, self.ends = [a[n_a:], b[n_b:]], [ends_a[n_a:], ends_b[n_b:]]
        return links

    def _write(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> None:
        """Adds the groups `a1,a2|b1` with a `;` between them to the hash."""
        stop_a, stop_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        stop_a[last_a] = stop_b[last_b] = 1
        group_a, group_b = np.cumsum(stop_a) - stop_a, np.cumsum(stop_b) - stop_b
        before_b = np.r_[0, last_b[:-1] + 1]
        rows = np.empty((len(a) + len(b), max(n.rows.shape[1] for n in self.names)), np.uint8)
        rows[:] = 0
        for names, ids, stop, where in ((self.names[A], a, stop_a, np.arange(len(a)) + before_b[group_a]), (self.names[B], b, stop_b, np.arange(len(b)) + last_a[group_b] + 1)):
            rows[where, : names.rows.shape[1]] = names.of(ids, stop)
        text = rows[rows != 0].tobytes()
        if self.n_groups:
            self.hash.update(b";")
        self.hash.update(text[:-1])


def swept(events: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times): for each block its links, as numbers
    id of A * size of B + id of B, and how often; with a document's last block also its counts and the hash of its
    groups ('' without tokens). Blocks may come from anywhere: they are dealt out by document and sorted by offset."""
    size_b = pieces(path_b).size
    pair = (pa.int32(), "int") if byte_level(path_a).size * size_b < 1 << 31 else (pa.int64(), "long")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pair[0]), pa.list_(pa.int32())]
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabs = byte_level(path_a), pieces(path_b)
        own_names = _Names(vocabs[A].size, b",|"), _Names(vocabs[B].size, b",;")
        now, doc, sweep = None, None, Sweep(*own_names)

        def total() -> tuple:
            n_a, n_b = sweep.n
            return now, doc, n_a, n_b, sweep.n_groups, sweep.hash.hexdigest() if n_a else "", [], []

        for b in batches:
            out = []
            for row, doc_id, side, first, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if row != now:
                    if now is not None:
                        out.append(total())
                    now, doc, sweep = row, doc_id, Sweep(*own_names)
                ids = np.frombuffer(data, _kind(vocabs[side])).astype(np.int64)
                own_a, own_b = sweep.feed(side, ids, np.cumsum(vocabs[side].sizes[ids]) + first)
                if len(own_a):
                    pairs, times = np.unique(own_a * size_b + own_b, return_counts=True)
                    out.append((row, doc_id, None, None, None, None, pairs, times))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(total(), kinds, strict=True)], names)

    dealt = events.repartition("row").sortWithinPartitions("row", "first", "side")
    return dealt.mapInArrow(run, f"row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<{pair[1]}>, times array<int>")


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): how many links each pair of ids holds, and whether no other pair of its id of B holds more.
    Pairs are summed before they are shuffled; the greatest counts are a row for each id of B."""
    counts = written(links.groupBy("pair").agg(F.sum("times").alias("count")), "pairs")
    most = counts.groupBy(F.pmod("pair", F.lit(size_b)).alias("id_b")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), F.pmod("pair", F.lit(size_b)) == F.col("id_b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str = BYTE_BPE, path_b: str = PIECE_BPE, block: int = BLOCK, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of docs.

    Null and empty texts, and those that either vocabulary does not give back byte by byte, have zeros and ''.
    Repeated rows and rows of one id come out by themselves and all count; rows without id too. Ties for the greatest
    count of an id of B are all best. Other columns are ignored; an empty table gives an empty result.

    A task streams over events, one block at a time. Pairs that hold 1 / `frequent` of all links, `frequent` at most,
    are broadcast; the links of the others, none of which is common, meet their counts in a shuffled join.
    """
    found = written(swept(end_events(docs, id_col, text_col, path_a, path_b, block), path_a, path_b), "swept")
    size_b = pieces(path_b).size
    links = found.where("groups_sha256 IS NULL").select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    counts = written(pair_counts(links, size_b), "counts")
    least = counts.agg(F.sum("count").alias("total")).select(F.col("total") / frequent)
    bound = (least.first()[0] or 0.0)
    common, rare = counts.where(F.col("count") >= bound), counts.where(F.col("count") < bound)
    met = links.join(F.broadcast(common), "pair", "left")
    some = met.where("count IS NOT NULL").select("row", "times", "count", "best")
    others = met.where("count IS NULL").select("row", "times", "pair").join(rare, "pair").select("row", "times", "count", "best")
    none = F.lit(0).cast("long")
    sums = some.unionByName(others).groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    totals = found.where("groups_sha256 IS NOT NULL").select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    return totals.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", *(F.coalesce(c, none).alias(c) for c in ("n_links", "n_best", "count_sum")), "groups_sha256")
