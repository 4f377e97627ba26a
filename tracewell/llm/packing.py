"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents become pieces of at most `capacity` tokens. Pieces are dealt out evenly; every task packs its own by best fit,
longest first, and closes the bins that are nearly full. The others go on as items, with all they hold, to fewer tasks,
round by round, until one task had all of them or there is nothing left to merge.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import in_small_batches
from tracewell.llm.vocab import BYTE_BPE, byte_level
from tracewell.scratch import written

CAPACITY, END = 1024, 2
#: Items that a task packs at a time.
ITEMS = 1 << 15
#: A bin is closed when at most one part in so many of it is empty.
NEARLY = 64
#: Rounds go on while each merges at least one in so many of its items into another.
WORTH = 64


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if asked for, ids): each document's tokens and the id `end`, cut
    into pieces of `capacity`, of which the first may be shorter. Without a shuffle."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = byte_level(path, special=True)
        for b in batches:
            out: list[list] = [[] for _ in fields]
            for doc_id, ids in zip(b.column(0).to_pylist(), vocab.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids = np.append(ids, end).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, start in enumerate((0, *range(first, len(ids), capacity))):
                    own = ids[start : (start or first) + capacity * (start > 0)]
                    row = (doc_id, k, start, len(own), zlib.crc32(own.tobytes()), own.astype(np.int32))
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(out, fields, strict=True)], [n for n, _ in fields])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item: longest first, each into the bin whose room it leaves smallest, else into a new one."""
    order = np.argsort(-sizes, kind="stable")
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r: there is a bin with room r
    out = np.empty(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            b, room, n = n, capacity, n + 1
        out[i] = b
        if room > size:
            with_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return out


def merged(fill: np.ndarray, members: pa.ListArray, capacity: int) -> tuple[np.ndarray, pa.ListArray]:
    """Items packed by best fit: the bins' fills and members, whose offsets now are those in the bin."""
    of = best_fit(fill, capacity)
    order = np.argsort(of, kind="stable")
    own = members.take(pa.array(order))
    fill, of = fill[order], of[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    before = np.cumsum(fill) - fill
    base = before - np.repeat(before[first], np.diff(np.r_[first, len(of)]))
    counts = np.diff(own.offsets.to_numpy())
    flat = own.flatten()
    names = [f.name for f in flat.type]
    columns = [flat.field(n) for n in names]
    k = names.index("offset")
    columns[k] = pa.array(columns[k].to_numpy() + np.repeat(base, counts))
    upto = np.r_[0, np.cumsum(counts)]
    starts = np.r_[upto[first], upto[-1]].astype(np.int32)
    return np.add.reduceat(fill, first) if len(of) else fill, pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(columns, fields=list(flat.type)))


def _round(bins: DataFrame, tasks: int, capacity: int, nearly: int, items: int) -> DataFrame:
    """One round: bins dealt evenly to so many tasks, each packed by best fit; closed says which are nearly full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            fill, members = merged(t.column("fill").to_numpy(), t.column("members").combine_chunks() if t.num_rows else t.column("members"), capacity)
            return pa.RecordBatch.from_arrays([pa.array(fill), pa.array(fill * nearly >= capacity * (nearly - 1)), members], ["fill", "closed", "members"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= 2 * items:  # more than was dealt: keep what a task holds bounded
                yield packed()
                held = []
        if held:
            yield packed()

    return bins.select("fill", "members").repartition(tasks).mapInArrow(run, f"fill long, closed boolean, members {bins.schema['members'].dataType.simpleString()}")


def bins(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BYTE_BPE, capacity: int = CAPACITY, end: int = END, nearly: int = NEARLY, items: int = ITEMS, with_ids: bool = False) -> DataFrame:
    """(sequence_id, members), one row per sequence: its pieces in their order, each with its offset."""
    cut = pieces(docs, id_col, text_col, path, capacity, end, with_ids).withColumn("offset", F.lit(0).cast("long"))
    rows = written(cut.select(F.col("length").alias("fill"), (F.col("length") == capacity).alias("closed"), F.array(F.struct(*cut.columns)).alias("members")), "pieces")
    done, open_, last = [rows.where("closed")], rows.where("NOT closed"), False
    n = open_.count()
    while n and not last:
        tasks = -(-n // items)
        rows = written(_round(open_, tasks, capacity, nearly, items), "packed")
        done.append(rows.where("closed"))
        left, before = rows.count(), n
        open_ = rows.where("NOT closed")
        n = open_.count()
        last = tasks == 1 or (before - left) * WORTH < before
    whole = reduce(DataFrame.unionByName, [*done, open_])
    return whole.select(F.monotonically_increasing_id().alias("sequence_id"), "members")


def pack(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece of each row of docs.

    Sequences hold at most `capacity` tokens, gapless from offset 0. A null or empty text is its end token alone.
    Repeated rows, rows of one id and rows without id are packed like any other; ties are broken by the order in which
    rows are dealt; other columns are ignored; an empty table gives an empty result. settings are those of bins().

    A task holds the lengths and places of some ten thousand pieces, no texts; rounds are written, so a lost executor
    costs one task's packing. The last round closes what no other bin can take.
    """
    return bins(docs, **settings).select("sequence_id", F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, **settings) -> DataFrame:
    """(sequence_id, ids, parts): the packed token ids of each sequence, and which piece stands where. Tokens travel
    with their pieces, so a sequence is put together inside its row."""
    found = bins(docs, with_ids=True, **{"items": 1 << 13} | settings)
    parts = F.transform("members", lambda m: F.struct(m["doc_id"].alias("doc_id"), m["piece"].alias("piece"), m["offset"].alias("offset"), m["length"].alias("length")))
    return found.select("sequence_id", F.flatten(F.transform("members", lambda m: m["ids"])).alias("ids"), parts.alias("parts"))
