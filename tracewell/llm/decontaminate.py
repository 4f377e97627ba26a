"""Benchmark decontamination over a positional inverted index that is dealt out by documents.

The index has one row per shard, a bounded run of documents: its terms, for each term the places where it stands, and
its documents' ids and first places. A phrase is searched in every shard: the list of its rarest term gives candidate
places, which the lists of its other terms, moved by their offsets, thin out from the rarest on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import freeing, fresh, in_small_batches, split_by, word_blocks
from tracewell.scratch import discard, written

WINDOW = 10
#: Words of a shard, unless one document has more; words of a block of benchmark items that is searched at once.
SHARD_WORDS, BLOCK_WORDS = 1 << 18, 1 << 19
#: Signs between words become spaces, capitals small letters; all other bytes are word signs.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


SCHEMA = "shard string, terms binary, counts binary, places binary, doc_ids array<long>, starts binary, n_words binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The index of whole texts, written to the shared folder. Tasks hold one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, doc_ids, starts, sizes, at = _Ids(), [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            code = np.concatenate([c for c, _ in parts]) if parts else np.zeros(0, np.int64)
            place = np.concatenate([np.arange(p, p + len(c)) for c, p in parts]) if parts else np.zeros(0, np.int64)
            order = np.argsort(code, kind="stable")
            row = [uuid.uuid4().hex, b" ".join(ids), np.bincount(code, minlength=len(ids)).astype(np.uint32).tobytes(), place[order].astype(np.uint32).tobytes(), doc_ids, np.array(starts, np.uint32).tobytes(), np.array(sizes, np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()], strict=True)], ["shard", "terms", "counts", "places", "doc_ids", "starts", "n_words"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                starts.append(at)
                begin = at
                for words in word_blocks((text or b"").translate(_FOLD)):
                    parts.append((np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), at))
                    at += len(words)
                sizes.append(at - begin)
                at += 1 << 12  # no phrase reaches into the next document, near matches neither
                if at - (len(starts) << 12) >= shard_words or len(starts) >= 1 << 14:
                    yield shard()
                    ids, parts, doc_ids, starts, sizes, at = _Ids(), [], [], [], [], 0
        if doc_ids:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("b"))
    return written(in_small_batches(rows).mapInArrow(freeing(run), SCHEMA), "index")


@dataclass
class Phrases:
    """Distinct phrases of one length or less each: rows of term numbers (-1 beyond the end), and their items."""

    terms: dict[bytes, int]
    rows: np.ndarray
    items: list[list[str]]


def windows(items: list[tuple[str, str]], width: int = WINDOW) -> Phrases:
    """All windows of `width` words of the items; an item of fewer, but not none, is one window."""
    terms, found = _Ids(), {}
    for item, text in items:
        code = [terms[w] for w in words_of(text)]
        for i in range(max(1, len(code) - width + 1) if code else 0):
            found.setdefault(tuple(code[i : i + width]), set()).add(item)
    rows = np.full((len(found), width), -1, np.int64)
    for k, w in enumerate(found):
        rows[k, : len(w)] = w
    return Phrases(dict(terms), rows, [sorted(x) for x in found.values()])


def search_shard(phrases: Phrases, names: bytes, counts: np.ndarray, places: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place): every place in a shard where a phrase begins. With slop, where each term stands within so many
    words of its place in the phrase, as seen from the phrase's rarest term."""
    own = {w: i for i, w in enumerate(names.split(b" "))} if names else {}
    local = np.array([own.get(w, -1) for w in phrases.terms] + [-1], np.int64)
    begin = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    length = (phrases.rows >= 0).sum(1)
    at = local[phrases.rows]
    there = (at >= 0) | (phrases.rows < 0)
    alive = np.flatnonzero(there.all(1) & (length > 0))
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = at[alive]
    size = np.where(at >= 0, counts[at].astype(np.int64), np.iinfo(np.int64).max)
    order = np.argsort(size, axis=1, kind="stable")  # rarest terms first
    keys = np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32 | places
    first, n = at[np.arange(len(at)), order[:, 0]], size[np.arange(len(at)), order[:, 0]]
    row = np.repeat(np.arange(len(at)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = places[begin[first][row] + inner].astype(np.int64) - order[row, 0]
    row, start = row[start >= -slop], start[start >= -slop]
    for k in range(1, phrases.rows.shape[1]):
        off = order[row, k]
        term = at[row, off]
        want = term << 32 | np.maximum(start + off - slop, 0)
        hit = np.searchsorted(keys, want)
        near = np.minimum(hit, len(keys) - 1)
        ok = (term < 0) | (hit < len(keys)) & (keys[near] >> 32 == term) & ((keys[near] & 0xFFFFFFFF) <= start + off + slop)
        row, start = row[ok], start[ok]
    return alive[row], start


def _matches(index: DataFrame, phrases: Phrases, slop: int) -> DataFrame:
    """(shard, at, doc_id, n_words, spans, items) of each indexed document: places [begin, end) of its matches, sorted,
    and their items."""
    sent = index.sparkSession.sparkContext.broadcast((phrases.terms, phrases.rows, phrases.items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Phrases(*sent.value)
        length = (own.rows >= 0).sum(1)
        for b in batches:
            for row in b.to_pylist():
                counts, places, starts, sizes = (np.frombuffer(row[c], t) for c, t in (("counts", np.uint32), ("places", np.uint32), ("starts", np.uint32), ("n_words", np.int64)))
                phrase, place = search_shard(own, row["terms"], counts, places, slop)
                doc = np.searchsorted(starts, np.maximum(place, 0), "right") - 1
                spans: list[set] = [set() for _ in starts]
                items: list[set] = [set() for _ in starts]
                for d, p, s in zip(doc.tolist(), phrase.tolist(), (place - starts[doc]).tolist(), strict=True):
                    spans[d].add((s, s + int(length[p])))
                    items[d].update(own.items[p])
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(starts)), pa.array(range(len(starts)), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(sizes), pa.array([[{"begin": x, "end": y} for x, y in sorted(s)] for s in spans], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["shard", "at", "doc_id", "n_words", "spans", "items"])

    return index.mapInArrow(freeing(run), "shard string, at int, doc_id long, n_words long, spans array<struct<begin: long, end: long>>, items array<string>")


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, words: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark, the stated query set, in blocks of bounded size."""
    block, size = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        block.append((item, text))
        size += len(text) // 4
        if size >= words:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans), one row per row of docs: exact matches of windows, or near ones with slop.

    Null and empty texts have no words and no hits. Items with a null id or text are left out; rows with one item_id
    are parts of one item. Ties and repeated rows come out as often as they are in docs; other columns are ignored;
    an empty table of documents gives an empty result, an empty benchmark no hits. The benchmark is broadcast in
    blocks of a bounded size, each searched in all shards of the one index; texts are never shuffled.
    """
    index, found = build_index(docs, id_col, text_col), []
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        found.append(_matches(index, windows(block, width), slop))
    out = reduce(DataFrame.unionByName, found) if found else _matches(index, windows([], width), slop)
    if len(found) > 1:
        joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        out = out.groupBy("shard", "at").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), joined("spans"), joined("items"))
    inner = F.transform("spans", lambda s, i: F.struct(F.greatest(s["begin"], F.lit(0)).alias("begin"), F.least(s["end"], F.col("n_words")).alias("end")))
    # Spans are sorted by their begin; each adds what lies beyond the spans before it.
    added = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["begin"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")), lambda a: a["n"])
    return out.select("doc_id", "n_words", added.alias("n_hit"), "items", inner.alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without those that hold a benchmark window. What a row's own text holds decides, whatever
    other rows have its id or none. Null texts, ties and repeated rows stay as they are; an empty table gives an
    empty result."""
    (key,) = fresh(docs.columns, "key")
    version = F.xxhash64(text_col)
    keyed = docs.select(version.alias("version"), F.col(text_col).alias("text"))
    found = contamination(keyed, benchmark, "version", "text")
    hit = written(found.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct(), "hit")
    discard(found)
    some, none = split_by(docs, version, hit, F.col(key))
    return none.unionByName(some.join(hit, version == F.col(key), "left_anti"))
