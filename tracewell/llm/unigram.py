"""SentencePiece encoding as best-scoring segmentation, giant texts by a max-plus scan over chunks, and decoding.

A text's segmentation is the one of greatest total weight; of equal ones, that whose last piece is longest, then its
last but one, and so on. Weights are integers, so sums are exact in any order. Up to CHUNK signs a text is segmented
as it is. A longer one is cut into chunks. For each, in parallel, a transfer matrix has the greatest weight from each
first piece end inside the chunk to each first piece end beyond it. Max-plus products of neighbours, an associative
step, combine them in blocks, blocks of blocks and so on, and hand down what reaches each chunk; from it each chunk
derives, in parallel, where a path that leaves it came in; these maps, composed from the end by the same scan, fix
every chunk's way out, and each chunk is traced back by itself.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import freeing, in_small_batches
from tracewell.scratch import written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 16
#: Neighbours that one step of the scan combines.
BLOCK = 64
#: Words up to this length are searched many at once.
SHORT = 32
NONE = -(1 << 60)
_BASE = np.uint64(0xD1342543DE82EF95)
MARK = "▁"


def signs_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class Vocabulary:
    """Pieces of a SentencePiece model file with integer weights.

    In a unigram model a piece weighs its score times 2 ** 16. In a BPE model, whose scores are merge ranks and no
    log-probabilities, a piece weighs -2 ** 20 less its rank: fewest pieces first, then earliest merges. A sign that
    no piece begins with weighs 10 * 2 ** 16 below the least piece and becomes the bytes of its UTF-8 form.
    """

    def __init__(self, model: str, cache: int = 150_000) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.GetPieceSize()
        plain = [i for i in range(n) if not (sp.IsControl(i) or sp.IsUnknown(i) or sp.IsByte(i) or sp.IsUnused(i))]
        scores = {i: sp.GetScore(i) for i in plain}
        ranks = [s for s in scores.values() if s > -1e8]
        by_rank = all(s == int(s) for s in ranks) and len(set(ranks)) == len(ranks) and min(ranks) <= -(len(ranks) - 1)
        weigh = (lambda s: -(1 << 20) + int(max(s, -(1 << 18)))) if by_rank else (lambda s: round(s * (1 << 16)))
        self.pieces = {sp.IdToPiece(i): (i, weigh(s)) for i, s in scores.items()}
        self.of_byte = {int(sp.IdToPiece(i)[3:5], 16): i for i in range(n) if sp.IsByte(i)}
        self.unknown_id = sp.unk_id()
        self.unknown = min(w for _, w in self.pieces.values()) - 10 * (1 << 16)
        self.longest = max(map(len, self.pieces))
        #: The weight of each piece; None for what is only the begin of one.
        self.begins: dict[str, int | None] = {p[:k]: None for p in self.pieces for k in range(1, len(p))}
        self.begins |= {p: w for p, (_, w) in self.pieces.items()}
        self.outputs = [sp.IdToPiece(i).replace(MARK, " ").encode() for i in range(n)]
        for b, i in self.of_byte.items():
            self.outputs[i] = bytes([b])
        for i in range(n):
            if sp.IsControl(i):
                self.outputs[i] = b""
        # Between another sign and a word mark, and around a line end that no piece holds, every text has a piece end.
        by_word = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        by_line = not any("\n" in p for p in self.pieces)
        cut = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if by_line else f"{MARK}*[^{MARK}]+|{MARK}+"
        self.words = re.compile(cut if by_word else r"[\s\S]+")
        self.seen, self.cache = {}, cache
        self.powers = np.cumprod(np.r_[np.uint64(1), np.full(SHORT, _BASE)], dtype=np.uint64)
        by_length: dict[int, list[str]] = {}
        for p in self.pieces:
            by_length.setdefault(len(p), []).append(p)
        short = [(self.prefix_hashes(signs_of(ps))[:, -1], ps) for n, ps in by_length.items() if n <= SHORT]
        names = [p for _, ps in short for p in ps]
        hashes = np.concatenate([h for h, _ in short])
        order = np.argsort(hashes)
        self.hashes, self.ids_of, self.weights = hashes[order], np.array([self.pieces[p][0] for p in names], np.int32)[order], np.array([self.pieces[p][1] for p in names], np.int64)[order]
        # By the upper bits of a hash: the last piece that has them, and whether others do.
        top, self.slot, self.shared = self.hashes >> np.uint64(44), np.zeros(1 << 20, np.int32), np.zeros(1 << 20, bool)
        self.slot[top] = np.arange(len(top))
        self.shared[top[1:][top[1:] == top[:-1]]] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes among those of the pieces; -1 for others."""
        top = hashes >> np.uint64(44)
        at = self.slot[top]
        again = np.flatnonzero(self.shared[top])
        at[again] = np.minimum(np.searchsorted(self.hashes, hashes[again]), len(self.hashes) - 1)
        at[self.hashes[at] != hashes] = -1
        return at

    def escaped(self, text: str) -> str:
        return (MARK + text).replace(" ", MARK) if text else ""

    def starting(self, text: str, at: int) -> list[tuple[int, int]]:
        """(length, weight) of the pieces at a place; a lone sign, unknown to the vocabulary, too."""
        out = []
        for to in range(at + 1, len(text) + 1):
            w = self.begins.get(text[at:to], 0)
            if w == 0:  # no piece begins so
                break
            if w is not None:
                out.append((to - at, w))
        if not out or out[0][0] != 1:
            out.insert(0, (1, self.unknown))
        return out

    def ids(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found:
            return [found[0]]
        return [self.of_byte.get(b, self.unknown_id) for b in piece.encode("utf-8", "replace")] if self.of_byte else [self.unknown_id]

    def forward(self, text: str, enters: np.ndarray | list[int], stop: int) -> tuple[list[int], list[int]]:
        """Best weight of each place from the given entries, and the last piece's length (0: an entry). Pieces begin
        before `stop`. Of equal ways the longer last piece wins, and an entry, whose piece began earlier, before all."""
        size, find, unknown, no = len(text), self.begins.get, self.unknown, NONE // 2
        best, back = [NONE] * (size + 1), [0] * (size + 1)
        for a, w in enumerate(enters):
            if a <= size:
                best[a] = int(w)
        for at in range(stop):
            b = best[at]
            if b <= no:
                continue
            lone = True
            for to in range(at + 1, size + 1):
                w = find(text[at:to], 0)
                if w == 0:
                    break
                if w is not None:
                    if to == at + 1:
                        lone = False
                    if b + w > best[to]:
                        best[to], back[to] = b + w, to - at
            if lone and b + unknown > best[at + 1]:
                best[at + 1], back[at + 1] = b + unknown, 1
        return best, back

    def prefix_hashes(self, signs: np.ndarray) -> np.ndarray:
        """Hashes of the first 0, 1, 2 ... signs of each row."""
        out = np.zeros((len(signs), signs.shape[1] + 1), np.uint64)
        for k in range(signs.shape[1]):
            x = (signs[:, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out[:, k + 1] = out[:, k] * _BASE + (x ^ x >> np.uint64(29))
        return out

    def solve(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words of one length, all at once: the search of `forward` with a column for each word."""
        n, most = len(words[0]), min(len(words[0]), self.longest)
        h = self.prefix_hashes(signs_of(words)).T.copy()
        pairs = [(at, to) for at in range(n) for to in range(at + 1, min(n, at + most) + 1)]
        own = np.concatenate([h[to] - h[at] * self.powers[to - at] for at, to in pairs])
        place = self.find(own)
        weight, piece = np.where(place < 0, NONE // 2, self.weights[place]), np.where(place < 0, np.int32(-1), self.ids_of[place])
        weight, piece = weight.reshape(len(pairs), -1), piece.reshape(len(pairs), -1)
        best, back = np.full((n + 1, len(words)), NONE // 2, np.int64), np.zeros((n + 1, len(words)), np.int64)
        best[0] = 0
        for k, (at, to) in enumerate(pairs):
            if to == at + 1:
                weight[k][piece[k] < 0] = self.unknown
            new = best[at] + weight[k]
            better = new > best[to]
            np.copyto(best[to], new, where=better)
            np.copyto(back[to], k, where=better)  # number of the pair
        begin, cols = np.array([at for at, _ in pairs]), np.arange(len(words))
        ids, end, used = np.full((len(words), n), -1, np.int32), np.full(len(words), n), np.zeros((len(words), n), bool)
        for k in range(n - 1, -1, -1):  # from the last piece on
            live = cols[end > 0]
            if not len(live):
                break
            pair = back[end[live], live]
            end[live] = begin[pair]
            ids[live, k], used[live, k] = piece[pair, live], True
        strange = (used & (ids < 0)).any(1)  # a sign that no piece has: by bytes
        flat, cut = ids[used].tobytes(), np.cumsum(np.r_[0, used.sum(1)]) * 4
        return {w: self.word(w) if odd else flat[a:b] for w, odd, a, b in zip(words, strange.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)}

    def learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, own in by_length.items():
            step = 1 << 19 if n > SHORT else max(1, (1 << 19) // (n * n))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                self.seen |= self.solve(part) if n <= SHORT else {w: self.word(w) for w in part}

    def word(self, word: str) -> bytes:
        _, back = self.forward(word, [0], len(word))
        return np.array(self.trace(word, back, len(word))[0], np.int32).tobytes()

    def trace(self, text: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids of the way that ends at a place, and the place where it came in."""
        parts = []
        while back[end]:
            parts.append(text[end - back[end] : end])
            end -= back[end]
        return [i for p in reversed(parts) for i in self.ids(p)], end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Words met before are looked up; of them a bounded number is kept."""
        split = [self.words.findall(self.escaped(t)) for t in texts]
        rows = [list(map(self.seen.get, words)) for words in split]
        new = {w for words, row in zip(split, rows, strict=True) if None in row for w, x in zip(words, row, strict=True) if x is None}
        if len(self.seen) + len(new) > self.cache:
            self.seen = {}
        self.learn(new)
        seen = self.seen
        full = ([seen[w] if x is None else x for w, x in zip(words, row, strict=True)] if None in row else row for words, row in zip(split, rows, strict=True))
        out = [np.frombuffer(b"".join(row), np.int32) for row in full]
        for w in new:
            if len(w) > SHORT:
                del seen[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.outputs.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def transfer(self, text: str, size: int) -> np.ndarray:
        """The chunk's matrix: from the first piece end at or after its begin to the first at or after `size`."""
        n = self.longest
        best = np.full((min(len(text), size) + n, n), NONE, np.int64)
        for a in range(min(n, len(text) + 1)):
            best[a, a] = 0
        out, reach, at = np.full((n, n), NONE, np.int64), 0, 0
        while at < size:
            if at >= n and reach <= at:
                # No piece stands across this place, so all ways lead through it: one search serves for all of them.
                rest, _ = self.forward(text[at:], [0], size - at)
                tail = np.array(rest[size - at : size - at + n], np.int64)
                out[:, : len(tail)] = best[at][:, None] + tail[None, :]
                break
            row = best[at]
            if row.max() > NONE // 2:
                for length, w in self.starting(text, at):
                    reach = max(reach, at + length)
                    np.maximum(best[at + length], row + w, out=best[at + length])
            at += 1
        else:
            tail = best[size : min(size + n, len(text) + 1)]
            out[:, : len(tail)] = tail.T
        out[out <= NONE // 2] = NONE
        return out

    def entries(self, text: str, size: int, enters: np.ndarray) -> np.ndarray:
        """For each way out of the chunk, where it came in; -1 if there is no such way."""
        best, back = self.forward(text, enters, size)
        out = np.full(self.longest, -1, np.int64)
        for b in range(min(self.longest, len(text) - size + 1)):
            end = size + b
            if best[end] > NONE // 2:
                while back[end]:
                    end -= back[end]
                out[b] = end
        return out


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    """One vocabulary for all tasks of a process."""
    return Vocabulary(model)


@lru_cache(maxsize=8)
def facts(model: str) -> tuple[int, int, int]:
    """(signs of the longest piece, least and greatest id of a byte, -1 without): all that the driver needs."""
    v = Vocabulary(model)
    return v.longest, min(v.of_byte.values(), default=-1), max(v.of_byte.values(), default=-1)


# ---------------------------------------------------------------- the scan


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices."""
    out = (a[:, :, None] + b[None]).max(1)
    out[out <= NONE // 2] = NONE
    return out


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """One map after the other; -1 is no way."""
    return np.where(first < 0, -1, then[np.maximum(first, 0)])


def scan(elements: DataFrame, shape: tuple[int, ...], start: np.ndarray, combine: Callable, act: Callable, block: int = BLOCK) -> DataFrame:
    """(text_key, k, state) for elements (text_key, k, m): what the elements before k make of `start`.

    Up to `block` neighbours are combined in one task; the blocks, if a text has several, are scanned alike; and each
    block is gone through from the state that reaches it. No group has more than `block` elements.
    """

    def arrays(group: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
        group = group.sort_values("k")
        return group, [np.frombuffer(m, np.int64).reshape(shape) for m in group["m"]]

    def up(group: pd.DataFrame) -> pd.DataFrame:
        group, ms = arrays(group)
        while len(ms) > 1:  # as a tree of neighbours
            ms = [combine(*ms[i : i + 2]) if i + 1 < len(ms) else ms[i] for i in range(0, len(ms), 2)]
        return pd.DataFrame({"text_key": group["text_key"][:1], "k": group["k"][:1] // block, "m": [ms[0].tobytes()]})

    def down(group: pd.DataFrame) -> pd.DataFrame:
        group, ms = arrays(group)
        state, out = np.frombuffer(group["state"].iloc[0], np.int64), []
        for m in ms:
            out.append(state.tobytes())
            state = act(state, m)
        return pd.DataFrame({"text_key": group["text_key"], "k": group["k"], "state": out})

    whole = F.floor(F.col("k") / block).alias("block")
    if elements.agg(F.max("k")).first()[0] < block:
        met = elements.withColumn("state", F.lit(start.tobytes()))
    else:
        ups = written(elements.groupBy("text_key", whole).applyInPandas(up, "text_key string, k long, m binary"), "blocks")
        over = scan(ups, shape, start, combine, act, block).withColumnRenamed("k", "block")
        met = elements.withColumn("block", F.floor(F.col("k") / block)).join(over, ["text_key", "block"]).drop("block")
    return met.groupBy("text_key", whole).applyInPandas(down, "text_key string, k long, state binary")


def _reach(state: np.ndarray, m: np.ndarray) -> np.ndarray:
    out = (state[:, None] + m).max(0)
    out[out <= NONE // 2] = NONE
    return out


def _giants(rows: DataFrame, model: str, chunk: int, block: int) -> DataFrame | None:
    """(doc_id, ids) of rows (doc_id, text) that are all longer than a chunk; None without such rows. What is gathered
    for one text is at last its ids; before, a matrix of a few kilobytes for each chunk, in groups of `block`."""
    longest, _, _ = facts(model)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text, key = (MARK + text).replace(" ", MARK), uuid.uuid4().hex
                starts = list(range(0, max(1, len(text) - chunk // 2), chunk))  # the last chunk has half a chunk at least
                ends = [*starts[1:], len(text)]
                for k, (a, e) in enumerate(zip(starts, ends, strict=True)):
                    row = [key, doc_id, k, len(starts) - 1 - k, text[a : e + longest - 1], e - a]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["text_key", "doc_id", "k", "after", "part", "size"])

    chunks = written(rows.mapInArrow(freeing(cut), "text_key string, doc_id long, k long, after long, part string, size long"), "chunks")
    if chunks.isEmpty():
        return None
    dealt = chunks.repartition("text_key", "k")

    def each(make: Callable, column: str, kind: str, inputs: list[str], place: str = "k") -> Callable[[DataFrame], DataFrame]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = vocabulary(model)
            for b in batches:
                got = [make(v, *x) for x in zip(*(b.column(i).to_pylist() for i in range(2, b.num_columns)), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.binary() if kind == "binary" else pa.list_(pa.int32()))], ["text_key", "k", column])

        return lambda df: df.select("text_key", F.col(place).alias("k"), *inputs).mapInArrow(freeing(run), f"text_key string, k long, {column} {kind}")

    matrices = written(each(lambda v, part, size: v.transfer(part, size).tobytes(), "m", "binary", ["part", "size"])(dealt), "matrices")
    begin = np.full(longest, NONE, np.int64)
    begin[0] = 0
    states = written(scan(matrices, (longest, longest), begin, product, _reach, block).withColumnRenamed("state", "enters"), "states")
    met = dealt.join(states, ["text_key", "k"])
    maps = written(each(lambda v, part, size, enters: v.entries(part, size, np.frombuffer(enters, np.int64)).tobytes(), "m", "binary", ["part", "size", "enters"], "after")(met), "maps")
    ways = scan(maps, (longest,), np.zeros(1, np.int64), composed, lambda leave, m: composed(leave, m), block)
    ways = written(ways.select("text_key", F.col("k").alias("after"), F.col("state").alias("leaves")), "ways")

    def traced(v: Vocabulary, part: str, size: int, enters: bytes, leaves: bytes) -> list[int]:
        _, back = v.forward(part, np.frombuffer(enters, np.int64), size)
        return v.trace(part, back, size + int(np.frombuffer(leaves, np.int64)[0]))[0]

    ids = each(traced, "ids", "array<int>", ["part", "size", "enters", "leaves"])(met.join(ways, ["text_key", "after"]))
    whole = ids.groupBy("text_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return chunks.where("k = 0").select("text_key", "doc_id").join(whole, "text_key").select("doc_id", "ids")


# ---------------------------------------------------------------- texts


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(np.concatenate(rows)))


def _plain(model: str, back: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ids of texts, and with `back` what they decode to, in one pass of one process."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = v.encode([t or "" for t in part.column(1).to_pylist()])
                cols = [part.column(0), _lists(ids)] + ([pa.array([v.decode(x) for x in ids], pa.string())] if back else [])
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "text"][: len(cols)])

    return run


def _split(docs: DataFrame, id_col: str, text_col: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    if chunk < 256:
        raise ValueError("a chunk must be longer than any piece")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    giant = F.coalesce(F.char_length("text"), F.lit(0)) > chunk
    rows = in_small_batches(rows)
    return rows.where(~giant), rows.where(giant)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids), one row per row of docs: the whole text's piece ids.

    Null and empty texts have no ids. A space is a word mark; a text begins with one. A text that holds the mark
    itself decodes to a space there. Repeated rows come out repeated; other columns are ignored; an empty table gives
    an empty result. Only texts of more than `chunk` signs are shuffled, by chunks.
    """
    small, giant = _split(docs, id_col, text_col, chunk)
    out, long = small.mapInArrow(freeing(_plain(model, False)), "doc_id long, ids array<int>"), _giants(giant, model, chunk, block)
    return out if long is None else out.unionByName(long)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, text): ids turned back into text. Null ids give an empty text; ids outside the vocabulary fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            flat, ends = b.column(1).values.to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [v.decode(flat[i:j]) for i, j in zip(ends[at : at + len(part)], ends[at + 1 : at + len(part) + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return in_small_batches(encoded.select("doc_id", "ids")).mapInArrow(freeing(run), "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids, text): decode(encode(docs)), with both in one pass for all but giant texts."""
    small, giant = _split(docs, id_col, text_col, chunk)
    out, long = small.mapInArrow(freeing(_plain(model, True)), "doc_id long, ids array<int>, text string"), _giants(giant, model, chunk, block)
    return out if long is None else out.unionByName(decode(long, model))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_hash, decoded_sha256) of each text encoded and decoded again.

    ids_hash is Spark's xxhash64 of the ids; decoded_sha256 equals the text's own sha256 where nothing was lost.
    """
    _, low, high = facts(model)
    got = round_trip(docs, id_col, text_col, model, chunk, block)
    in_bytes = F.size(F.filter("ids", lambda x: x.between(low, high))).cast("long")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), in_bytes.alias("n_byte_tokens"), F.xxhash64("ids").alias("ids_hash"), F.sha2("text", 256).alias("decoded_sha256"))
