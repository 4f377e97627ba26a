"""Quality classifier: n-gram indicators scaled by Naive Bayes log-count ratios, then a linear hinge-loss model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import free, freeing, in_small_batches, word_blocks
from tracewell.scratch import written


@dataclass(frozen=True)
class Settings:
    """Parameters of the fit. At most `sample` labelled rows are learnt from: those smallest by a hash of doc_id,
    as far as their features take `sample_bytes`. One in `calibrate` of them fits only the map from margins to scores. Features are hashed to 2 ** bits."""

    sample: int = 20_000
    sample_bytes: int = 512 << 20
    bits: int = 20
    alpha: float = 1.0
    c: float = 1.0
    epochs: int = 20
    calibrate: int = 4
    fold: int = 5
    threshold: float = 0.3
    seed: int = 7


_PARTS = re.compile(rb"[A-Z]+|[a-z]+|[0-9]+|[\x80-\xff]+|(.)\1*|.", re.S)


def word_shape(word: bytes) -> bytes:
    """A word's form: runs of capitals, small letters and digits as A, a and 0; other signs stay, doubled if repeated."""
    out = b""
    for m in _PARTS.finditer(word[:64]):
        x = m[0]
        kind = b"A" if x[:1].isupper() else b"a" if x[:1].islower() or x[0] >= 0x80 else b"0" if x[:1].isdigit() else x[:2]
        if kind == b"A" and len(x) > 1:
            kind = b"AA"
        if not (kind == b"a" and out.endswith(b"a")):
            out += kind
    return out


class Coder(dict):
    """word -> crc32 of the lower-cased word and, above it, crc32 of its shape; forgets all beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        code = zlib.crc32(word.lower()) | (zlib.crc32(word_shape(word)) & 0x7FFFFFFF) << 32
        if len(word) < 64:
            self[word] = code
        return code


def _mixed(a: np.ndarray, salt: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: bytes, coder: Coder, bits: int) -> np.ndarray:
    """Ids of the n-grams of a whole text, each once: words, word pairs, and one to three word shapes, where a word equal to the one
    before it has a shape of its own."""
    found, last_words, last_shapes, last = [], np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
    for block in word_blocks(text):
        if not block:
            continue
        code = np.fromiter(map(coder.__getitem__, block), np.uint64, len(block))
        words, shapes = code & np.uint64(0xFFFFFFFF), code >> np.uint64(32)
        same = np.r_[block[0] == last, code[1:] == code[:-1]]
        shapes = np.where(same, np.uint64(1), shapes)
        last = block[-1]
        w, s = np.r_[last_words[-1:], words], np.r_[last_shapes[-2:], shapes]
        k = np.uint64(0x100000001B3)
        with np.errstate(over="ignore"):
            pair, two = w[:-1] * k ^ w[1:], s[:-1] * k ^ s[1:]
            three = two[:-1] * k ^ s[2:]
        found += [_mixed(words, 1, bits), _mixed(pair, 2, bits), _mixed(shapes, 3, bits), _mixed(two, 4, bits), _mixed(three, 5, bits)]
        found = [np.unique(np.concatenate(found))]
        last_words, last_shapes = w, s
    return found[0] if found else np.zeros(0, np.int64)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, bits: int, alpha: float) -> np.ndarray:
    """log of the ratio of each feature's smoothed share of class 1 to its share of class 0."""
    counts = np.full((2, 1 << bits), alpha)
    for r, v in zip(rows, y, strict=True):
        counts[v, r] += 1  # a row has each feature once
    share = np.log(counts / counts.sum(1, keepdims=True))
    return share[1] - share[0]


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, c: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM: one dual variable at a time, in a new random order each epoch.

    Row i has the features rows[i] with the values ratio[rows[i]], scaled to length one; they are not stored.
    """
    w, b, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    scale = np.array([1 / max(float(np.sqrt(ratio[r] @ ratio[r])), 1e-9) for r in rows])
    norm = np.array([float(ratio[r] @ ratio[r]) * k * k for r, k in zip(rows, scale, strict=True)]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            values = ratio[rows[i]] * scale[i]
            g = y[i] * (w[rows[i]] @ values + b) - 1
            new = min(max(dual[i] - g / norm[i], 0.0), c[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[rows[i]] += step * values
                b += step
                most = max(most, abs(new - dual[i]))
                dual[i] = new
        if most < 1e-3:
            break
    return w, b


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic map from margins to the chance of class 1, by Newton's method."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    x = np.stack([margins, np.ones(len(margins))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -35, 35)))
        grad = x.T @ (p - t)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int

    def margin(self, row: np.ndarray) -> float:
        if not len(row):
            return self.bias
        r = self.ratio[row]
        return float(r @ self.weight[row]) / max(float(np.sqrt(r @ r)), 1e-9) + self.bias

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(row) + self.shift, -35, 35))))


def fit(rows: list[np.ndarray], y: np.ndarray, s: Settings) -> Model:
    """y is 0 or 1. With one class only, or no rows, every text scores that class's smoothed share."""
    size = 1 << s.bits
    if len(set(y.tolist())) < 2:
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))), s.bits)
    aside = np.arange(len(rows)) % s.calibrate == 0
    if min((y[~aside] == k).sum() for k in (0, 1)) == 0 or min((y[aside] == k).sum() for k in (0, 1)) == 0:
        aside = np.zeros(len(rows), bool)
    learn = np.flatnonzero(~aside)
    own, v = [rows[i] for i in learn], y[learn]
    ratio = log_count_ratios(own, v, s.bits, s.alpha)
    share = v.mean()
    c = s.c * np.where(v == 1, 0.5 / share, 0.5 / (1 - share))
    w, b = dual_coordinate_descent(own, ratio, np.where(v == 1, 1.0, -1.0), c, s.epochs, s.seed)
    model = Model(ratio.astype(np.float32), w.astype(np.float32), float(b), 1.0, 0.0, s.bits)
    check = np.flatnonzero(aside) if aside.any() else learn
    slope, shift = _platt(np.array([model.margin(rows[i]) for i in check]), y[check])
    return Model(model.ratio, model.weight, model.bias, slope, shift, s.bits)


def held_out(doc_id, fold: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % fold == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings | None = None) -> Model:
    """The model learnt from a bounded sample of the labelled rows outside the held-out fold.

    Labels other than 0 and 1 and null ids are left out; of an id's several labels the smallest counts, of its several
    rows the one with the least features. The sample's ids, at most Settings.sample of them, are what is broadcast to
    find their texts; texts become feature ids in tasks. The driver holds the sample's features, a row for each id and
    Settings.sample_bytes at most (the first by hash of id), and the model, whose size is bounded.
    """
    s = settings or Settings()
    ids = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND _id IS NOT NULL").where(~held_out(F.col("_id"), s.fold))
    ids = ids.groupBy("_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(s.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for b in batches:
            found = [features(t or b"", coder, s.bits).astype(np.int32) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f.tobytes() for f in found], pa.binary())], ["id", "y", "f"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.encode(F.col(text_col), "UTF-8").alias("b")).join(F.broadcast(ids), "_id").select("_id", "y", "b")
    found = in_small_batches(texts).mapInArrow(freeing(run), "id long, y int, f binary").groupBy("id", "y").agg(F.min("f").alias("f"))
    found = written(found, "sample")
    place = F.xxhash64("id")
    sizes = found.select(place.alias("h"), F.octet_length("f").alias("n")).toArrow().sort_by("h")  # a number for each id of the sample
    fits = np.flatnonzero(np.cumsum(sizes.column("n").to_numpy()) <= s.sample_bytes)
    if len(fits) < sizes.num_rows:
        found = found.where(place <= (sizes.column("h")[int(fits[-1])].as_py() if len(fits) else -(1 << 63)))
    got = found.toArrow()
    order = pc.sort_indices(got.select(["id", "f"]), [("id", "ascending"), ("f", "ascending")]).to_numpy()
    order = order[np.random.default_rng(s.seed).permutation(len(order))]
    y = got.column("y").to_numpy()[order].astype(np.int64)
    rows = [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("f")]  # views of the one table
    model = fit([rows[i] for i in order], y, s)
    del rows, got
    free()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """docs' (doc_id, held_out, score, predicted), one row per row of docs; null and empty texts score the bias.

    Only the text is scored. Repeated rows come out repeated; other columns are ignored; a null doc_id is not held
    out; an empty table gives an empty result. The model has a bounded size and is broadcast.
    """
    s = settings or Settings()
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, m = Coder(), Model(**sent.value)
        for b in batches:
            found = [m.score(features(t or b"", coder, m.bits)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("b"))
    out = in_small_batches(rows).mapInArrow(freeing(run), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id"), s.fold), F.lit(False)).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """docs, all columns, without those whose text the classifier rejects. Scored in place, without a shuffle."""
    s = settings or Settings()
    sent = docs.sparkSession.sparkContext.broadcast(vars(train(docs, labels, text_col=text_col, settings=s)))
    at, names, schema = docs.columns.index(text_col), docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, m = Coder(), Model(**sent.value)
        for b in batches:
            texts = b.column(at).to_pylist()
            yield b.filter(pa.array([m.score(features((t or "").encode("utf-8", "replace"), coder, m.bits)) >= s.threshold for t in texts], pa.bool_()))

    return in_small_batches(docs).mapInArrow(freeing(run), schema).select(*names)
