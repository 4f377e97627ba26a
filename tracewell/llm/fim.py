"""Fill-in-middle transformation: a text is cut at two places between units and its middle moved to the end.

A unit is a run of ASCII letters or any other code point. While a text's units are counted, every `every`-th unit's
place is recorded, in bytes and in code points. A cut is found by bisection in these checkpoints and a scan of less than
`every` units from there: no list of units is held, however long the text is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import in_small_batches

#: Units between checkpoints, bytes counted at a time.
EVERY, BLOCK = 64, 1 << 20
_UNIT = re.compile(rb"[A-Za-z]+|[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*")
_MARKS = (b"<P>", b"<S>", b"<M>")


@dataclass
class Checkpoints:
    """units, bytes and chars of every checkpoint, and of the text's end."""

    units: np.ndarray
    bytes_: np.ndarray
    chars: np.ndarray
    n_units: int
    n_chars: int


def checkpoints(data: bytes, every: int = EVERY, block: int = BLOCK) -> Checkpoints:
    """Counts the units of UTF-8 data and records where each `every`-th begins."""
    places, chars, n, c, letter_before = [], [], 0, 0, False
    for at in range(0, len(data), block):
        x = np.frombuffer(data, np.uint8, min(block, len(data) - at), at)
        letter = ((x | 0x20) - np.uint8(97)) < 26
        sign = (x & 0xC0) != 0x80
        starts = sign.copy()
        starts[1:] &= ~(letter[1:] & letter[:-1])
        starts[0] &= not (letter_before and letter[0])
        begin = np.flatnonzero(starts)
        own = begin[(-n) % every :: every]
        before = np.cumsum(sign) - sign
        places.append(own + at)
        chars.append(before[own] + c)
        n, c, letter_before = n + len(begin), c + int(sign.sum()), bool(letter[-1])
    places = np.concatenate(places) if places else np.zeros(0, np.int64)
    chars = np.concatenate(chars) if chars else np.zeros(0, np.int64)
    return Checkpoints(np.arange(len(places)) * every, places, chars, n, c)


def place(data: bytes, index: Checkpoints, unit: int) -> tuple[int, int]:
    """(byte offset, code points before) of the beginning of a unit; the number of units stands for the text's end."""
    if unit >= index.n_units:
        return len(data), index.n_chars
    k = int(np.searchsorted(index.units, unit, "right")) - 1
    begin = end = int(index.bytes_[k])
    for m in islice(_UNIT.finditer(data, begin), unit - int(index.units[k])):
        end = m.end()
    return end, int(index.chars[k]) + len(data[begin:end].decode("utf-8", "replace"))


def transform(data: bytes, key: str, plain_from: int = 90, spm_below: int = 20, every: int = EVERY) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text; key decides the cuts and the form."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    index = checkpoints(data, every)
    n = index.n_units
    if not data or any(m in data for m in _MARKS) or h3 % 100 >= plain_from:
        return n, "plain", None, None, data
    (a, a_chars), (b, b_chars) = (place(data, index, u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = _MARKS
    if h4 % 100 < spm_below:
        return n, "spm", a_chars, b_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a_chars, b_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epoch: int = 1, plain_from: int = 90, spm_below: int = 20, every: int = EVERY) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of docs.

    form is plain (output is the text), psm or spm. epoch and doc_id alone decide cuts and form, so another epoch cuts
    the same texts elsewhere. Null texts count as empty ones, which stay plain, as do texts that hold a mark. A null
    doc_id is written as nothing. Repeated rows come out repeated and alike; other columns are ignored; an empty table
    gives an empty result. Each text is read whole, by itself, without a shuffle.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            got = [transform(t or b"", f"{epoch}:{'' if i is None else i}", plain_from, spm_below, every) for i, t in zip(ids, b.column(1).to_pylist(), strict=True)]
            n, form, prefix, middle, out = zip(*got, strict=True) if got else ([],) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("b"))
    return in_small_batches(rows).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column | str = "form", output: Column | str = "output") -> Column:
    """The text, rebuilt from output and form alone. No mark stands in a text that was cut, nor can one arise where
    parts meet: a mark's first sign is found nowhere else in it."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    after = lambda mark: F.substring_index(output, mark, -1)
    upto = F.substring_index
    psm = F.concat(upto(after("<P>"), "<S>", 1), after("<M>"), upto(after("<S>"), "<M>", 1))
    spm = F.concat(upto(after("<P>"), "<M>", 1), after("<M>"), upto(after("<S>"), "<P>", 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
