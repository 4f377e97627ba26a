"""Quality rules: plain counts over words and lines, and the fertility of public tokenizers.

Whole texts are encoded with three public vocabularies. For each, characters per token and the evenness of its tokens
(their entropy over the greatest that so many tokens can have) are measured, and the byte-fallback share of the one
that has such tokens. What is usual is taken from the documents themselves: for each language, and each script for
texts whose language is unknown or rare, the median and the quartiles of each measure over all texts that pass the base
rule. A text is rejected that lies too many deviations from the median in any of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import in_small_batches, word_blocks
from tracewell.llm.vocab import NONE, MergedPieces
from tracewell.scratch import written

#: SentencePiece model with byte fallback, and two byte-level vocabularies as ranks.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern by which these vocabularies split texts.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What bands are drawn for; of the byte share only an upper bound.
MEASURES = ["chars_per_token", "evenness", "byte_share", "chars_per_token_2", "evenness_2", "chars_per_token_3", "evenness_3"]


@dataclass(frozen=True)
class Rules:
    """Parameters. A text of under min_tokens tokens is too short for its shares to mean much and is held against no
    band. A band reaches `deviations` robust standard deviations (quartile range / 1.349, `least` at least) to both
    sides of the median, and for short texts further: by the root of 1 + short / tokens. Groups of under min_rows rows
    have no band of their own: a language's texts then fall under their script's, a script's under that of all."""

    min_words: int = 50
    most_repeated: int = 50  # words in repeated windows, in hundredths
    min_tokens: int = 50
    deviations: float = 8.0
    least: float = 0.003
    short: float = 300.0
    min_rows: int = 100


# First and last code points of the scripts' main blocks.
SCRIPTS = {"latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)], "greek": [(0x370, 0x3FF)], "cyrillic": [(0x400, 0x52F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF)], "devanagari": [(0x900, 0x97F)], "thai": [(0xE00, 0xE7F)], "kana": [(0x3040, 0x30FF)], "cjk": [(0x4E00, 0x9FFF)], "hangul": [(0xAC00, 0xD7AF)]}
_NAMES = [*SCRIPTS, "other"]
_STARTS = np.array(sorted(a for r in SCRIPTS.values() for a, _ in r))
_ENDS, _OF = zip(*((b, _NAMES.index(s)) for s, r in sorted(((s, x) for s, rs in SCRIPTS.items() for x in rs), key=lambda x: x[1]) for a, b in [r]), strict=True)
_ENDS, _OF = np.array(_ENDS), np.array(_OF)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_BLANKS = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)


def script_of(text: str) -> str:
    """The script of most letters; other if there are none."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    at = np.searchsorted(_STARTS, points, "right") - 1
    inside = (at >= 0) & (points <= _ENDS[at])
    counts = np.bincount(_OF[at[inside]], minlength=len(_NAMES))
    return _NAMES[int(counts.argmax())] if counts.any() else "other"


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words inside windows of `width` words that are found twice or more."""
    if len(ids) <= width:
        return 0
    key = ids.astype(np.int64)[: len(ids) - width + 1]
    size = int(ids.max()) + 1
    for i in range(1, width):
        nxt = ids[i : len(ids) - width + 1 + i]
        if size ** (i + 1) >= 1 << 62:  # else the windows so far are numbers of their own
            _, key = np.unique(key, return_inverse=True)
        key = key * size + nxt
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    again = np.isin(key, twice) if len(twice) else np.zeros(len(key), bool)
    hit = np.zeros(len(ids), bool)
    for i in range(width):
        hit[i : i + len(again)] |= again
    return int(hit.sum())


class Tokens:
    """Ids of whole texts under the three vocabularies."""

    def __init__(self, model: str = MODEL, ranks: tuple[str, ...] = RANKS) -> None:
        import sentencepiece
        import tiktoken

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.is_byte = np.array([self.sp.IsByte(i) for i in range(self.sp.GetPieceSize())])
        self.others = []
        for path in ranks:
            with open(path, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.others.append(tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=table, special_tokens={NONE: max(table.values()) + 1}))
        self.merged = MergedPieces(self.sp)

    def encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        """For each text its ids under each vocabulary."""
        return [[self.merged.encode(t), *(e.encode_to_numpy(t, disallowed_special=()) for e in self.others)] for t in texts]


def _evenness(ids: np.ndarray) -> tuple[float, float]:
    """(entropy in bits, its share of what so many tokens can have)."""
    if len(ids) < 2:
        return 0.0, 0.0
    n = np.unique(ids, return_counts=True)[1]
    entropy = float(np.log2(len(ids)) - (n * np.log2(n)).sum() / len(ids))
    return entropy, entropy / float(np.log2(len(ids)))


def measure(text: str, ids: list[np.ndarray], is_byte: np.ndarray) -> dict:
    """The counts and measures of one text."""
    data = text.encode("utf-8", "replace")
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    of: dict[bytes, int] = {}
    parts = [np.fromiter((of.setdefault(w, len(of)) for w in words), np.int64, len(words)) for words in word_blocks(data)]
    words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    lines, seen = 0, set()
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            lines += line in seen
            seen.add(line)
    n = len(ids[0])
    chars = int(len(data) - by_byte[0x80:0xC0].sum() - by_byte[_BLANKS].sum())
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": int(by_byte[_SYMBOLS].sum()), "n_dup_lines": lines, "n_repeat_words": repeated_words(words), "n_tokens": n, "script": script_of(text), "byte_share": float(is_byte[ids[0]].mean()) if n else 0.0}
    for k, x in enumerate(ids):
        end = f"_{k + 1}" if k else ""
        entropy, out[f"evenness{end}"] = _evenness(x)
        out[f"chars_per_token{end}"] = len(text) / len(x) if len(x) else 0.0
        if not k:
            out["entropy"] = entropy
    return out


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, script string, entropy double, " + ", ".join(f"{m} double" for m in MEASURES)


@lru_cache(maxsize=2)
def _tokens(model: str, ranks: tuple[str, ...]) -> Tokens:
    return Tokens(model, ranks)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", model: str = MODEL, ranks: tuple[str, ...] = RANKS) -> DataFrame:
    """(doc_id, lang, the counts and measures), one row per row of docs; every text is measured whole, by itself."""
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    names, kinds = zip(*(c.split() for c in COLUMNS.split(", ")), strict=True)
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(model, ranks)
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            found = [measure(t, tokens.encode([t])[0], tokens.is_byte) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([m[c] for m in found], types[k]) for c, k in zip(names, kinds, strict=True))], ["doc_id", "lang", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(run, f"doc_id long, lang string, {COLUMNS}")


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))


def bands(rows: DataFrame, rules: Rules) -> DataFrame:
    """(group, band): for each language, script and for all texts that pass the base rule, the median and deviation of
    each measure, where there are rows enough. One row per group; quantiles are put together from partial sketches."""
    own = rows.where(~base_failed(rules) & (F.col("n_tokens") >= rules.min_tokens))
    groups = F.explode(F.array(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("script "), "script"), F.lit("all")))
    q = [F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(m) for m in MEASURES]
    got = own.select(groups.alias("group"), *MEASURES).where("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("n"), *q).where(F.col("n") >= rules.min_rows)
    one = lambda m: F.struct(F.get(m, 1).alias("median"), F.greatest((F.get(m, 2) - F.get(m, 0)) / 1.349, F.lit(rules.least)).alias("deviation")).alias(m)
    return got.select("group", F.struct(*(one(m) for m in MEASURES)).alias("band"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", model: str = MODEL, ranks: tuple[str, ...] = RANKS, rules: Rules | None = None) -> DataFrame:
    """(doc_id, the counts and measures, base_failed, kept), one row per row of docs.

    A null or empty text has no words, tokens or symbols, zero in every count, and fails the base rule. A null,
    unknown or rare language falls back to the band of the text's script, then to that of all texts, and without rows
    enough for that to none. Repeated rows come out repeated; other columns are ignored; an empty table gives an empty
    result. Texts are not shuffled; their measures are written once and read for the bands and for the verdicts.
    """
    rules = rules or Rules()
    rows = written(measured(docs, id_col, text_col, lang_col, model, ranks), "measured")
    found = written(bands(rows, rules), "bands")
    of = lambda c, kind, out: rows_of(kind, out).withColumnRenamed("name", c)

    def rows_of(kind: str, out: str) -> DataFrame:
        return found.where(F.startswith("group", F.lit(f"{kind} "))).select(F.expr(f"substring(group, {len(kind) + 2})").alias("name"), F.col("band").alias(out))

    met = rows.join(of("lang", "lang", "by_lang"), "lang", "left").join(of("script", "script", "by_script"), "script", "left")
    met = met.join(F.broadcast(found.where("group = 'all'").select(F.col("band").alias("by_all"))), F.lit(True), "left")  # one row at most
    band = F.coalesce("by_lang", "by_script", "by_all")
    wide = rules.deviations * F.sqrt(1 + rules.short / F.greatest("n_tokens", F.lit(1)))
    off = lambda m: (F.col(m) - band[m]["median"]) / band[m]["deviation"]
    out_of = F.lit(False)
    for m in MEASURES:
        out_of = out_of | ((off(m) if m == "byte_share" else F.abs(off(m))) > wide)
    fits = (F.col("n_tokens") < rules.min_tokens) | band.isNull() | ~out_of
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return met.select("doc_id", *names, base_failed(rules).alias("base_failed"), (~base_failed(rules) & fits).alias("kept"))
