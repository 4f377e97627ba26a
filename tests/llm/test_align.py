"""Alignment of two tokenizers: against a brute-force version over a table, blocks of every size, edge cases."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tracewell.llm import align
from tracewell.llm.queries import op13_align
from tracewell.llm.vocab import BYTE_BPE, PIECE_BPE, byte_level, pieces


def brute(rows):
    """The rows of the contract, by the libraries and a walk over single tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    a_lib.encode_special_tokens = True
    of_a, of_b = byte_level().token_bytes, pieces().token_bytes
    found = []
    for doc_id, text in rows:
        a, b, groups, links = [], [], [], []
        if text:
            a, b = a_lib.encode(f" {text}", add_special_tokens=False).ids, b_lib.encode(text)
            if not b"".join(of_a[i] for i in a) == b"".join(of_b[i] for i in b) == f" {text}".encode():
                a, b = [], []
        i = j = x = y = begin_a = begin_b = 0
        while i < len(a) or j < len(b):
            if x <= y:
                x, i = x + len(of_a[a[i]]), i + 1
            else:
                y, j = y + len(of_b[b[j]]), j + 1
            if x == y:
                groups.append(",".join(map(str, a[begin_a:i])) + "|" + ",".join(map(str, b[begin_b:j])))
                links.append((a[i - 1], b[j - 1]))
                begin_a, begin_b = i, j
        found.append((doc_id, len(a), len(b), groups, links))
    count, best = Counter(p for r in found for p in r[4]), defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(d, n_a, n_b, len(g), len(p), sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "") for d, n_a, n_b, g, p in found]


def same(got, rows):
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(rows), key=key)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    same(op13_align(spark, "/root/testdata/sf0.001"), rows)


EDGE = [(1, "one two three, four"), (1, "one two three, four"), (None, "one two"), (None, "one two"), (None, None), (2, ""), (3, None), (4, "a▁b"), (5, "<|endoftext|> <s> </s> <0x41>"), (6, "日本語 \U0001f600 é\x00\x01 \n\n\t  x"), (7, " leading"), (8, "word 日 and more, " * 4000), (9, "zq" * 3000), (10, " ")]


def test_edges(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "ids", "side", "first", "pair", "count", "times", "best")})
    same(align.align(docs), EDGE)
    empty = align.align(docs.where("false"))
    assert empty.count() == 0
    assert empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_small_blocks_and_rare_pairs(spark):
    """Groups that reach over many blocks, and counts that come from the join rather than the broadcast."""
    docs = spark.createDataFrame(EDGE, "doc_id long, text string")
    same(align.align(docs, block=3), EDGE)
    same(align.align(docs, block=1, frequent=5), EDGE)
    same(align.align(docs.repartition(5), frequent=1), EDGE)


def test_events_of_two_tables(spark):
    """The sweep takes events from anywhere: the sides of one table apart, in any order, united again."""
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").coalesce(1)
    events = align.end_events(docs, block=5)
    apart = events.where("side = 1").orderBy(F.desc("first")).unionByName(events.where("side = 0").repartition(3))
    digest = lambda e: sorted(str(tuple(r)) for r in align.swept(e).where("groups_sha256 IS NOT NULL").drop("pairs", "times").collect())
    assert digest(apart) == digest(events)
