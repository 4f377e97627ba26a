"""Segmentation against an independent search, the library's own, and round trips."""

import random
import struct

import numpy as np
import pytest

from tracewell.llm import unigram


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.Vocabulary(unigram.MODEL)


def plain_best(v, text):
    """Whole-text segmentation in one piece of code that knows no chunks, words or caches."""
    s = v.escaped(text)
    best, back = [0] + [None] * len(s), [0] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for n in range(min(v.longest, end), 0, -1):
            w = v.pieces.get(s[end - n : end], (0, v.unknown if n == 1 else None))[1]
            if w is not None and best[end - n] is not None and (best[end] is None or best[end - n] + w > best[end]):
                best[end], back[end] = best[end - n] + w, n
    parts, end = [], len(s)
    while end:
        parts.append(s[end - back[end] : end])
        end -= back[end]
    return [i for p in reversed(parts) for i in v.ids(p)]


def texts(seed):
    r = random.Random(seed)
    alphabet = ["a", "aa", "the", " ", "  ", "\n", "é", "你", "▁", "in", "=", "====", "ing", "#", "\U0001f600"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 2000))) for _ in range(12)] + ["", " ", "a" * 3000, "=" * 2500, " " * 1500]


def test_words_give_the_best_whole(vocabulary):
    for t in texts(1):
        assert vocabulary.encode([t])[0].tolist() == plain_best(vocabulary, t)


def test_round_trip(vocabulary):
    for t in texts(2):
        assert vocabulary.decode(vocabulary.encode([t])[0]) == t.replace("▁", " ")


def test_transfer_matrices_multiply(vocabulary):
    """Two chunks' product is the matrix of both together."""
    v, r = vocabulary, random.Random(3)
    text = v.escaped("".join(r.choice(["aa", "a", "the", " ", "==", "="]) for _ in range(300)))
    a, b = 120, 90
    more = v.longest - 1
    one, two = v.transfer(text[: a + more], a), v.transfer(text[a : a + b + more], b)
    both = v.transfer(text[: a + b + more], a + b)
    product = (one[:, :, None] + two[None]).max(1)
    ok = both > unigram.NONE
    assert (product[ok] == both[ok]).all()


def test_chunks_agree_with_the_whole(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate(texts(4))] + [(None, "the end"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = unigram.encode(docs, chunk=256, block=3).collect()  # several levels of blocks
    want = sorted((str(i), vocabulary.encode([t or ""])[0].tolist()) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want


def as_unigram(path, score):
    """The shipped pieces as a unigram model file; score(i) is that of piece i."""
    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    base = sentencepiece.SentencePieceProcessor(model_file=unigram.MODEL)
    model = b""
    for i in range(base.GetPieceSize()):
        name = base.IdToPiece(i).encode()
        kind = 2 if base.IsUnknown(i) else 3 if base.IsControl(i) else 6 if base.IsByte(i) else 1
        body = b"\x0a" + varint(len(name)) + name + b"\x15" + struct.pack("<f", score(i) if kind == 1 else 0.0) + b"\x18" + varint(kind)
        model += b"\x0a" + varint(len(body)) + body
    trainer = b"\x18\x01" + b"\x98\x02\x01"  # unigram, byte fallback
    normal = b"\x0a\x08identity\x12\x00\x18\x01\x20\x00\x28\x01"
    model += b"\x12" + varint(len(trainer)) + trainer + b"\x1a" + varint(len(normal)) + normal
    path.write_bytes(model)
    return sentencepiece.SentencePieceProcessor(model_file=str(path)), unigram.Vocabulary(str(path))


def test_same_as_the_library_in_unigram_mode(tmp_path):
    """The library, told that the same pieces with small scores are a unigram model, segments alike."""
    sp, v = as_unigram(tmp_path / "unigram.model", lambda i: -1 - (i % 1024) / 1024)
    r = random.Random(5)
    for _ in range(200):
        t = " ".join("".join(r.choice(["the", "in", "er", "st", "a", "o", "é", "="]) for _ in range(r.randint(1, 4))) for _ in range(6))
        a, b = sp.encode(t), v.encode([t])[0].tolist()
        assert abs(sum(map(sp.GetScore, a)) - sum(map(sp.GetScore, b))) < 1e-3
        assert sp.decode(b) == t == v.decode(np.array(a))


def test_no_path_of_the_library_is_better(spark, vocabulary, tmp_path):
    """The library's unigram decoder, given the operator's weights as scores, adds them up in single precision and
    breaks ties otherwise. Each text of the table has ids of at least the exact weight of its path, nearly all words
    the same ids."""
    v = vocabulary
    sp, _ = as_unigram(tmp_path / "weights.model", lambda i: v.pieces[sp_piece(i)][1] / 65536)
    exact = lambda ids: sum(v.unknown if sp.IsByte(i) else v.pieces[sp.IdToPiece(i)][1] for i in ids)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = unigram.encode(docs).join(docs, "doc_id").collect()
    assert len(rows) == 200
    for r in rows:
        lib = sp.encode(r.text or "")
        assert exact(r.ids) >= exact(lib) and sp.decode(list(r.ids)) == (r.text or "")
    words = sorted({w for r in rows for w in (r.text or "").split()})
    same = sum(sp.encode(w) == x.tolist() for w, x in zip(words, v.encode(words), strict=True))
    assert same >= 0.99 * len(words)


def sp_piece(i):
    import sentencepiece

    global _base
    if "_base" not in globals():
        _base = sentencepiece.SentencePieceProcessor(model_file=unigram.MODEL)
    return _base.IdToPiece(i)


def test_hot_signs(vocabulary):
    assert vocabulary.encode(["\x00"])[0].tolist() == [vocabulary.pieces["▁"][0], vocabulary.of_byte[0]]
    assert np.all(vocabulary.encode(["x" * 5000])[0] >= 0)
