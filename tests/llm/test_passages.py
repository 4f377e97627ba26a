"""The stage removes whole repeated passages of over 50 words, of any number of lines."""

import random

import corpus_pipeline
from tracewell.llm import linededup

SCHEMA = "doc_id long, text string, n_chars long"


def test_planted_passages(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for k in range(1, 7):
        for t in range(8):
            passage = [line(54 // k + 1) for _ in range(k)]
            for i in (100 * k + 2 * t, 100 * k + 2 * t + 1):
                own = [line(9) for _ in range(r.randint(1, 6))], [line(9) for _ in range(r.randint(0, 6))]
                rows.append((i, "\n".join(own[0] + passage + own[1]), None))
                want[i] = "\n".join(own[0] + (passage if i % 2 == 0 else []) + own[1])
    got = {x.doc_id: x for x in dict(corpus_pipeline.STAGES)["line_dedup"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert {i: x.text for i, x in got.items()} == want
    assert all(x.n_chars == len(x.text) for i, x in got.items() if i % 2)


def test_edges_of_passages(spark):
    long, short = "w " * 51, "a b c"
    rows = [(1, f"{long}\nx", 1), (1, f"{long}\nx", 1), (2, f"{long}\ny\n{long}", 1), (3, f"{short}\n{short}\nz", 1), (4, f"{short}\n{short}\nq", 1), (None, long, 1), (None, None, None), (5, "", 0), (6, long, 1)]
    got = sorted(((x.doc_id or 0, x.text) for x in linededup.drop_repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = [(0, long), (0, None), (1, "x"), (1, "x"), (2, "y"), (3, rows[3][1]), (4, rows[4][1]), (5, ""), (6, "")]
    assert got == sorted(want, key=str)
    assert linededup.drop_repeated_passages(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def brute(rows, least):
    """Lines that lie in a run of over `least` words which an earlier place has as a whole, by comparing all runs."""
    import xxhash

    signed = lambda t: (h := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (1 << 64 if h >> 63 else 0)
    docs = sorted({((0, 0) if i is None else (1, i), signed(t), t) for i, t in rows if t is not None})
    places = {}
    for i, v, t in docs:
        lines = t.split("\n")
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for x in lines[a : b + 1]) > least:
                    places.setdefault(tuple(lines[a : b + 1]), []).append((i, v, a, b, t))
    gone = {}
    for found in places.values():
        for i, v, a, b, t in sorted(found)[1:]:
            gone.setdefault((i, t), set()).update(range(a, b + 1))
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(((0, 0) if i is None else (1, i), t), set()))) for i, t in rows]


def test_passages_against_brute_force(spark):
    """Random texts of few lines, so that passages overlap, repeat inside one text, and are parts of each other."""
    for seed in range(6):
        r = random.Random(seed)
        pool = [" ".join(r.choice("abc") for _ in range(r.randint(0, 4))) for _ in range(7)] + ["one two three four five six seven"]
        passages = [[r.choice(pool) for _ in range(r.randint(2, 5))] for _ in range(4)]
        rows = []
        for i in range(14):
            lines = []
            for _ in range(r.randint(1, 4)):
                lines += r.choice(passages) if r.random() < 0.6 else [r.choice(pool) + f" x{r.randint(0, 3)}"]
            rows.append((r.choice([i, i, i, None, 3]), "\n".join(lines)))
        rows += [rows[0], (99, None), (98, "")]
        got = linededup.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), least=6).collect()
        key = lambda x: str(tuple(x))
        assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 6), key=key)


def test_lines_from_different_places_stay(spark):
    """A text whose parts stand in three others, each part of under 51 words, is no repeated passage."""
    r = random.Random(1)
    line = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c, d = (line(20) for _ in range(4))
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, f"{c}\n{d}"), (4, f"top\n{a}\n{b}\n{c}\n{d}\nend"), (5, f"x\n{a}\n{b}\n{c}\n{d}")]
    got = {x.doc_id: x.text for x in linededup.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {5: "x"}
