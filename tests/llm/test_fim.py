"""Fill-in-middle: against a brute-force version, checkpoints at every distance, exact return, edge cases."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.llm import fim
from tracewell.llm.queries import op12_fim


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ROWS = [(1, "one two three"), (1, "one two three"), (None, "one two"), (None, None), (2, ""), (3, None), (4, "<P> here"), (5, "<S"), (6, "a<M>"), (7, "é日本 <S <P a\n\x00b" * 50), (8, "word 日 " * 70000), (9, "x" * 300000), (10, "\n"), *((100 + i, "<P <S> M>"[: i % 9] + "aé 1" * (i % 7)) for i in range(200))]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("b", "n", "form", "output")})
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored()).collect()
    key = lambda r: str(tuple(r))
    assert sorted(((r.doc_id, *r[1:6]) for r in got), key=key) == sorted(((i, *brute(i, t)) for i, t in ROWS), key=key)
    texts = {(i, brute(i, t)[4]): t or "" for i, t in ROWS}
    assert all(texts[r.doc_id, r.output] == r.back for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.where("false")).count() == 0


def test_query_over_its_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((r.doc_id, *(x := brute(r.doc_id, r.text))[:2], x[2] if x[2] is not None else -1, x[3] if x[3] is not None else -1, sha(x[4]), sha(r.text or "")) for r in docs)
    got = op12_fim(spark, "/root/testdata/sf0.001").fillna(-1).collect()
    assert sorted(tuple(r) for r in got) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abZ é日\n<>PSM1\U0001f600", max_size=200), st.integers(1, 9), st.integers(1, 40))
def test_places_from_checkpoints(text, every, block):
    """Every unit is found, whatever the distance of checkpoints and wherever blocks of bytes end."""
    data, units = text.encode(), re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    index = fim.checkpoints(data, every, block)
    assert index.n_units == len(units) and index.n_chars == len(text) and len(index.units) == -(-len(units) // every)
    for u in range(len(units) + 1):
        before = "".join(units[:u])
        assert fim.place(data, index, u) == (len(before.encode()), len(before))


def test_epochs_and_shares():
    r = random.Random(0)
    forms = [fim.transform(b"some words to be cut", f"1:{r.random()}")[1] for _ in range(4000)]
    assert 0.08 < forms.count("plain") / 4000 < 0.12 and 0.15 < forms.count("spm") / 4000 < 0.21
    assert fim.transform(b"some words to be cut", "1:7") != fim.transform(b"some words to be cut", "2:7")
