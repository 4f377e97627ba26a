"""Near-duplicate links that a bucket must not lose."""

import numpy as np

from tracewell.llm import near


def flipped(fp, bits):
    out = fp.copy()
    for b in bits:
        out[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return out


def test_links_of_those_that_follow_another():
    """y lies beside x, z within reach of y alone: a large bucket links z all the same."""
    fps = np.random.default_rng(3).integers(0, 1 << 63, (4200, 2), dtype=np.uint64)
    fps[100] = flipped(fps[7], range(8))
    fps[4000] = flipped(fps[100], range(40, 76))
    links = {frozenset(e) for e in near.bucket_links(fps)}
    assert {frozenset((7, 100)), frozenset((100, 4000))} <= links


def test_all_pairs_of_different_groups(spark):
    """After a refused link every pair of the bucket is asked for that no group holds yet, and no other."""
    base = np.random.default_rng(4).integers(0, 1 << 63, 2, dtype=np.uint64)
    fps = np.array([flipped(base, range(i * 4, i * 4 + 4)) for i in range(12)])
    rows = [(int(a), int(b), i % 3) for i, (a, b) in enumerate(fps.view(np.int64))]
    got = {(r.src, r.dst) for r in near.candidates(spark.createDataFrame(rows, "a long, b long, c long")).collect()}
    n = near.nodes_of(fps)
    assert got == {tuple(sorted((int(n[i]), int(n[j])))) for i in range(12) for j in range(i) if i % 3 != j % 3}
