"""Near-duplicate vectors against brute force, and the recall of the search."""

import numpy as np
import pytest

from sievework.llm.embedding_dedup import filters_of, near_vectors

NONE = float("nan")


@pytest.mark.parametrize("side", [2048, 6])
def test_near_vectors(spark, side):
    r = np.random.default_rng(1)
    rows = []
    for _ in range(12):
        base = r.normal(size=16)
        rows += [(len(rows) + k, (base + r.normal(0, 0.08, 16)).tolist()) for k in range(r.integers(1, 9))]
    rows += [(len(rows) + k, rows[0][1]) for k in range(20)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [NONE] * 16), (1003, [None] * 16), (1004, []), (1005, [1e-310, 0.0]), (1006, [1.0, 0.0]), (None, rows[0][1])]
    kinds = "vec_id long, embedding array<double>, label int, rep string, vector string"
    df = spark.createDataFrame([(i, v, None, "r", "v") for i, v in rows + odd], kinds).repartition(4)
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    up = list(range(len(rows)))
    for _ in up:
        up = [min(up[j] for j in np.flatnonzero(near[i])) for i in range(len(up))]
    want = {i: (int(near[i].sum()) - 1, up[i], up[i] == i) for i in range(len(rows))}
    want |= {1005: (1, 1005, True), 1006: (1, 1005, False)}
    want |= {i: (0, i, True) for i in range(1000, 1005)} | {None: (0, None, False)}
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near_vectors(df, side=side).collect()}
    assert got == want


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize(("code", "least"), [(16, 0.99), (64, 0.985), (100, 0.98), (178, 0.97)])
def test_recall_at_the_threshold(code, least):
    """Pairs at exactly the least cosine, the hardest ones, with as many codewords as 60 thousand to a
    thousand million vectors have."""
    r = np.random.default_rng(0)
    a = r.normal(size=(3000 if code < 100 else 1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    both = np.sort(np.hstack([filters_of(a, code), filters_of(0.95 * a + np.sqrt(1 - 0.95**2) * b, code)]), 1)
    assert (both[:, 1:] == both[:, :-1]).any(1).mean() > least
