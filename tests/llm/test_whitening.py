"""Whitening against a plain eigendecomposition."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadlens.llm import queries as Q
from leadlens.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, label int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)


def check(df, vectors, components):
    """vectors: those that stay, by id."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in vectors.items()}
    n, d = len(x), len(next(iter(x.values())))
    sums = [sum(v[k] for v in x.values()) for k in range(d)]
    y = np.array([[(n * v[k] - sums[k]) / n for k in range(d)] for v in x.values()])
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    rows = df.collect()
    assert sorted(r.vec_id for r in rows) == sorted(x)
    white = np.array([r.whitened for r in sorted(rows, key=lambda r: list(x).index(r.vec_id))])
    k = white.shape[1]
    assert k == min(components, int((values > values[0] * 1e-12).sum()))
    assert np.allclose(white.T @ white / n, np.eye(k), atol=1e-9)
    for c in range(k):
        alone = all(abs(values[c] - values[o]) > 1e-6 * values[0] for o in range(d) if o != c)
        if alone:
            want = y @ axes[:, c] / math.sqrt(values[c])
            assert np.allclose(white[:, c], want, atol=1e-7) or np.allclose(white[:, c], -want, atol=1e-7)
    for r in rows:
        assert r.n == n
        assert r.deviation == sum((n * v - s) ** 2 for v, s in zip(x[r.vec_id], sums, strict=True))
        assert r.explained == pytest.approx((values[:k] / values.sum()).tolist(), rel=1e-9)
        assert 0 <= r.identity_error < 1e-9


@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_factor_and_rotations(seed, d, rank):
    draw = np.random.default_rng(seed)
    half = draw.normal(size=(d, min(d, rank))) * 10.0 ** draw.integers(-3, 4, size=min(d, rank))
    a = half @ half.T
    factor = W.pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a, atol=1e-9 * np.abs(a).max())
    values, axes = W.principal(a)
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-6 if rank < d else 1e-9)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:len(values)], atol=1e-9 * np.abs(a).max())
    assert (np.diff(values) <= 0).all()


def test_matches_eigenvectors(spark):
    draw = np.random.default_rng(3)
    vectors = (draw.normal(size=(300, 6)) * [5, 3, 2, 1, 0.5, 0.25] + 7).tolist()
    check(W.whiten(frame(spark, vectors).repartition(7), 4), dict(enumerate(vectors)), 4)


def test_broken_vectors_go_and_rank_limits_components(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0, 3.0], [2.0, 4.0, 5.0], [0.5, 1.0, 9.0], None, [nan, 1.0, 2.0], [1.0, None, 2.0], [1.0, inf, 2.0],
               [], [1.0, 2.0], [1e300, 0.0, 0.0], [1.0, 2.0, 3.0]]
    check(W.whiten(frame(spark, vectors)), {i: vectors[i] for i in (0, 1, 2, 10)}, 32)


def test_nothing_to_scale(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [[1.0, 2.0]] * 3)).count() == 0
    assert W.whiten(frame(spark, [[1.0, 2.0]])).count() == 0


def test_large_entries_are_exact(spark):
    vectors = [[2.0 ** 40, 1.0], [-(2.0 ** 40), 2.0], [3.0, 2.0 ** 39]]
    out = {r.vec_id: r.deviation for r in W.whiten(frame(spark, vectors)).collect()}
    assert out == {0: None, 1: None, 2: None}  # beyond a long
    check(W.whiten(frame(spark, [[2.0 ** 20, 1.0], [-(2.0 ** 20), 2.0], [3.0, 2.0 ** 19]])),
          {0: [2.0 ** 20, 1.0], 1: [-(2.0 ** 20), 2.0], 2: [3.0, 2.0 ** 19]}, 32)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = Q.QUERIES["op11_whitening"](spark, sf).collect()
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert len(rows) == 32 * n
    assert {r.component for r in rows} == set(range(1, 33))
    assert max(r.identity_error for r in rows) < 1e-4
