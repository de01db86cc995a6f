"""Whitening against a dense eigendecomposition; the secular equation and rank-one updates by themselves."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollbook.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + 1_000_000) for i, v, _ in rows if v and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, total = len(fit), fit.sum(0)
    y = fit - total / n
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    return kept, n, total, e[::-1], q[:, ::-1]


def compare(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("n", "component", "__x", "__id", "whitened")})
    found = whitening.whiten(df).collect()
    kept, n, total, e, q = brute(rows)
    width = min(16, len(e))
    assert len(found) == width * len(kept)
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for i, x in kept:
        for c in range(1, width + 1):
            r = by[i, c][0]
            assert r["n"] == n and r["deviation"] == int(((n * x - total) ** 2).sum())
            assert abs(r["explained"] - e[c - 1] / e.sum()) <= 1e-10 * e[c - 1] / e.sum() + 1e-14
            assert r["identity_error"] < 1e-9
            want = (x - total / n) @ q[:, c - 1] / np.sqrt(e[c - 1])
            if abs(want) > 1e-6:
                signs.setdefault(c, np.sign(want) * np.sign(r["whitened"]))
            assert abs(r["whitened"] * signs.get(c, 1) - want) < 1e-6
    return found


def random_rows(seed, n, size):
    draw = np.random.default_rng(seed)
    return [(i, [float(x) for x in row], 0) for i, row in enumerate((draw.normal(size=(n, size)) * np.linspace(0.5, 4, size)).astype(np.float32))]


def test_random(spark):
    compare(spark, random_rows(1, 700, 24))


def test_few_dimensions_repeated_and_broken_rows(spark):
    rows = random_rows(2, 60, 3)
    rows += [rows[5]] * 300 + [(1000, rows[6][1], 0), (None, rows[7][1], 0)]
    broken = [(2000, None, 0), (2001, [], 0), (2002, [1.0, None, 2.0], 0), (2003, [float("nan"), 1.0, 1.0], 0), (2004, [float("inf"), 1.0, 1.0], 0), (2005, [1.0], 0)]
    df = spark.createDataFrame(rows + broken, SCHEMA)
    assert whitening.whiten(df).count() == 3 * len(rows)
    compare(spark, rows)


def test_equal_vectors_and_fewer_than_components(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)], SCHEMA)).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] is None and r["n"] == 1 and r["deviation"] == 0 and r["identity_error"] == 0 for r in one)
    rows = random_rows(3, 4, 8)
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["whitened"] is not None for r in found) == 4 * 3 and all(r["identity_error"] < 1e-9 for r in found)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0


def test_deviation_beyond_64_bits_is_an_error(spark):
    df = spark.createDataFrame([(i, [float(10**6 * i)], 0) for i in range(3000)], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(df).count()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.booleans(), st.booleans())
def test_rank_one_update(seed, size, ties, zeros):
    draw = np.random.default_rng(seed)
    values = np.sort(draw.integers(0, 3, size).astype(float) if ties else draw.random(size) * 10)
    vectors = np.linalg.qr(draw.normal(size=(size, size)))[0]
    v = draw.normal(size=size)
    if zeros:
        v = vectors[:, : max(1, size // 2)] @ draw.normal(size=max(1, size // 2))
    new, q = whitening.rank_one(values, vectors, v, 1e-14)
    want = vectors @ np.diag(values) @ vectors.T + np.outer(v, v)
    assert np.allclose(q @ np.diag(new) @ q.T, want, atol=1e-7)
    assert np.allclose(q.T @ q, np.eye(size), atol=1e-7)
    assert np.allclose(new, np.linalg.eigvalsh(want), atol=1e-7)


def test_secular_roots_lie_between_poles():
    poles, weights = np.array([0.0, 1.0, 1.5, 4.0]), np.array([0.5, 0.1, 1e-9, 2.0])
    near, step = whitening.secular_roots(poles, weights)
    roots = poles[near] + step
    assert all(roots[:-1] <= poles[1:]) and all(roots >= poles) and roots[-1] <= poles[-1] + weights.sum()
    assert np.allclose(roots, np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights))))


def test_merged_spectra_equal_one():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(90, 6)) * 3
    parts = [whitening.Spectrum.none(6, 1e-14) for _ in range(3)]
    for i, row in enumerate(x):
        parts[i % 3].add(row)
    parts[0].merge(parts[1])
    parts[0].merge(parts[2])
    y = x - x.mean(0)
    assert np.allclose(parts[0].values, np.linalg.eigvalsh(y.T @ y)) and np.allclose(parts[0].mean, x.mean(0))
