"""Whitening against exact integers and numpy's covariance."""

from __future__ import annotations

import math

import numpy as np
import pytest

from solfa.llm import whitening

_rng = np.random.default_rng(5)
MIX = _rng.normal(size=(6, 6))


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if c is None else float(c) for c in v], "x", None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string, n string")


def expected(vectors):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    covariance = centred.T @ centred / n
    values, directions = np.linalg.eigh(covariance)
    return deviation, centred, values[::-1], directions[:, ::-1], np.trace(covariance)


def compare(spark, vectors, **more):
    rows = {r["id"]: r for r in whitening.whiten(frame(spark, vectors).repartition(3), **more).collect()}
    deviation, centred, values, directions, trace = expected(vectors)
    k = min(whitening.COMPONENTS, len(values))
    for i in range(len(vectors)):
        r = rows[i]
        assert r["n"] == len(vectors) and r["deviation"] == deviation[i]
        white = centred[i] @ directions[:, :k] / np.sqrt(values[:k])
        assert np.allclose(np.abs(r["whitened"]), np.abs(white), atol=1e-6)
        assert np.allclose(r["explained"], values[:k] / trace, rtol=1e-4)
        assert r["identity_error"] <= 1e-4
    white = np.array([rows[i]["whitened"] for i in range(len(vectors))])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(k)).max() < 1e-9


def test_whitened_vectors(spark):
    compare(spark, _rng.normal(size=(300, 6)) @ MIX)


def test_far_components_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 7)
    compare(spark, _rng.normal(size=(100, 6)) @ MIX * 1e9 + 1e10)


def test_exact_where_longs_overflow(spark):
    vectors = _rng.normal(size=(40, 3)) * 1e15
    rows = {r["id"]: r["deviation"] for r in whitening.whiten(frame(spark, vectors)).collect()}
    for i, d in enumerate(expected(vectors)[0]):
        assert (None if rows[i] is None else int(rows[i])) == (d if d < 10**38 else None)


def test_odd_rows_take_no_part(spark, tmp_path):
    good = (_rng.normal(size=(40, 6)) @ MIX).tolist()
    odd = [None, [], [None] * 6, [float("nan")] * 6, [1.0] * 5 + [float("inf")]]
    repeated = good + [good[0]] + odd
    frame(spark, repeated, [*range(40), None, *range(50, 55)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = whitening.op13_whitening(spark, str(tmp_path)).collect()
    assert len(rows) == 41 * 6 and {r["n"] for r in rows} == {41}
    assert sorted(r["component"] for r in rows if r["vec_id"] is None) == list(range(1, 7))
    assert {r["vec_id"] for r in rows} == {None, *range(40)}
    assert len({r["identity_error"] for r in rows}) == 1


@pytest.mark.parametrize("vectors, blank", [([[1.0, 2.0]], 2), ([[1.0, 2.0]] * 5, 2), ([[1.0, 0.0], [2.0, 0.0], [4.0, 0.0]], 1)])
def test_directions_without_variance_are_null(spark, vectors, blank):
    rows = whitening.whiten(frame(spark, vectors)).collect()
    assert len(rows) == len(vectors)
    assert {sum(w is None for w in r["whitened"]) for r in rows} == {blank}


def test_lengths_are_fitted_apart_and_nothing(spark):
    a, b = _rng.normal(size=(30, 2)).tolist(), _rng.normal(size=(20, 3)).tolist()
    rows = whitening.whiten(frame(spark, a + b)).collect()
    assert sorted({(r["dims"], r["n"]) for r in rows}) == [(2, 30), (3, 20)]
    assert whitening.whiten(frame(spark, [])).count() == 0


def test_primes_and_signed_entries(spark):
    assert whitening.primes(1) == [1048573]
    product = 1
    for p in whitening.primes(10**40):
        product *= p
        assert p < 1 << 20 and all(p % i for i in range(2, 1100) if i < p)
    assert product > 10**40
