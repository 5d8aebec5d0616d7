"""Whitening against numpy's eigenvalues."""

import math

import numpy as np
import pytest

from trustlake.llm import whitening
from trustlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def matrices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 17, 40):
        a = rng.standard_normal((n, n))
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        thin = rng.standard_normal((n, max(1, n // 4)))
        yield a @ a.T
        yield 3.0 * np.eye(n)
        yield q @ np.diag(np.repeat([9.0, 9.0, 4.0, 1.0], (n + 3) // 4)[:n]) @ q.T
        yield 1e5 * thin @ thin.T
        yield np.diag(10.0 ** -np.arange(n))
        yield np.diag(1.0 + 1e-13 * np.arange(n))


@pytest.mark.parametrize("a", list(matrices()))
def test_leading(a):
    a = (a + a.T) / 2
    want = np.linalg.eigvalsh(a)[::-1]
    values, vectors = whitening.leading(a, 8)
    k = len(values)
    assert k == min(8, len(a)) or want[k] < 1e-10 * want[0]
    assert np.allclose(values, want[:k], rtol=1e-9, atol=1e-12 * want[0])
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-9
    assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-9 * max(1.0, want[0])


def test_inertia():
    rng = np.random.default_rng(1)
    for n in range(1, 12):
        a = rng.standard_normal((n, n))
        a += a.T
        values = np.linalg.eigvalsh(a)
        for shift in rng.uniform(-6, 6, 20):
            assert whitening.count_above(a, shift) == (values > shift).sum()
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.count_above(np.zeros((4, 4)), 0.0) == 0


def brute(vectors):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    z = (apart / n).astype(float)
    values, vectors = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(values)[::-1]
    return n, (apart**2).sum(axis=1), z, values[order], vectors[:, order]


def check(found, vectors):
    n, deviation, z, values, components = brute(list(vectors.values()))
    ids = {v: i for i, v in enumerate(vectors)}
    m = min(8, len(values))
    assert sorted((r.vec_id, r.component) for r in found) == sorted((v, c) for v in vectors for c in range(1, m + 1))
    for c in range(m):
        rows = [r for r in found if r.component == c + 1]
        ours = np.array([r.whitened for r in rows])
        at = [ids[r.vec_id] for r in rows]
        theirs = z[at] @ components[:, c] / np.sqrt(values[c])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-6
        assert all(r.n == n and r.deviation == deviation[i] for r, i in zip(rows, at, strict=True))
        assert all(r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9) for r in rows)


def test_query(spark, rows):
    found = QUERIES["op12_whiten"](spark, SF).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check(found, vectors)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    good = {i: np.float32(v).tolist() for i, v in enumerate(rng.standard_normal((30, 3)))}
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 0.0, 0.0]), (103, [0.0, inf, 0.0]), (104, []), (105, [1.0, 2.0])]
    data = [(i, v, 0) for i, v in [*good.items(), *bad]]
    table = spark.createDataFrame(data, SCHEMA).selectExpr("*", "'x' as n", "'x' as v", "'x' as component", "1 as d")
    fitted = whitening.fit(table)
    found = whitening.whiten(table, fitted).collect()
    check(found, good)
    assert whitening.identity_error(table, fitted) < 1e-9
    twice = spark.createDataFrame([(7, [1.0, 2.0], 0), (7, [1.0, 2.0], 0), (None, [5.0, 0.0], 0)], SCHEMA)
    rows = whitening.whiten(twice, whitening.fit(twice)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in rows) == [(0, 1, 3), (7, 1, 3), (7, 1, 3)]


def test_nothing_to_fit(spark):
    for data in ([], [(1, None, 0)], [(1, [2.0, 3.0], 0)] * 3):
        table = spark.createDataFrame(data, SCHEMA)
        fitted = whitening.fit(table)
        assert whitening.whiten(table, fitted).collect() == []
        assert fitted is None or whitening.identity_error(table, fitted) == 0.0


def test_large_numbers(spark):
    table = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [2e9, 5.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(table, whitening.fit(table)).collect()
    _, deviation, *_ = brute([[1e9, 0.0], [-1e9, 1.0], [2e9, 5.0]])
    want = {i + 1: d if d < 2**63 else None for i, d in enumerate(deviation)}
    assert {r.vec_id: r.deviation for r in rows} == want and None in want.values()
