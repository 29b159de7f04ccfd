"""Whitening against dense linear algebra, and its eigenvalues against known spectra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from walkloom.llm import queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int"
RNG = np.random.default_rng(5)


def dense(rows, k=4):
    """{(row number, component): (n, deviation, whitened, explained)}, the sign left open."""
    x = np.floor(256 * np.array([v for _, v in rows], float)).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    w = (x - s / n) @ vectors[:, :k] / np.sqrt(values[:k])
    return n, ((n * x - s)**2).sum(axis=1), w, values[:k] / values.sum()


def compare(got, rows, k=4):
    n, deviation, w, explained = dense(rows, k)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(by) == k * len(rows)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert [by[i, 1].deviation for i, _ in rows] == deviation.tolist()
    for c in range(k):
        mine = np.array([by[i, c + 1].whitened for i, _ in rows])
        assert np.abs(mine * np.sign(mine @ w[:, c]) - w[:, c]).max() < 1e-8
        assert abs(by[rows[0][0], c + 1].explained - explained[c]) < 1e-12


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(queries.QUERIES["op13_embedding_whitening"](spark, SF).collect(), rows)


def test_copies_count_once(spark):
    base = RNG.normal(size=(300, 8)).astype(np.float32) * np.arange(1, 9, dtype=np.float32)
    rows = [(i, base[i % 300 if i < 300 else 0].tolist()) for i in range(700)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(5).withColumn("component", F.lit("mine"))
    compare(whitening.whiten(df).collect(), rows)


def spectra():
    a = RNG.normal(size=(40, 40))
    q = np.linalg.qr(a)[0]
    low = RNG.normal(size=(40, 2))
    yield a @ a.T
    yield q @ np.diag([5, 5, 5, 4] + [1] * 36) @ q.T
    yield q @ np.diag([5, 5 - 1e-9, 5 - 2e-9, 4] + [1] * 36) @ q.T
    yield low @ low.T
    yield np.eye(40)
    yield np.diag([0.0, 4, 1, 4])
    yield np.array([[0.0, 1], [1, 0]]) + 2 * np.eye(2)
    yield a @ a.T * 1e60
    yield np.array([[3.0]])


@pytest.mark.parametrize("v", list(spectra()))
def test_leading_eigenvalues(v):
    values, vectors = whitening.leading(v)
    want = np.sort(np.linalg.eigvalsh(v))[::-1][:4]
    assert np.abs(values - want).max() <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-13
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-13 * want[0]
    for s in (0.3, 1.7, 4.5):
        shift = s * want[0] / 5
        assert whitening.count_above(v, shift) == (np.linalg.eigvalsh(v) > shift).sum()


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.5]
    rows = [(0, v), (0, v), (1, [0.0, 0.0, 0.0]), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]),
            (6, [float("inf"), 1.0, 1.0]), (7, [5.0, 5.0]), (None, [4.0, 1.0, -2.0]), (8, [-0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, x, None) for i, x in rows], VECTORS)
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted(
        [(False, i, c) for i in (0, 0, 1, 8) for c in (1, 2, 3)] + [(True, 0, c) for c in (1, 2, 3)] + [(False, 7, 1), (False, 7, 2)])
    three = [r for r in got if r.vec_id != 7]
    assert {r.n for r in three} == {3} and all((r.whitened is None) == (r.component == 3) for r in three)  # three points lie in a plane
    alone = [r for r in got if r.vec_id == 7]
    assert all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in alone)
    assert whitening.whiten(df.limit(0)).collect() == []


def test_very_large_components(spark):
    big = [1e30, -1e30, 3e38, 1e17, 2e17, 3e17, 1.0, 2.0]
    rows = [(i, [b, float(i)]) for i, b in enumerate(big)]
    got = whitening.whiten(spark.createDataFrame([(i, x, 0) for i, x in rows], VECTORS)).collect()
    assert len(got) == 16 and all(r.deviation is None for r in got) and got[0].identity_error < 1e-4


def test_sums_are_exact_whatever_the_blocks(spark, monkeypatch):
    x = [[int(a), int(b)] for a, b in RNG.integers(-2**40, 2**40, size=(200, 2))] + [[2**62, -2**62], [2**63 - 1, 5], [2**63 - 1, 6]]
    df = spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(3)
    want = [sum(v[0] for v in x), sum(v[1] for v in x)]
    assert whitening._column_sums(df, 2) == want
    small = spark.createDataFrame([(v,) for v in x[:200]], "x array<long>")
    pivot = [0, 0]
    exact, rough = whitening._products(small, 2, pivot)
    assert abs(rough[0, 1] + exact[0, 1] - sum(a * b for a, b in x[:200])) <= 1e-12 * sum(abs(a * b) for a, b in x[:200])
    less = [[a >> 25, b >> 25] for a, b in x[:200]]
    exact, rough = whitening._products(spark.createDataFrame([(v,) for v in less], "x array<long>"), 2, pivot)
    assert exact[0, 1] == sum(a * b for a, b in less) and not any(rough.values())
