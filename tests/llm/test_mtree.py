"""Exact search by inner product against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkloom.llm import mtree

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k=5):
    fine = []
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            fine.append((i, tuple(min(max(int(np.floor(256 * float(np.float32(c)))), mtree.LOW), mtree.HIGH) for c in v)))
    fine = sorted(set(fine))
    out = []
    for q in fine:
        if q[0] % every == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(q[1], c[1])), mtree.LOW), mtree.HIGH), c[0])
                            for c in fine if c != q and len(c[1]) == len(q[1]))[:k]
            out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def found(df, **sizes):
    return sorted(tuple(r) for r in mtree.search(df, **sizes).collect())


def clustered(n, dim=12, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    rows = [(i, (centres[i % 9] * (1 + i % 3) + rng.normal(0, 0.2, dim)).astype(np.float32).tolist()) for i in range(n)]
    common = rows[50][1]
    return rows + [(n + i, common) for i in range(n // 3)]  # a third of all rows are one vector, queries among them


@pytest.mark.parametrize("sizes", [{}, {"region": 100, "block": 60, "page": 8, "chunk": 3}])
def test_matches_brute_force(spark, sizes):
    rows = clustered(900)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(5)
    assert found(df, **sizes) == brute(rows, 50)


def test_odd_tables(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (0, v), (0, [2.0, 0.0, 0.0]), (1, v), (2, [0.0, 0.0, 0.0]), (3, None), (4, []), (50, []), (100, []), (5, [1.0, None, 2.0]),
            (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, [5.0, 5.0]), (150, [1.0]), (None, v), (200, [-1.0, 0.5, 0.0]),
            (250, [3e38, 3e38, 1.0]), (251, [3e38, -3e38, 1.0]), (252, [1e17, 1e17, 1.0])]
    df = spark.createDataFrame([(i, x, None) for i, x in rows], VECTORS).withColumn("score", F.lit("mine"))
    assert found(df) == brute(rows, 50)
    assert found(df.limit(0)) == [] and found(df.where("vec_id = 1")) == [] and found(df.where("vec_id = 150")) == []


def test_stored_bounds_save_distances():
    """Well separated clusters: most pages are never opened, and no answer is lost."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, size=(40, 6))
    x = np.concatenate([c + rng.integers(-30, 30, size=(100, 6)) for c in centres])
    ids = rng.permutation(len(x))
    most = float((x**2).sum(axis=1).max()) * (1 + 1e-12)
    pages = mtree.bulk_load(ids, x, most, page=32)
    assert sorted(np.concatenate([p["ids"] for p in pages if p["leaf"]])) == list(range(len(x)))
    pages = [mtree.opened(**p) for p in pages]
    work = []
    for q in x[::200]:
        s, i, _, n = mtree.best_first(pages, q, most, 6)
        order = np.lexsort((ids, -(x @ q)))[:6]
        assert i.tolist() == ids[order].tolist() and s.tolist() == (x @ q)[order].tolist()
        again = mtree.best_first(pages, q, most, 6, int(s[-1]))
        assert again[1].tolist() == i.tolist() and again[3] <= n
        work.append(n)
    assert np.mean(work) < 0.5 * len(x)


def test_equal_vectors_fill_pages():
    x = np.tile(np.array([[3, 4]]), (500, 1))
    pages = mtree.bulk_load(np.arange(500), x, 25.0, page=8)
    assert sum(len(p["ids"]) for p in pages if p["leaf"]) == 500
