"""Embedding whitening by spectrum slicing.

Components of the vectors become integers ``floor(256 * c)``. The fit list holds every distinct integer vector
once. Its sums and its covariance are Spark aggregates over blocks: a task centres its rows by the rounded mean before it
multiplies them, which keeps every product an integer, and the rest of the centring (below one half) is
settled exactly at the end, so neither the order of tasks nor a repeated task changes a digit. Only matrices of
dimension x dimension reach the driver.

The leading eigenvalues are found one by one. The number of positive pivots in an LDL' decomposition (symmetric
pivoting, blocks of one and two) of ``V - s I`` is the number of eigenvalues above ``s``; bisection on such counts isolates eigenvalue k in an
interval of its own, Rayleigh quotient iteration takes it from there and must stay inside, and two more counts just
below and just above the result certify that it is number k. Eigenvalues that are equal in double precision
share an interval; their vectors are kept orthogonal, any basis of their space is right.

Vectors that are null or empty, or hold null or non-finite components, take no part. Components beyond the range of
long / 256 saturate. Vectors of different length are whitened apart, each length with its own fit list (lengths are few). Repeated
rows stay rows, null ids stay null, other columns are not looked at. A component of no variance (constant or too
few vectors) has ``whitened`` null; ``explained`` is null where the whole variance is 0, ``identity_error`` where no component has any.
``deviation`` is null where the exact number does not fit into a long. Work on the driver is dimension^3 per count.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkloom.llm.common import cut

COMPONENTS = 4
BLOCK = 4_096
EXACT = 1 << 53
LONG = (1 << 63) - 1
EPS = np.finfo(float).eps


def finite(vector: Column) -> Column:
    """Neither null nor empty, every component there and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(256.0) * c.cast("double")))


# -- eigenvalues ---------------------------------------------------------------------------------------------


def count_above(m: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``m`` above ``shift``: positive pivots of LDL' with complete symmetric pivoting."""
    a = m - shift * np.eye(len(m))
    alpha, positive = (1 + 17 ** 0.5) / 8, 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        r = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0)
        p, q = divmod(int(off.argmax()), len(a))
        if max(diagonal[r], off[p, q]) == 0:
            break
        if diagonal[r] >= alpha * off[p, q]:
            at, positive = [r], positive + int(a[r, r] > 0)
            change = np.outer(a[:, r], a[:, r] / a[r, r])
        else:  # one pivot of each sign
            at, positive = [p, q], positive + 1
            change = a[:, at] @ np.linalg.solve(a[np.ix_(at, at)], a[at])
        a = np.delete(np.delete(a - change, at, 0), at, 1)
    return positive


def leading(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a covariance, falling, and their unit vectors in columns (largest entry positive)."""
    dim = len(v)
    k = min(k, dim)
    total = float(np.trace(v))
    if not total > 0:
        return np.zeros(k), np.eye(dim)[:, :k]
    m = (v + v.T) / (2 * total)
    counts = {-1.0: dim, 1.0 + dim * EPS * 8: 0}
    tight = 64 * dim * EPS

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = count_above(m, s)
        return counts[s]

    values, vectors = [], np.zeros((dim, 0))
    rng = np.random.default_rng(13)
    for number in range(1, k + 1):
        x = rng.normal(size=dim)
        for _ in range(400):
            low = max(s for s, c in counts.items() if c >= number)
            high = min(s for s, c in counts.items() if c < number and s > low)
            alone = counts[low] == number and counts[high] == number - 1
            if not alone and high - low > tight:
                above((low + high) / 2)
                continue
            x, value, residual = _quotient_iteration(m, x, (low + high) / 2, vectors, low, high)
            slack = tight + residual
            if residual <= tight and low - slack <= value <= high + slack and above(value + slack) < number <= above(value - slack):
                break
            if high - low > EPS * dim:
                above((low + high) / 2)
            else:
                x = rng.normal(size=dim)
        else:
            raise ArithmeticError(f"eigenvalue {number} could not be certified")
        values.append(max(value, 0.0))
        vectors = np.column_stack([vectors, x * (1 if x[np.abs(x).argmax()] > 0 else -1)])
    return np.array(values) * total, vectors


def _quotient_iteration(m, x, shift, found, low, high):
    """Two steps of inverse iteration at ``shift``, then Rayleigh quotients while they stay in the interval."""
    best = (x, shift, np.inf)
    for step in range(40):
        try:
            y = np.linalg.solve(m - shift * np.eye(len(m)), x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last digit
            y = np.linalg.solve(m - (shift + EPS) * np.eye(len(m)), x)
        for _ in range(2):
            y = y - found @ (found.T @ y)
            norm = np.linalg.norm(y)
            if not np.isfinite(norm) or norm == 0:
                return best
            y = y / norm
        x = y
        value = float(x @ m @ x)
        residual = float(np.linalg.norm(m @ x - value * x))
        if residual < best[2]:
            best = (x, value, residual)
        elif step > 4:
            break
        if step >= 1 and low <= value <= high:
            shift = value
        elif step > 4:
            break
    return best


# -- aggregates over blocks -----------------------------------------------------------------------------------


def _blocks(batches, name: str, dim: int):
    for batch in batches:
        x = batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        for start in range(0, len(x), BLOCK):
            yield x[start:start + BLOCK]


def _halved(x: np.ndarray, fits):
    """Parts of a block that fulfil ``fits``, single rows whatever they are."""
    if len(x) <= 1 or fits(x):
        yield x
    else:
        yield from _halved(x[:len(x) // 2], fits)
        yield from _halved(x[len(x) // 2:], fits)


def _reach(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _column_sums(fit: DataFrame, dim: int) -> list[int]:
    def run(batches):
        held, room = np.zeros(dim, np.int64), LONG
        for block in _blocks(batches, "x", dim):
            for part in _halved(block, lambda p: _reach(p) * len(p) <= LONG):
                most = _reach(part) * len(part)
                if most > room:
                    yield _long_rows(i=np.arange(dim), s=held)
                    held, room = np.zeros(dim, np.int64), LONG
                held = held + part.sum(axis=0)
                room -= most
        yield _long_rows(i=np.arange(dim), s=held)

    rows = (fit.select("x").mapInArrow(run, "i long, s long").groupBy("i")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    out = [0] * dim
    for r in rows:
        out[r["i"]] = int(r["s"])
    return out


def _long_rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def centred(x: np.ndarray, pivot: list[int]) -> np.ndarray:
    """x - pivot, as integers where they stay small, else in double precision."""
    if _reach(x) < 1 << 61 and max(map(abs, pivot), default=0) < 1 << 61:
        return x - np.array(pivot, np.int64)
    return x.astype(float) - np.array(pivot, float)


def _products(fit: DataFrame, dim: int, pivot: list[int]) -> tuple[dict, dict]:
    """Sums of products of the centred columns i <= j: exact integers, and those of rows too large for that."""
    i, j = np.triu_indices(dim)

    def run(batches):
        held, room, rough = np.zeros((dim, dim), np.int64), LONG, np.zeros((dim, dim))
        for block in _blocks(batches, "x", dim):
            y = centred(block, pivot)
            for part in _halved(y, lambda p: float(np.abs(p).max())**2 * len(p) < EXACT):
                most = float(np.abs(part).max())**2 * len(part)
                real = part.astype(float)
                if most >= EXACT:
                    rough += real.T @ real
                    continue
                if most > room:
                    yield _long_rows(i=i, j=j, s=held[i, j], r=np.zeros(len(i)))
                    held, room = np.zeros((dim, dim), np.int64), LONG
                held += (real.T @ real).astype(np.int64)
                room -= int(most)
        yield _long_rows(i=i, j=j, s=held[i, j], r=rough[i, j])

    rows = (fit.select("x").mapInArrow(run, "i long, j long, s long, r double").groupBy("i", "j")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("r").alias("r")).toArrow())
    at = list(zip(rows["i"].to_pylist(), rows["j"].to_pylist()))
    return dict(zip(at, map(int, rows["s"].to_pylist()))), dict(zip(at, rows["r"].to_pylist()))


@dataclass
class Whitening:
    """The whitening of vectors of one length."""

    dim: int
    n: int
    sums: list[int]
    pivot: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None = None

    @property
    def live(self) -> int:
        """Leading components with variance."""
        return int((self.values > 64 * self.dim * EPS * self.trace).sum()) if self.trace > 0 else 0

    def project(self, x: np.ndarray) -> np.ndarray:
        rest = np.array([(s - self.n * p) / self.n for s, p in zip(self.sums, self.pivot)])
        return (centred(x, self.pivot) - rest) @ (self.vectors[:, :self.live] / np.sqrt(self.values[:self.live]))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n x - S)^2."""
        most = self.n * _reach(x) + max(map(abs, self.sums), default=0)
        if most * most * self.dim <= LONG:
            return ((self.n * x - np.array(self.sums, np.int64))**2).sum(axis=1).tolist()
        exact = [sum((self.n * c - s)**2 for c, s in zip(row, self.sums)) for row in x.tolist()]
        return [e if e <= LONG else None for e in exact]


def fit(distinct: DataFrame, dim: int, n: int, components: int = COMPONENTS) -> Whitening:
    """``distinct`` holds the ``n`` vectors ``x`` of length ``dim`` once each."""
    sums = _column_sums(distinct, dim)
    pivot = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * p for s, p in zip(sums, pivot)]
    exact, rough = _products(distinct, dim, pivot)
    v = np.zeros((dim, dim))
    for (i, j), s in exact.items():
        v[i, j] = v[j, i] = (n * s - rest[i] * rest[j]) / (n * n) + rough[i, j] / n
    values, vectors = leading(v, components)
    model = Whitening(dim, n, sums, pivot, float(np.trace(v)), values, vectors)
    model.identity_error = _identity_error(distinct, model)
    return model


def _identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of covariance minus identity of the whitened fit list: first its mean, then products
    of what is left."""
    live = model.live
    if not live:
        return None
    i, j = np.triu_indices(live)

    def sums(batches):
        for block in _blocks(batches, "x", model.dim):
            yield _long_rows(i=np.arange(live), s=model.project(block).sum(axis=0))

    mean = np.zeros(live)
    for r in distinct.select("x").mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        mean[r["i"]] = r["s"] / model.n

    def products(batches):
        for block in _blocks(batches, "x", model.dim):
            w = model.project(block) - mean
            yield _long_rows(i=i, j=j, s=(w.T @ w)[i, j])

    rows = distinct.select("x").mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max(abs(r["s"] / model.n - (r["i"] == r["j"])) for r in rows)


def transform(rows: DataFrame, model: Whitening, id_col: str) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of rows (id, x) of the model's length."""
    k, live = len(model.values), model.live
    explained = [float(e / model.trace) if model.trace > 0 else None for e in model.values]
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, start = batch.column(id_col), 0
            for x in _blocks([batch], "x", model.dim):
                n = len(x)
                w = np.full((n, k), np.nan)
                w[:, :live] = model.project(x)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(start, n).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model.n, np.int64)), pa.array([e for e in model.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(w.ravel(), pa.float64(), from_pandas=True), pa.array(explained * n, pa.float64()),
                    pa.array([model.identity_error] * (n * k), pa.float64())],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])
                start += n

    return rows.select(id_col, "x").mapInArrow(
        run, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Fit and transform: a row per vector that takes part and leading component."""
    rows = vectors.select(F.col(f"`{id_col}`"), F.col(f"`{column}`").alias("v")).where(finite(F.col("v"))).select(
        id_col, integers(F.col("v")).alias("x"))
    distinct = cut(rows.select("x").distinct(), "whitening-fit")
    lengths = distinct.groupBy(F.size("x").alias("dim")).count().orderBy("dim").collect()
    found = [transform(rows.where(F.size("x") == r["dim"]),
                       fit(distinct.where(F.size("x") == r["dim"]), r["dim"], r["count"], components), id_col) for r in lengths]
    if not found:
        return transform(rows.limit(0), Whitening(1, 1, [0], [0], 0.0, np.zeros(1), np.eye(1)), id_col)
    return functools.reduce(DataFrame.unionByName, found)
