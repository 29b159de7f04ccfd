"""Exact top-k search by inner product over an M-tree.

Components become integers ``floor(256 * c)``. A vector x is lifted to ``(x, sqrt(M - |x|^2))``, M being the largest square norm,
a query q to ``(q, 0)``; then ``d(q, x)^2 = |q|^2 + M - 2 q.x``, so the largest inner products are the nearest points
of a metric space, where the triangle inequality holds.

The tree is a table of pages. Pivots drawn from a bounded sample divide all vectors into regions (the top level, whose pivots and
covering radii are few and travel with the tasks); a region is cut into blocks of bounded size, and a task
bulk-loads the pages of a block: an entry of an inner page is a routing vector with its covering radius, its distance to the routing vector
of the page, and the page below; an entry of a leaf is a vector with its distance. A query first searches its
most promising region, then, with the score it must reach, those regions whose bound allows it.
Within a block the page with the smallest bound comes first, the search ends when that bound is too far, and entries
are skipped by ``|d(q, page) - d(entry, page)| - radius`` from stored distances alone. Bounds have slack for rounding; scores are exact
integers, so the result is exact.

Hot regions are split by hash and hot query sets by number. Of equal vectors only the k + 1 with the smallest ids can be
among anybody's k best; the others are left out first. Equal queries are searched once. Comparing n / 50 queries with n vectors
grows with n^2 where the data let no bound exclude anything (evenly spread directions in many dimensions).

Rows with a null id, or a vector that is null or holds null or non-finite components, take no part. Vectors are compared with those of their own
length (lengths are few; empty vectors are all equal). Rows are compared, not ids: exact repeats count once, a row that repeats an id with other
integers is a row of its own. Integers and scores beyond the range of long saturate. Ties go to the smaller id.
Other columns are not looked at.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkloom.llm.common import cut, sample_ids, skew_join
from walkloom.llm.whitening import integers

FIT_ROWS = 20_000
REGION = 8_192
MAX_REGIONS = 512
BLOCK = 16_384
PAGE = 256
CHUNK = 512
SLACK = 1e-6
LOW, HIGH = -(1 << 63), (1 << 63) - 1

PAGES = ("region int, block int, page int, leaf boolean, entries int, route binary, vectors binary, ids binary, radius binary, "
         "apart binary, below binary")
FOUND = "key binary, vec_id long, score long, same boolean"


def usable(vector):
    """Not null, no component null or not finite; may be empty or zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def products(x: np.ndarray, q: np.ndarray, real: np.ndarray | None = None, peak: float | None = None) -> np.ndarray:
    """Inner products of integer rows with an integer vector, exact; beyond the range of long they saturate.
    ``real`` are the rows in double precision, ``peak`` bounds their components."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    real = x.astype(float) if real is None else real
    peak = float(np.abs(real).max()) if peak is None else peak
    most = peak * max(abs(int(q.max())), abs(int(q.min()))) * x.shape[1]
    if most < 2.0**53:
        return (real @ q.astype(float)).astype(np.int64)
    if most < 2.0**62:
        return x @ q
    exact = x.astype(object) @ q.astype(object)
    return np.array([min(max(s, LOW), HIGH) for s in exact], np.int64)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(most - (x**2).sum(axis=1), 0))])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b)**2).sum(axis=1))


# -- the tree of a block ---------------------------------------------------------------------------------------


def bulk_load(ids: np.ndarray, x: np.ndarray, most: float, page: int = PAGE, seed: int = 3) -> list[dict]:
    """Pages of an M-tree over the rows; page 0 is the root."""
    points, rng = lifted(x, most), np.random.default_rng(seed)
    middle = int(apart(points, points.mean(axis=0)).argmin())
    pages, todo = [None], [(0, np.arange(len(x)), middle)]
    while todo:
        number, rows, route = todo.pop()
        if len(rows) <= page:
            pages[number] = {"leaf": True, "route": x[route], "x": x[rows], "ids": ids[rows], "radius": np.zeros(len(rows)),
                             "apart": apart(points[rows], points[route]), "below": np.zeros(len(rows), np.int32)}
            continue
        seeds = rng.choice(rows, min(page, -(-2 * len(rows) // page)), replace=False)
        nearest = np.stack([apart(points[rows], points[s]) for s in seeds]).argmin(axis=0)
        groups = [rows[nearest == g] for g in range(len(seeds))]
        if max(map(len, groups)) == len(rows):  # seeds do not tell these rows apart
            groups = [rows[start:start + page] for start in range(0, len(rows), page)][:page]
            groups[-1] = rows[(len(groups) - 1) * page:]
            seeds = np.array([g[0] for g in groups])
        seeds, groups = zip(*[(s, g) for s, g in zip(seeds, groups) if len(g)])
        first = len(pages)
        pages += [None] * len(groups)
        pages[number] = {"leaf": False, "route": x[route], "x": x[list(seeds)], "ids": np.zeros(len(groups), np.int64),
                         "radius": np.array([apart(points[g], points[s]).max() for s, g in zip(seeds, groups)]),
                         "apart": apart(points[list(seeds)], points[route]), "below": np.arange(first, first + len(groups), dtype=np.int32)}
        todo += [(first + i, g, s) for i, (s, g) in enumerate(zip(seeds, groups))]
    return pages


def best_first(pages: list[dict], q: np.ndarray, most: float, k: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(scores, ids, equal to q) of the ``k`` best entries that score ``limit`` at least, and the number of distances computed."""
    real = q.astype(float)
    square = float(real @ real)
    base = square + most
    slack = SLACK * base**0.5

    def reach(score) -> float:
        return max(base - 2 * float(score), 0.0)**0.5 + slack

    far = np.inf if limit is None else reach(limit)
    scores, ids, same = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    heap, computed = [(0.0, 0, max(base - 2 * float(pages[0]["route"].astype(float) @ real), 0.0)**0.5)], 1
    while heap:
        bound, number, distance = heapq.heappop(heap)
        if bound > far:
            break
        page = pages[number]
        alive = np.flatnonzero(np.abs(distance - page["apart"]) - page["radius"] <= far)
        if not len(alive):
            continue
        if 2 * len(alive) >= len(page["x"]):  # picking them out would cost more than the few others
            alive = slice(None)
        x, near = page["x"][alive], page["real"][alive]
        computed += len(x)
        if page["leaf"]:
            s = products(x, q, near, page["peak"])
            least = scores[-1] if len(scores) == k else limit
            if least is not None:
                fine = np.flatnonzero(s >= least)
                if not len(fine):
                    continue
                s, x = s[fine], x[fine]
                new = page["ids"][alive][fine]
            else:
                new = page["ids"][alive]
            scores, ids, same = np.concatenate([scores, s]), np.concatenate([ids, new]), np.concatenate([same, (x == q).all(axis=1)])
            order = np.lexsort((ids, ~scores))[:k]
            scores, ids, same = scores[order], ids[order], same[order]
            if len(scores) == k:
                far = min(far, reach(scores[-1]))
        else:
            d = np.sqrt(np.maximum(base - 2 * (near @ real), 0))
            for lower, below, at in zip((d - page["radius"][alive]).tolist(), page["below"][alive].tolist(), d.tolist()):
                if lower <= far:
                    heapq.heappush(heap, (lower, below, at))
    return scores, ids, same, computed


# -- the tree of a table ---------------------------------------------------------------------------------------


@dataclass
class Regions:
    """The top level of the tree; it travels with the tasks."""

    most: float
    pivots: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Smallest distance that a vector of each region can have from each query."""
        real = q.astype(float)
        base = (real**2).sum(axis=1)[:, None] + self.most
        d = np.sqrt(np.maximum(base - 2 * real @ self.pivots[:, :-1].T, 0))
        return np.where(self.sizes > 0, np.maximum(d - self.radius - SLACK * np.sqrt(base), 0), np.inf)


@dataclass
class Tree:
    """The regions, and the pages of all blocks."""

    dim: int
    regions: Regions
    pages: DataFrame
    block: int


def _stacked(series, dim: int) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.int64) if len(series) and dim else np.zeros((len(series), dim), np.int64)


def _pivots(sample: np.ndarray, regions: int, seed: int = 7) -> np.ndarray:
    """Sample points near the centres of a few of Lloyd's steps."""
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), regions, replace=False)]
    for step in range(6):
        d = (sample**2).sum(1)[:, None] - 2 * sample @ at.T + (at**2).sum(1)[None, :]
        if step == 5:
            return sample[d.argmin(axis=0)]
        own = d.argmin(axis=1)
        at = np.stack([sample[own == r].mean(axis=0) if (own == r).any() else at[r] for r in range(regions)])


def build(rows: DataFrame, dim: int, k: int, fit_rows: int = FIT_ROWS, region: int = REGION, max_regions: int = MAX_REGIONS,
          block: int = BLOCK, page: int = PAGE) -> Tree:
    """The tree over rows (vec_id, x) of length ``dim``."""
    alike = Window.partitionBy("h", "x").orderBy("vec_id")
    once = (rows.withColumn("h", F.xxhash64("x")).withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k + 1)
            .select("vec_id", "x"))
    once = cut(once, "mtree-vectors")
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    total, most = once.agg(F.count(F.lit(1)), F.max(square)).first()
    most = float(most or 0.0) * (1 + 1e-12)
    sample = _stacked(sample_ids(once, "vec_id", fit_rows).select("x").toPandas()["x"], dim)
    regions = max(1, min(max_regions, -(-total // region), len(sample)))
    pivots = _pivots(lifted(sample, most), regions)

    def deal(batches):
        for pdf in batches:
            if len(pdf):
                points = lifted(_stacked(pdf["x"], dim), most)
                d = np.stack([apart(points, p) for p in pivots])
                yield pd.DataFrame({"region": d.argmin(axis=0).astype(np.int32), "d": d.min(axis=0), "vec_id": pdf["vec_id"], "x": pdf["x"]})

    dealt = cut(once.mapInPandas(deal, "region int, d double, vec_id long, x array<long>"), "mtree-regions")
    sizes, radius = np.zeros(regions, np.int64), np.zeros(regions)
    for r in dealt.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).collect():  # a row per region
        sizes[r["region"]], radius[r["region"]] = r["n"], r["d"]
    blocks = F.get(F.lit([max(1, int(-(-s // block))) for s in sizes]), F.col("region"))

    def load(pdf):
        region, block = int(pdf["region"].iloc[0]), int(pdf["block"].iloc[0])
        pages = bulk_load(pdf["vec_id"].to_numpy(), _stacked(pdf["x"], dim), most, page)
        return pd.DataFrame([(region, block, n, p["leaf"], len(p["x"]), *(np.ascontiguousarray(p[c]).tobytes() for c in (
            "route", "x", "ids", "radius", "apart", "below"))) for n, p in enumerate(pages)], columns=[
                "region", "block", "page", "leaf", "entries", "route", "vectors", "ids", "radius", "apart", "below"])

    pages = (dealt.withColumn("block", F.pmod(F.xxhash64("x", "vec_id"), blocks).cast("int"))
             .groupBy("region", "block").applyInPandas(load, PAGES))
    return Tree(dim, Regions(most, pivots, radius, sizes), cut(pages, "mtree-pages"), block)


def opened(leaf: bool, route: np.ndarray, x: np.ndarray, ids: np.ndarray, radius: np.ndarray, apart: np.ndarray, below: np.ndarray) -> dict:
    """A page in the form that :func:`best_first` reads."""
    real = x.astype(float)
    return {"leaf": leaf, "route": route, "x": x, "real": real, "peak": float(np.abs(real).max()) if x.size else 0.0, "ids": ids,
            "radius": radius, "apart": apart, "below": below}


def _visit(tree: Tree, asked: DataFrame, k: int, chunk: int) -> DataFrame:
    """Search (key, region, limit, q) rows in the blocks of their regions."""
    dim, most, sizes = tree.dim, tree.regions.most, tree.regions.sizes
    per = np.zeros(len(sizes), np.int64)
    for r in asked.groupBy("region").count().collect():  # a row per region
        per[r["region"]] = r["count"]
    chunks = F.get(F.lit([int(-(-n // chunk)) for n in per]), F.col("region"))
    blocks = F.get(F.lit([max(1, int(-(-s // tree.block))) for s in sizes]), F.col("region"))
    left = tree.pages.where(chunks > 0).withColumn("c", F.explode(F.sequence(F.lit(0), chunks - 1)))
    right = (asked.withColumn("c", F.pmod(F.xxhash64("key"), chunks).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))))

    def scan(paged, ask):
        out = []
        if len(paged) and len(ask):
            pages = [None] * len(paged)
            for r in paged.itertuples(index=False):
                x = np.frombuffer(r.vectors, np.int64).reshape(r.entries, dim)
                pages[r.page] = opened(r.leaf, np.frombuffer(r.route, np.int64), x, np.frombuffer(r.ids, np.int64),
                                       np.frombuffer(r.radius), np.frombuffer(r.apart), np.frombuffer(r.below, np.int32))
            limits = [None if pd.isna(m) else int(m) for m in ask["limit"].astype(object)]
            for key, q, limit in zip(ask["key"], _stacked(ask["q"], dim), limits):
                s, i, same, _ = best_first(pages, q, most, k, limit)
                out.append(pd.DataFrame({"key": [key] * len(s), "vec_id": i, "score": s, "same": same}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "vec_id": [], "score": [], "same": []})

    keys = ["region", "block", "c"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, FOUND)


def top(tree: Tree, queries: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """(key, vec_id, score, same): the ``k`` best of every query (key binary, q array<long>)."""
    dim, regions = tree.dim, tree.regions

    def home(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"key": pdf["key"], "q": pdf["q"], "limit": pd.array([None] * len(pdf), "Int64"),
                                    "region": regions.bounds(_stacked(pdf["q"], dim)).argmin(axis=1).astype(np.int32)})

    def others(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            q = _stacked(pdf["q"], dim)
            bounds = regions.bounds(q)
            base = (q.astype(float)**2).sum(axis=1) + regions.most
            least = pdf["limit"].astype("Float64").to_numpy(float, na_value=-np.inf)
            far = np.sqrt(np.maximum(base - 2 * least, 0)) + SLACK * np.sqrt(base)
            go = (bounds <= far[:, None]) & (regions.sizes > 0)
            go[np.arange(len(q)), pdf["region"].to_numpy()] = False
            at, region = np.nonzero(go)
            yield pd.DataFrame({"key": pdf["key"].to_numpy()[at], "q": pdf["q"].to_numpy()[at], "limit": pdf["limit"].astype("Int64").array[at],
                                "region": region.astype(np.int32)})

    schema = "key binary, q array<long>, limit long, region int"
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda df: df.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    first = cut(queries.mapInPandas(home, schema), "mtree-home")
    near = cut(ranked(_visit(tree, first, k, chunk)), "mtree-near")
    limits = near.where(F.col("_r") == k).select("key", F.col("score").alias("limit"))
    second = cut(first.drop("limit").join(limits, "key", "left").select("key", "q", "limit", "region").mapInPandas(others, schema), "mtree-others")
    return ranked(near.drop("_r").unionByName(_visit(tree, second, k, chunk))).drop("_r")


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", column: str = "embedding", chunk: int = CHUNK,
           **sizes) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id ``every`` divides, the ``k`` other rows of largest inner product.

    ``sizes``: fit_rows, region, max_regions, block, page of :func:`build`.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{column}`").alias("v")).where(
        F.col("vec_id").isNotNull() & usable(F.col("v"))).select("vec_id", integers(F.col("v")).alias("x")).distinct()
    rows = cut(rows, "mtree-rows")
    lengths = (rows.groupBy(F.size("x").alias("dim")).agg(F.count_if(F.col("vec_id") % every == 0).alias("asked"))
               .where("asked > 0").orderBy("dim").collect())
    found = []
    for r in lengths:
        own = rows.where(F.size("x") == r["dim"])
        asked = cut(own.where(F.col("vec_id") % every == 0).select(
            F.col("vec_id").alias("query_id"), F.unhex(F.sha2(F.concat_ws(",", F.transform("x", lambda c: c.cast("string"))), 256)).alias("key"),
            F.col("x").alias("q")), "mtree-asked")
        tree = build(own, int(r["dim"]), k, **sizes)
        times = asked.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.any_value("q").alias("q"))
        times = cut(times, "mtree-queries")
        best = cut(top(tree, times.select("key", "q"), k + 1, chunk).join(times.select("key", "times"), "key"), "mtree-best")
        found.append(skew_join(asked.select("query_id", "key"), best, "key", "times", int(r["asked"])))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id")
    return (functools.reduce(DataFrame.unionByName, found).where(~F.col("same") | (F.col("vec_id") != F.col("query_id")))
            .withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
