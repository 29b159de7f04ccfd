"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are dealt to lists around centroids fitted on a bounded sample. A query scans its nearest
lists. A list is scanned in blocks of vectors laid out by columns and turned by a random rotation, after
which every column block carries a fair share of a distance: from the partial distance over the first d
of D columns a hypothesis test decides whether the whole distance can still be below the best k found, and
abandons the vector if not. Survivors get their exact distance on the original vectors in double precision.

Lists are split into blocks of bounded size, and so are the queries of a list, so neither a hot list nor a
hot query set lands in one task. Of equal vectors only the k + 1 with the smallest ids can be among
anybody's k nearest; the others are left out before lists are made, which loses nothing.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom.llm.common import cut, sample_ids

FIT_ROWS = 20_000
MAX_LISTS = 2_048
BLOCK = 4_096
COLUMNS = (8, 8, 16, 32)
EPSILON = 2.1
#: Components and distances between 1 / EXTREME and EXTREME can be squared and summed as they are.
EXTREME = 1e150


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    dim: int
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        d = (x**2).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1)[None, :]
        return np.argsort(d, axis=1, kind="stable")[:, :n]


def fit(sample: np.ndarray, total: int, k: int = 10, goal: float = 0.985, max_lists: int = MAX_LISTS, seed: int = 5) -> Index:
    """Centroids by Lloyd's steps, a rotation, and the number of lists to probe: as many as hold ``goal``
    of the k nearest sample rows of sample queries."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    lists = max(1, min(max_lists, int(math.sqrt(total)), len(sample) // 8 or 1))
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    index = Index(dim, centroids, np.linalg.qr(rng.normal(size=(dim, dim)))[0], lists)
    for _ in range(12):
        at = index.nearest(sample, 1)[:, 0]
        size = np.bincount(at, minlength=lists)
        total_of = np.zeros_like(index.centroids)
        np.add.at(total_of, at, sample)
        some = size > 0
        index.centroids[some] = total_of[some] / size[some, None]
    at = index.nearest(sample, 1)[:, 0]
    asked = rng.choice(len(sample), min(400, len(sample)), replace=False)
    order = index.nearest(sample[asked], lists)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :], axis=1)
    d = ((sample[asked]**2).sum(1)[:, None] - 2 * sample[asked] @ sample.T + (sample**2).sum(1)[None, :])
    d[np.arange(len(asked)), asked] = np.inf
    best = np.argsort(d, axis=1)[:, :min(k, len(sample) - 1)]
    needed = np.sort(np.take_along_axis(place, at[best], axis=1).ravel()) if best.size else np.zeros(1)
    index.probes = int(needed[min(len(needed) - 1, int(goal * len(needed)))]) + 1
    return index


def scan_block(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray,
               k: int = 10, epsilon: float = EPSILON, columns=COLUMNS) -> tuple[list, list, list]:
    """The k nearest of a block for every query, as (query ids, ids, distances)."""
    dim = block.shape[1]
    turned, turned_q = block @ rotation, queries @ rotation
    edges = [0]
    for width in columns:
        if edges[-1] < dim:
            edges.append(min(dim, edges[-1] + width))
    while edges[-1] < dim:
        edges.append(min(dim, edges[-1] + columns[-1]))
    strips = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(edges, edges[1:])]
    out_q, out_v, out_d = [], [], []
    peak = max(np.abs(block).max(initial=0), np.abs(queries).max(initial=0))
    far_out = not peak < EXTREME  # squares overflow: nothing is abandoned, distances are scaled

    def exact(rows, q):
        with np.errstate(over="ignore"):
            d = np.sqrt(((block[rows] - q)**2).sum(axis=1))
        odd = np.flatnonzero(~((d > 1 / EXTREME) & (d < EXTREME)))
        if len(odd):  # beyond the range of squares
            apart = np.abs(block[rows][odd] / 2 - q / 2)
            most = np.maximum(apart.max(axis=1), 5e-324)
            with np.errstate(over="ignore"):
                d[odd] = 2 * (most * np.sqrt(((apart / most[:, None])**2).sum(axis=1)))
        return d

    for qid, q, tq in zip(query_ids, queries, turned_q):
        partial = np.zeros(len(ids)) if far_out else ((strips[0] - tq[:edges[1]])**2).sum(axis=1)
        alive = np.flatnonzero(ids != qid)
        if not len(alive):
            continue
        first = alive if len(alive) <= k else alive[np.argpartition(partial[alive], k - 1)[:k]]
        limit = float((exact(first, q)**2).max()) if len(first) >= k and not far_out else np.inf
        for i in range(1, 1 if far_out else len(edges) - 1):
            d = edges[i]
            bound = limit * (d / dim) * (1 + epsilon / math.sqrt(d))**2 * (1 + 1e-9)
            alive = alive[partial[alive] <= bound]
            partial[alive] += ((strips[i][alive] - tq[d:edges[i + 1]])**2).sum(axis=1)
        alive = alive[partial[alive] <= limit * (1 + 1e-9) + 1e-300]
        alive = np.union1d(alive, first)
        dist = exact(alive, q)
        top = np.lexsort((ids[alive], dist))[:k]
        out_q += [qid] * len(top)
        out_v += ids[alive][top].tolist()
        out_d += dist[top].tolist()
    return out_q, out_v, out_d


def search(vectors: DataFrame, every: int = 100, k: int = 10, fit_rows: int = FIT_ROWS, goal: float = 0.985,
           max_lists: int = MAX_LISTS, block: int = BLOCK, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows whose id ``every`` divides, their k nearest others.

    Rows with a null id, or a vector that is null, empty, zero, or holds null or non-finite components take no part. Vectors are
    compared with those of their own length: there is one index and one search per length (lengths are few, and counted first).
    Repeated rows count once. Ties go to the smaller id. Where squares of components or distances would overflow or vanish, distances are
    scaled, and a block with such components is compared in full; a distance beyond double precision is infinite.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).alias("v")).where(
        F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = (fine.groupBy(F.size("v").alias("dim"))
               .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"))
               .where("asked > 0").orderBy("dim").collect())
    found = [_candidates(fine, int(r["dim"]), int(r["n"]), vectors.schema[column].dataType.simpleString(), every, k, fit_rows,
                         goal, max_lists, block) for r in lengths]
    if not found:
        return empty
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (functools.reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _candidates(fine: DataFrame, dim: int, total: int, kind: str, every: int, k: int, fit_rows: int, goal: float,
                max_lists: int, block: int) -> DataFrame:
    """(query_id, vec_id, score) among the ``total`` rows of ``fine`` whose vectors have ``dim`` components."""
    fine = fine.where(F.size("v") == dim).withColumn("h", F.xxhash64("v"))
    alike = Window.partitionBy("h", "v").orderBy("vec_id")
    once = fine.distinct().withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k + 1).select("vec_id", "v")
    once = cut(once, "ann-vectors")
    peak = once.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c).cast("double"))))).first()[0] or 0.0
    shrink = 1.0 if peak < 1e100 else 1.0 / peak  # lists are made on vectors that can be squared
    sample = np.array(sample_ids(once, "vec_id", fit_rows).select("v").toArrow()["v"].to_pylist(), dtype=float) * shrink
    index = fit(sample, total, k, goal, max_lists)
    lists = len(index.centroids)
    centroids, rotation = index.centroids, index.rotation

    def stacked(series):
        return np.stack(series.to_numpy()).astype(float)

    def deal(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"list": index.nearest(stacked(pdf["v"]) * shrink, 1)[:, 0].astype(np.int32),
                                    "vec_id": pdf["vec_id"], "v": pdf["v"]})

    dealt = cut(once.mapInPandas(deal, f"list int, vec_id long, v {kind}"), "ann-lists")
    sizes = np.zeros(lists, np.int64)
    for row in dealt.groupBy("list").count().collect():  # one row per list
        sizes[row["list"]] = row["count"]

    def ask(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            order = index.nearest(stacked(pdf["v"]) * shrink, lists)
            reach = np.cumsum(sizes[order], axis=1)
            # on and on until the lists hold enough vectors
            n = np.maximum(index.probes, (reach < k + 1).sum(axis=1) + 1).clip(max=lists)
            yield pd.DataFrame({"query_id": np.repeat(pdf["vec_id"].to_numpy(), n),
                                "list": np.concatenate([o[:m] for o, m in zip(order, n)]).astype(np.int32),
                                "q": [v for v, m in zip(pdf["v"], n) for _ in range(m)]})

    queries = fine.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    asked = cut(queries.mapInPandas(ask, f"query_id long, list int, q {kind}"), "ann-queries")
    per = np.zeros(lists, np.int64)
    for row in asked.groupBy("list").count().collect():
        per[row["list"]] = row["count"]
    v_parts = F.get(F.lit([int(-(-s // block)) or 1 for s in sizes]), F.col("list"))
    q_parts = F.get(F.lit([int(-(-s // (block // 2))) or 1 for s in per]), F.col("list"))
    left = (dealt.withColumn("b", F.pmod(F.xxhash64("vec_id"), v_parts).cast("int"))
            .withColumn("c", F.explode(F.sequence(F.lit(0), q_parts - 1))))
    right = (asked.withColumn("c", F.pmod(F.xxhash64("query_id", F.lit(3)), q_parts).cast("int"))
             .withColumn("b", F.explode(F.sequence(F.lit(0), v_parts - 1))))

    def scan(vec, ask):
        if not len(vec) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, v, d = scan_block(vec["vec_id"].to_numpy(), stacked(vec["v"]), ask["query_id"].to_numpy(), stacked(ask["q"]), rotation, k)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": d})

    keys = ["list", "b", "c"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")
