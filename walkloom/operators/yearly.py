"""Classifiers refitted every year on all earlier rows, all years at once.

The model of year Y trains on the rows whose label was known before Y began (``cohort`` = year of ``known_on`` < Y), so
training sets are prefixes of one table. Rows stay where they are, packed into blocks of numbers; one pass over the blocks
serves every year, every tree that grows just then, and every open node:

* logistic: Newton steps on gradients and Hessians per year;
* forest: histograms of class counts per (year, tree, node), level by level, ``TREES_AT_ONCE`` trees side by side;
* boosted: histograms of gradients per (year, node); margins are kept with the blocks and renewed every ``RENEW`` trees.

Histograms are summed by key before a task picks the best split of a node; the driver gets decisions only. What it holds
depends on years, features and trees, not on rows. Sampling is a hash of the row and the tree, so a repeated task gives the same numbers.
Missing values take the median of the training rows of the year, and features without any value in them are left out for that
year. Medians and bin edges come from ``percentile_approx`` over the training rows of each year, never over later ones.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: hyper-parameters, never tuned
SEED = 42
C_INVERSE_REG = 1.0
FOREST = {"trees": 200, "depth": 6, "min_leaf": 20}
BOOSTED = {"trees": 200, "depth": 4, "rate": 0.05, "rows": 0.8, "features": 0.8, "ridge": 1.0, "min_weight": 1.0}

BINS = 64
ACCURACY = 10_000
TREES_AT_ONCE = 25
RENEW = 8
ROWS = 20_000
DRIVER_BYTES = 64 << 20


@dataclass
class Year:
    """What the training rows of one year say about the features."""

    n: int
    positive: int
    medians: np.ndarray
    edges: list[np.ndarray]
    weights: tuple[float, float] = field(init=False)

    def __post_init__(self):
        self.weights = (self.n / (2.0 * (self.n - self.positive)), self.n / (2.0 * self.positive))

    @property
    def present(self) -> np.ndarray:
        return np.isfinite(self.medians)

    def filled(self, x: np.ndarray) -> np.ndarray:
        """Features with values, missing ones filled."""
        x = x[:, self.present]
        return np.where(np.isnan(x), self.medians[self.present], x)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers of all features; a feature without values is in bin 0 throughout."""
        out = np.zeros(x.shape, np.uint8)
        for i, edges in enumerate(self.edges):
            if len(edges):
                column = np.where(np.isnan(x[:, i]), self.medians[i], x[:, i])
                out[:, i] = np.searchsorted(edges, column, side="left")
        return out


def years_of(data: DataFrame, features: list[str], skip_years: int, min_train: int) -> dict[int, Year]:
    """The years that can be predicted. Medians and edges are one aggregate over rows repeated per later year."""
    known = [r["year"] for r in data.select("year").distinct().orderBy("year").collect()]  # one row per calendar year
    later = F.filter(F.array(*[F.lit(y) for y in known[skip_years:]]), lambda y: y > F.year("known_on"))
    if not known[skip_years:]:
        return {}
    shares = [0.5, *[(i + 1) / BINS for i in range(BINS - 1)]]
    found = data.withColumn("_model", F.explode(later)).groupBy("_model").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_positive"),
        *[F.percentile_approx(c, F.array(*[F.lit(s) for s in shares]), ACCURACY).alias(f"_q{i}") for i, c in enumerate(features)])
    out = {}
    for r in found.orderBy("_model").collect():
        n, positive = r["_n"], int(r["_positive"])
        if n >= min_train and 0 < positive < n:
            q = [r[f"_q{i}"] for i in range(len(features))]
            out[r["_model"]] = Year(n, positive, np.array([x[0] if x else np.nan for x in q], float),
                                    [np.unique(np.array(x[1:], float)) if x else np.zeros(0) for x in q])
    return out


@dataclass
class Block:
    """Some training rows: hash, cohort, label, features."""

    h: np.ndarray
    cohort: np.ndarray
    y: np.ndarray
    x: np.ndarray


def blocks(data: DataFrame, features: list[str], by: list[str]):
    """Training rows as blocks; rows are dealt by hash, whatever series they belong to."""
    spark = data.sparkSession
    key = F.xxhash64(*[F.col(c) for c in by], "date")
    rows = data.select(key.alias("h"), F.year("known_on").alias("cohort"), F.col("y").cast("int").alias("y"), *features)

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                pdf = batch.to_pandas()
                block = Block(pdf["h"].to_numpy().astype(np.uint64), pdf["cohort"].to_numpy(int), pdf["y"].to_numpy(int),
                              pdf[features].to_numpy(float))
                yield pd.DataFrame({"block": [pickle.dumps(block)]})

    def packed(batches):
        import pyarrow as pa
        for pdf in pack(batches):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    parts = max(2, min(3 * spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS)))
    return rows.repartition(parts, "h").mapInArrow(packed, "block binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))


def unit(h: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) per row and salt (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((salt * 0x9E3779B97F4A7C15 + SEED) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def _summed(rdd, emit) -> dict:
    """{key: value} of what ``emit`` yields, added by key."""
    return dict(rdd.mapPartitions(lambda part: _added(part, emit)).reduceByKey(lambda a, b: a + b, min(8, rdd.getNumPartitions())).collect())


# ------------------------------------------------------------------ logistic

def fit_logistic(rdd, years: dict[int, Year], steps: int = 40) -> dict:
    """{year: (mean, scale, coefficients)}: balanced classes, unpenalised intercept, features scaled by training rows."""
    def moments(means):
        def emit(b):
            for year, about in years.items():
                x = about.filled(b.x[b.cohort < year])
                yield year, x.sum(axis=0) if means is None else ((x - means[year])**2).sum(axis=0)
        return {y: s / years[y].n for y, s in _summed(rdd, emit).items()}

    means = moments(None)
    scales = {y: np.where(v > 0, np.sqrt(v), 1.0) for y, v in moments(means).items()}
    beta = {y: np.zeros(1 + len(m)) for y, m in means.items()}
    step, value = {y: None for y in years}, {}
    for _ in range(steps):
        todo = {y: b for y, b in beta.items() if y in step}

        def emit(b, todo=todo):
            for year, coefficients in todo.items():
                rows = b.cohort < year
                z = np.column_stack([np.ones(rows.sum()), (years[year].filled(b.x[rows]) - means[year]) / scales[year]])
                yield year, _newton_sums(z, b.y[rows], coefficients, years[year].weights)

        for year, sums in _summed(rdd, emit).items():
            size = len(beta[year])
            ridge = np.ones(size) / C_INVERSE_REG
            ridge[0] = 0.0
            loss = sums[-1] + (ridge * beta[year]**2).sum() / 2
            if step[year] is not None and loss > value[year] * (1 + 1e-12):
                step[year] = step[year] / 2
                beta[year] = beta[year] - step[year]
            else:
                value[year] = loss
                gradient = sums[:size] + ridge * beta[year]
                change = -np.linalg.solve(sums[size:-1].reshape(size, size) + np.diag(ridge) + 1e-12 * np.eye(size), gradient)
                step[year], beta[year] = change, beta[year] + change
            if np.abs(step[year]).max() < 1e-10:
                del step[year]
        if not step:
            break
    return {y: (means[y], scales[y], beta[y]) for y in years}


def _newton_sums(z, y, beta, weights):
    """Gradient, Hessian and loss of weighted rows, in one vector."""
    w = np.where(y == 1, weights[1], weights[0])
    at = z @ beta
    p = 1 / (1 + np.exp(-np.clip(at, -700, 700)))
    loss = (w * (np.logaddexp(0, at) - y * at)).sum()
    return np.concatenate([z.T @ (w * (p - y)), ((z.T * (w * p * (1 - p))) @ z).ravel(), [loss]])


def score_logistic(model, about: Year, x: np.ndarray) -> np.ndarray:
    mean, scale, beta = model
    at = beta[0] + ((about.filled(x) - mean) / scale) @ beta[1:]
    return 1 / (1 + np.exp(-np.clip(at, -700, 700)))


# ------------------------------------------------------------------ trees

class Tree:
    """A complete binary tree: inner nodes in heap order, ``value`` per node of the deepest level. A closed node sends
    everything to the left."""

    def __init__(self, depth: int):
        self.depth = depth
        self.feature = np.zeros((1 << depth) - 1, np.int16)
        self.bin = np.full((1 << depth) - 1, BINS, np.uint8)
        self.value = np.zeros(1 << depth)
        self.open = {0: 0}  # node of the level that grows: its slot

    def walk(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each row, counted within its level."""
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for level in range(self.depth if levels is None else levels):
            at = node + (1 << level) - 1
            node = 2 * node + (bins[rows, self.feature[at]] > self.bin[at])
        return node

    def grow(self, level: int, choices: list, features: np.ndarray, leaf) -> None:
        """Take the splits of one level: per slot (gain or None, column, bin, left sums, right sums, all sums)."""
        children = {}
        for node, slot in self.open.items():
            column, edge, left, right, whole = choices[slot]
            if column is None:
                self._set(node, level, leaf(whole))
                continue
            at = node + (1 << level) - 1
            self.feature[at], self.bin[at] = features[slot][column], edge
            for child, sums in ((2 * node, left), (2 * node + 1, right)):
                if level + 1 == self.depth:
                    self.value[child] = leaf(sums)
                else:
                    children[child] = len(children)
        self.open = children

    def _set(self, node: int, level: int, value: float) -> None:
        width = 1 << (self.depth - level)
        self.value[node * width] = value


def histograms(bins: np.ndarray, slot: np.ndarray, features: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Sums of two statistics by (slot, feature, bin); rows with slot -1 are left out."""
    rows = np.flatnonzero(slot >= 0)
    s, width = slot[rows], features.shape[1]
    size = len(features) * width * BINS
    at = ((s[:, None] * width + np.arange(width)) * BINS + bins[rows[:, None], features[s]]).ravel()
    sums = [np.bincount(at, np.repeat(stats[rows, i], width), size) for i in (0, 1)]
    return np.stack(sums, axis=-1).reshape(len(features), width, BINS, 2)


def choose(sums: np.ndarray, gain, least: float = 0.0) -> list[tuple]:
    """Per slot the split of largest gain above ``least``: (column, bin, left, right, all); column None: no split."""
    out = []
    for slot in sums:
        left = slot.cumsum(axis=1)[:, :-1]
        whole = slot[0].sum(axis=0)
        right = whole - left
        value = gain(left, right, whole)
        best = np.unravel_index(np.argmax(value), value.shape)
        if value[best] > least:
            out.append((int(best[0]), int(best[1]), left[best], right[best], whole))
        else:
            out.append((None, None, None, None, whole))
    return out


def _slots(tree: Tree, level: int, bins: np.ndarray) -> np.ndarray:
    places = np.full(1 << level, -1)
    for node, slot in tree.open.items():
        places[node] = slot
    return places[tree.walk(bins, level)]


def _binned(years: dict[int, Year]):
    """A block with the bins of each year's training rows."""
    def run(b: Block):
        return b, {y: (rows := b.cohort < y, about.bins(b.x[rows])) for y, about in years.items()}
    return run


# ------------------------------------------------------------------ forest

def _gini(weights, min_leaf):
    def gain(left, right, whole):
        purity = lambda c: (w := c * np.array(weights), (w**2).sum(axis=-1) / np.maximum(w.sum(axis=-1), 1e-300))[1]
        fine = (left.sum(axis=-1) >= min_leaf) & (right.sum(axis=-1) >= min_leaf)
        return np.where(fine, purity(left) + purity(right) - purity(whole), -np.inf)
    return gain


_POISSON = np.cumsum([np.exp(-1.0)] + [np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(1, 12)])


def drawn(h: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree's bootstrap sample holds a row: Poisson with mean 1."""
    return np.searchsorted(_POISSON, unit(h, 2 * tree + 1), side="right").astype(float)


def node_features(n: int, year: int, tree: int, level: int, slots: int) -> np.ndarray:
    """About sqrt(n) candidate features per open node."""
    rng = np.random.default_rng([SEED, year, tree, level])
    k = max(1, int(np.sqrt(n)))
    return np.stack([np.sort(rng.choice(n, k, replace=False)) for _ in range(slots)])


def fit_forest(rdd, years: dict[int, Year], trees: int = FOREST["trees"], depth: int = FOREST["depth"],
               min_leaf: int = FOREST["min_leaf"], at_once: int = TREES_AT_ONCE) -> dict:
    """{year: trees}: bootstrap samples, balanced classes, gini."""
    binned = rdd.map(_binned(years)).persist(StorageLevel.MEMORY_AND_DISK)
    width = {y: len(a.medians) for y, a in years.items()}
    out = {y: [] for y in years}
    for first in range(0, trees, at_once):
        growing = {(y, t): Tree(depth) for y in years for t in range(first, min(trees, first + at_once))}
        for level in range(depth):
            todo = {k: t for k, t in growing.items() if t.open}
            candidates = {k: node_features(width[k[0]], *k, level, len(t.open)) for k, t in todo.items()}

            def emit(part, todo=todo, candidates=candidates, level=level):
                b, binned = part
                for (year, number), tree in todo.items():
                    rows, bins = binned[year]
                    if len(bins):
                        times, y = drawn(b.h[rows], number), b.y[rows]
                        slot = np.where(times > 0, _slots(tree, level, bins), -1)
                        yield (year, number), (histograms(bins, slot, candidates[year, number], np.column_stack([times * (y == 0), times * (y == 1)])))

            found = _decided(binned, emit, {y: _gini(a.weights, min_leaf) for y, a in years.items()}, 1e-12,
                             sum(c.size for c in candidates.values()) * BINS * 16)
            for k, tree in todo.items():
                weights = years[k[0]].weights
                tree.grow(level, found[k], candidates[k], lambda c: float(c[1] * weights[1] / max(c @ np.array(weights), 1e-300)))
        for (y, _), tree in growing.items():
            out[y].append(tree)
    binned.unpersist()
    return out


def _decided(rdd, emit, gains: dict, least: float, size: int) -> dict:
    """The splits of all open nodes. ``size``: bytes of all histograms; where the partial ones of all partitions are
    small, the driver adds them in the order of partitions, else they are added by key and only splits come back."""
    if size * rdd.getNumPartitions() <= DRIVER_BYTES:
        total = {}
        for k, v in rdd.mapPartitions(lambda part: _added(part, emit)).collect():
            total[k] = total[k] + v if k in total else v
        return {k: choose(v, gains[k[0]], least) for k, v in total.items()}
    return dict(rdd.mapPartitions(lambda part: _added(part, emit))
                .reduceByKey(lambda a, b: a + b, min(rdd.getNumPartitions(), max(1, size // DRIVER_BYTES + 1)))
                .map(lambda kv: (kv[0], choose(kv[1], gains[kv[0][0]], least))).collect())


def _added(part, emit):
    held = {}
    for block in part:
        for k, v in emit(block):
            held[k] = held[k] + v if k in held else v
    return iter(held.items())


def score_forest(model: list[Tree], about: Year, x: np.ndarray) -> np.ndarray:
    bins = about.bins(x)
    return np.mean([t.value[t.walk(bins)] for t in model], axis=0)


# ------------------------------------------------------------------ boosted trees

def _newton_gain(ridge, min_weight):
    def gain(left, right, whole):
        part = lambda s: s[..., 0]**2 / (s[..., 1] + ridge)
        fine = (left[..., 1] >= min_weight) & (right[..., 1] >= min_weight)
        return np.where(fine, part(left) + part(right) - part(whole), -np.inf)
    return gain


def fit_boosted(rdd, years: dict[int, Year], trees: int = BOOSTED["trees"], depth: int = BOOSTED["depth"], renew: int = RENEW) -> dict:
    """{year: trees}: logistic loss, second-order gains, rows and features drawn per tree."""
    held = rdd.map(_binned(years)).map(lambda p: (*p, {y: np.zeros(len(bins)) for y, (_, bins) in p[1].items()}))
    held = held.persist(StorageLevel.MEMORY_AND_DISK)
    n = len(next(iter(years.values())).medians)
    gain = _newton_gain(BOOSTED["ridge"], BOOSTED["min_weight"])
    gains = dict.fromkeys(years, gain)
    leaf = lambda s: float(-BOOSTED["rate"] * s[0] / (s[1] + BOOSTED["ridge"]))
    out, since = {y: [] for y in years}, 0
    for number in range(trees):
        if number - since == renew:
            held, since = _renewed(held, {y: t[since:] for y, t in out.items()}), number
        some = np.sort(np.random.default_rng([SEED, number]).choice(n, max(1, int(BOOSTED["features"] * n)), replace=False))
        growing = {y: Tree(depth) for y in years}
        for level in range(depth):
            todo = {y: (t, out[y][since:]) for y, t in growing.items() if t.open}
            if not todo:
                break

            def emit(part, todo=todo, level=level, number=number):
                b, binned, margins = part
                for year, (tree, fresh) in todo.items():
                    rows, bins = binned[year]
                    if len(bins):
                        at = margins[year] + sum(t.value[t.walk(bins)] for t in fresh)
                        p = 1 / (1 + np.exp(-at))
                        slot = np.where(unit(b.h[rows], 2 * number) < BOOSTED["rows"], _slots(tree, level, bins), -1)
                        features = np.tile(some, (len(tree.open), 1))
                        yield (year, 0), histograms(bins, slot, features, np.column_stack([p - b.y[rows], p * (1 - p)]))

            found = _decided(held, emit, gains, 1e-6, sum(len(t.open) for t, _ in todo.values()) * len(some) * BINS * 16)
            for year, (tree, _) in todo.items():
                tree.grow(level, found[year, 0], np.tile(some, (len(tree.open), 1)), leaf)
        for y, tree in growing.items():
            out[y].append(tree)
    held.unpersist()
    return out


def _renewed(held, fresh: dict[int, list[Tree]]):
    """The blocks with margins that count the fresh trees."""
    def run(part):
        b, binned, margins = part
        return b, binned, {y: margins[y] + sum(t.value[t.walk(bins)] for t in fresh[y]) for y, (_, bins) in binned.items()}

    out = held.map(run).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    held.unpersist()
    return out


def score_boosted(model: list[Tree], about: Year, x: np.ndarray) -> np.ndarray:
    bins = about.bins(x)
    return 1 / (1 + np.exp(-sum(t.value[t.walk(bins)] for t in model)))


MODELS = {"LR": (fit_logistic, score_logistic), "RF": (fit_forest, score_forest), "GBT": (fit_boosted, score_boosted)}


def walk_forward(data: DataFrame, features: list[str], model: str, by: list[str], skip_years: int = 2, min_train: int = 100,
                 **settings) -> DataFrame:
    """(by, date, y, prob) of every row in a year that has a model."""
    years = years_of(data, features, skip_years, min_train)
    if not years:
        raise ValueError("no year has enough training rows")
    fit, score = MODELS[model]
    rdd = blocks(data, features, by).persist(StorageLevel.MEMORY_AND_DISK)
    fitted = fit(rdd, years, **settings)
    rdd.unpersist()

    def predict(batches):
        for pdf in batches:
            prob = np.full(len(pdf), np.nan)
            x, at = pdf[features].to_numpy(float), pdf["year"].to_numpy(int)
            for year in set(at.tolist()):
                rows = at == year
                prob[rows] = score(fitted[year], years[year], x[rows])
            yield pdf[[*by, "date", "y"]].assign(prob=prob)

    kinds = ", ".join(f"`{c}` {data.schema[c].dataType.simpleString()}" for c in by)
    rows = data.where(F.col("year").isin([int(y) for y in years])).select(*by, "date", "year", F.col("y").cast("int").alias("y"), *features)
    return rows.mapInPandas(predict, f"{kinds}, date date, y int, prob double")
