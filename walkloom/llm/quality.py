"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns one lookup table per feature (bins of the feature to an
additive log-odds term), then tables over pairs of coarser bins for the pairs that explain most
of what is left. A score is the logistic of the sum of looked-up values, so scoring a batch is a
handful of vectorised bin searches and additions.

The features are computed from whole texts in tasks. The fit sees at most ``fit_rows`` labelled
rows, drawn in hash order of their ids: the bound that keeps the driver's part small. A row of the
fit is a few dozen numbers, never a text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.llm import bytesets as B
from walkloom.llm.common import extended, fold, one_per_id, sample_ids, slices

FEATURES = (
    "log_bytes", "log_words", "word_len", "sentence_len", "line_len", "space_share", "punct_share",
    "digit_share", "upper_share", "high_share", "comma_dot_share", "bar_share", "bang_share",
    "symbol_share", "end_punct_lines", "word_variety", "top_word_share", "repeated_lines",
    "upper_words", "symbol_words", "worst_line_symbols", "worst_line_upper", "short_lines",
    "non_alpha_words",
)

_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?"]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"-()"]] = True
_SYMBOL = B.PUNCT & ~_PLAIN


def features(text: str | None) -> np.ndarray:
    """The feature vector of one whole text; null and empty texts give zeros."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    counts = np.bincount(data, minlength=256)
    letters = max(int(counts[B.LETTER].sum()), 1)
    space = B.SPACE[data]
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = len(starts)
    out[0], out[1] = np.log1p(n), np.log1p(words)
    if not words:
        return out
    length = ends - starts
    out[2] = length.mean()
    out[3] = words / (1 + counts[_SENTENCE_END].sum())
    breaks = np.flatnonzero(data == 10)
    lines = np.diff(np.concatenate(([-1], breaks, [n]))) - 1
    out[4] = np.log1p(lines.mean())
    out[5] = space.sum() / n
    out[6] = counts[B.PUNCT].sum() / n
    out[7] = counts[B.DIGIT].sum() / n
    out[8] = counts[B.UPPER].sum() / letters
    out[9] = counts[B.HIGH].sum() / letters
    out[10] = (counts[ord(",")] + counts[ord(".")]) / n
    out[11] = counts[ord("|")] / n
    out[12] = counts[ord("!")] / n
    out[13] = counts[_SYMBOL].sum() / n
    rows = raw.split(b"\n")
    out[14] = sum(r.rstrip().endswith((b".", b"!", b"?")) for r in rows) / len(rows)
    seen = Counter(raw.lower().split())
    out[15] = len(seen) / np.sqrt(words)
    out[16] = max(seen.values()) / words
    out[17] = 1 - len(set(rows)) / len(rows)
    low = np.concatenate(([0], np.cumsum(B.LOWER[data])))
    up = np.concatenate(([0], np.cumsum(B.UPPER[data])))
    sym = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    alpha = np.concatenate(([0], np.cumsum(B.LETTER[data])))
    word_up, word_low = up[ends] - up[starts], low[ends] - low[starts]
    out[18] = ((word_up > 1) & (word_low == 0)).sum() / words
    out[19] = ((sym[ends] - sym[starts]) > 0).sum() / words
    first = np.concatenate(([0], breaks + 1))
    last = np.concatenate((breaks, [n]))
    size = np.maximum(last - first, 1)
    weight = np.minimum(size / 40.0, 1.0)
    out[20] = ((sym[last] - sym[first]) / size * weight).max()
    out[21] = ((up[last] - up[first]) / np.maximum(alpha[last] - alpha[first], 1) * weight).max()
    out[22] = (size < 20).mean()
    out[23] = ((alpha[ends] - alpha[starts]) == 0).sum() / words
    return out


@dataclass
class Additive:
    """Lookup tables: ``edges[j]`` cuts feature j into bins, ``terms[j]`` holds one value per bin;
    ``pairs`` holds (j, k, edges_j, edges_k, table)."""

    intercept: float
    edges: list[np.ndarray]
    terms: list[np.ndarray]
    pairs: list[tuple] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, term) in enumerate(zip(self.edges, self.terms)):
            total += term[np.searchsorted(edges, x[:, j], side="right")]
        for j, k, ej, ek, tab in self.pairs:
            total += tab[np.searchsorted(ej, x[:, j], side="right"),
                         np.searchsorted(ek, x[:, k], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, penalty: float) -> np.ndarray:
    """Values per bin of a shallow regression tree over ordered bins, best splits first."""
    g, h = np.concatenate(([0.0], np.cumsum(grad))), np.concatenate(([0.0], np.cumsum(hess)))

    def best(a, b):
        if b - a < 2:
            return (0.0, None)
        at = np.arange(a + 1, b)
        gl, hl = g[at] - g[a], h[at] - h[a]
        gr, hr = g[b] - g[at], h[b] - h[at]
        gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - (g[b] - g[a])**2 / (h[b] - h[a] + penalty)
        i = int(np.argmax(gain))
        return (float(gain[i]), int(at[i]))

    parts = [(0, len(grad), best(0, len(grad)))]
    while len(parts) < leaves:
        i = max(range(len(parts)), key=lambda p: parts[p][2][0])
        a, b, (gain, at) = parts[i]
        if at is None or gain <= 1e-9:
            break
        parts[i:i + 1] = [(a, at, best(a, at)), (at, b, best(at, b))]
    out = np.zeros(len(grad))
    for a, b, _ in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + penalty)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 8, n_pairs: int = 8,
        rounds: int = 200, pair_rounds: int = 60, rate: float = 0.1, leaves: int = 3,
        penalty: float = 4.0) -> Additive:
    """Cyclic boosting: each round visits every feature once with a small step. With one class
    only, or without rows, the model is its smoothed prior."""
    n, m = x.shape
    base = (y.sum() + 0.5) / (n + 1.0)
    intercept = float(np.log(base / (1 - base)))
    edges = [cuts(x[:, j], bins) if n else np.zeros(0) for j in range(m)]
    terms = [np.zeros(len(e) + 1) for e in edges]
    if n == 0 or len(np.unique(y)) < 2:
        return Additive(intercept, edges, terms)
    place = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    f = np.full(n, intercept)
    for _ in range(rounds):
        for j in range(m):
            size = len(terms[j])
            if size < 2:
                continue
            p = 1 / (1 + np.exp(-f))
            step = rate * _tree(np.bincount(place[j], y - p, size),
                                np.bincount(place[j], p * (1 - p), size), leaves, penalty)
            terms[j] += step
            f += step[place[j]]
    coarse = [cuts(x[:, j], pair_bins) for j in range(m)]
    cell = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    p = 1 / (1 + np.exp(-f))
    res, hess = y - p, p * (1 - p)
    ranked = []
    for j in range(m):
        for k in range(j + 1, m):
            at = cell[j] * (len(coarse[k]) + 1) + cell[k]
            size = (len(coarse[j]) + 1) * (len(coarse[k]) + 1)
            g, h = np.bincount(at, res, size), np.bincount(at, hess, size)
            ranked.append((float((g**2 / (h + penalty)).sum()), j, k, at, size))
    ranked.sort(key=lambda r: (-r[0], r[1], r[2]))
    chosen = ranked[:n_pairs]
    tables = [np.zeros(r[4]) for r in chosen]
    for _ in range(pair_rounds):
        for (_, _, _, at, size), tab in zip(chosen, tables):
            p = 1 / (1 + np.exp(-f))
            g, h = np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)
            step = rate * g / (h + penalty)
            tab += step
            f += step[at]
    pairs = [(j, k, coarse[j], coarse[k], tab.reshape(len(coarse[j]) + 1, len(coarse[k]) + 1))
             for (_, j, k, _, _), tab in zip(chosen, tables)]
    return Additive(intercept, edges, terms, pairs)


def _matrix(texts) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if len(texts) else np.zeros((0, len(FEATURES)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int) -> DataFrame:
    """(label, features) of the bounded sample. Ids that carry both label values are left out,
    repeated equal labels count once; the sample of at most ``fit_rows`` ids is broadcast. Of a repeated
    id the least text is taken."""
    good = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
            .groupBy("doc_id").agg(F.min(label).alias("_y"), F.max(label).alias("_y2"))
            .where(F.col("_y") == F.col("_y2")).select("doc_id", F.col("_y").cast("int").alias("_y")))
    chosen = sample_ids(good, "doc_id", fit_rows).withColumnRenamed("doc_id", "_id")
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
            .select("_id", "text", "_y").transform(one_per_id, "_id").select("text", "_y"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["_y"], "x": list(_matrix(pdf["text"].tolist()))})

    return rows.mapInPandas(run, "y int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 12_000, **knobs) -> Additive:
    got = training_rows(docs, labels, "quality", fit_rows).toArrow()
    y = np.asarray(got["y"].to_numpy(), dtype=float)
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(len(y), len(FEATURES))
    order = np.lexsort(np.column_stack([x, y]).T[::-1])  # the same model whatever the arrival order
    return fit(x[order], y[order], **knobs)


def score(docs: DataFrame, model: Additive, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted appended (columns of those names are replaced).
    Null and empty texts are scored like any other, from a vector of zeros."""
    kept = docs.drop("score", "predicted")
    schema = extended(kept, score="double")
    names = kept.columns

    def run(batches):
        import pyarrow as pa
        for batch in slices(batches):
            values = model.score(_matrix(batch.column(names.index("text")).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())],
                                             names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, schema).withColumn(
        "predicted", (F.col("score") >= F.lit(threshold)).cast("int"))
