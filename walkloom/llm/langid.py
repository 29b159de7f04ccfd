"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte n-grams of words written in lower-case letters between blanks; each hashes
to a row of an embedding table, a text is the mean of its rows, a linear softmax names the
language. Table and softmax are trained together by stochastic gradient descent in numpy on at
most ``fit_rows`` documents. Scoring multiplies the two once, so a text costs one lookup per
n-gram. A temperature fitted on rows kept out of the descent calibrates the probability; a text
whose calibrated probability is below a threshold chosen on the same rows is marked rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.llm import bytesets as B
from walkloom.llm.common import extended, fold, one_per_id, sample_ids, slices

UNKNOWN = "und"
BUCKETS = 1 << 15
SIZES = (2, 3, 4)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def buckets(text: str | None) -> np.ndarray:
    """Bucket of every subword of a whole text: n-grams of letters with one blank allowed at
    either end, never inside."""
    if not text:
        return np.zeros(0, np.int64)
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    plain = np.concatenate(([32], B.LETTERS_ONLY[data], [32])).astype(np.uint8)
    blank = plain == 32
    keep = np.ones(len(plain), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    plain = plain[keep]
    blank = np.concatenate(([0], np.cumsum(plain == 32)))
    wide = plain.astype(np.uint64)
    out = []
    for n in SIZES:
        m = len(wide) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | wide[i:i + m]
        inner = blank[n - 1:n - 1 + m] - blank[1:1 + m] if n > 2 else np.zeros(m, int)
        both = (plain[:m] == 32) & (plain[n - 1:n - 1 + m] == 32)
        ok = (inner == 0) & ~both
        out.append(((code[ok] * _MULT) >> np.uint64(64 - 15)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray      # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str | None) -> np.ndarray:
        b = buckets(text)
        if not len(b):
            return self.bias.astype(float)
        return np.bincount(b, minlength=BUCKETS) @ self.table / len(b) + self.bias

    def probabilities(self, texts) -> np.ndarray:
        if not len(texts):
            return np.zeros((0, len(self.langs)))
        return _softmax(np.stack([self.logits(t) for t in texts]) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], dim: int = 16, epochs: int = 8,
        rate: float = 0.5, batch: int = 16, seed: int = 7, max_error: float = 0.01) -> Model:
    """``rows``: (buckets, counts, language). One row in five calibrates and is not trained on."""
    langs = sorted({r[2] for r in rows})
    if not langs:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    w, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    of = {name: i for i, name in enumerate(langs)}
    data = [(b, (c / c.sum()).astype(np.float32), of[y]) for b, c, y in rows if len(b)]
    order = rng.permutation(len(data))
    held, used = order[::5], np.setdiff1d(order, order[::5])
    if len(used) == 0:
        used = held
    steps = epochs * -(-len(used) // batch)
    step = 0
    for _ in range(epochs):
        turn = rng.permutation(used)
        for a in range(0, len(turn), batch):
            mine = [data[i] for i in turn[a:a + batch]]
            hidden = np.stack([c @ emb[b] for b, c, _ in mine])
            p = _softmax(hidden @ w + bias)
            p[np.arange(len(mine)), [y for *_, y in mine]] -= 1
            lr = rate * (1 - step / steps)
            back = p @ w.T
            w -= lr * hidden.T @ p / len(mine) * 4
            bias -= lr * p.mean(axis=0)
            for (b, c, _), g in zip(mine, back):
                emb[b] -= (lr * 40 / len(mine)) * c[:, None] * g
            step += 1
    model = Model(langs, emb @ w, bias)
    if len(held):
        z = np.stack([data[i][1] @ model.table[data[i][0]] + bias for i in held])
        y = np.array([data[i][2] for i in held])
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        p = _softmax(z / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y
        model.threshold = reject_below(top, right, max_error)
    return model


def reject_below(top: np.ndarray, right: np.ndarray, max_error: float) -> float:
    """The smallest probability from which on the accepted rows err in at most ``max_error``."""
    order = np.argsort(-top, kind="stable")
    errors = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(errors <= max_error)
    return float(top[order[fine[-1]]]) if len(fine) else 1.0


def train(docs: DataFrame, fit_rows: int = 4_000, **knobs) -> Model:
    """Learns from text and lang of rows outside the held-out fold. Tasks turn whole texts into
    bucket counts (at most ``BUCKETS`` per row); only those of the bounded sample reach the driver. Of
    a repeated id the least (text, lang) is learned; ids may have any type."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                       & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    ids = sample_ids(known.select("doc_id").distinct(), "doc_id", fit_rows).withColumnRenamed("doc_id", "_id")
    rows = (known.select("doc_id", "text", "lang").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
            .select("doc_id", "text", "lang").transform(one_per_id, "doc_id"))

    def run(batches):
        for pdf in batches:
            got = [np.unique(buckets(t), return_counts=True) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"],
                                "b": [g[0].astype(np.int32) for g in got],
                                "c": [g[1].astype(np.int32) for g in got]})

    got = rows.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, b array<int>, c array<int>").toArrow()
    b, c = got["b"].combine_chunks(), got["c"].combine_chunks()
    ids, langs = got["doc_id"].to_pylist(), got["lang"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], langs[i]))
    return fit([(np.asarray(b[i].values.to_numpy()), np.asarray(c[i].values.to_numpy()).astype(float), langs[i])
                for i in order], **knobs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected appended (columns of those names are replaced).
    A text that is null or has no letter is ``und`` with score 0 and rejected."""
    kept = docs.drop("lang_pred", "score", "rejected")
    schema = extended(kept, lang_pred="string", score="double", rejected="boolean")
    at = kept.columns.index("text")

    def run(batches):
        import pyarrow as pa
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            p = model.probabilities(texts)
            some = np.array([letters(t) for t in texts], bool)
            best, top = p.argmax(axis=1), p.max(axis=1) if len(p) else np.zeros(0)
            names = [model.langs[i] if s else UNKNOWN for i, s in zip(best, some)]
            top = np.where(some, top, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(top, pa.float64()),
                 pa.array(~some | (top < model.threshold))],
                names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, schema)
