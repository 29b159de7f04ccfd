"""Toxicity: class-conditional Kneser-Ney models over bytes.

Texts are read as lower-case letters between single blanks. Each class (toxic, ordinary) has its
own counts of 5-grams; everything below them is one shared backoff model made of continuation
counts (how many different 5-grams, 4-grams, ... end in these bytes), so an expression that one
class has not seen falls back to the same probability in both and says little, while expressions
that only one class uses weigh fully. A 5-gram seen in neither class has the log ratio of the two
backoff weights of its context. A text is scored by its length-normalised difference of
log-likelihoods and by the largest such difference over short windows, which a logistic curve
fitted on a fold kept out of the counts turns into a probability.

Counting, continuation counts and smoothing are Spark aggregations and joins over all labelled
documents; what they gather grows with the corpus, and so does the finished model: every 5-gram and
every context has its own key. Keys and log ratios go to the tasks as broadcasts of at most ``PIECE``
keys each, in ranges of keys. A task looks a few texts up in one range after the other and holds one
range at a time; the driver passes them on one at a time, too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.llm import bytesets as B
from walkloom.llm.common import cut, extended, fold, one_per_id, sample_ids, slices
from walkloom.llm.idfilter import build, matching

ORDER = 5
DISCOUNT = 0.75
#: What a class's 5-gram counted once, twice, or more often gives to the shared backoff model.
CLASS_DISCOUNTS = (0.9, 1.6, 2.2)
WINDOWS = (12, 32)
#: Keys of the finished tables: every five bytes have their own.
SLOTS = 1 << 40
#: Keys in one broadcast, and letters that are looked up together.
PIECE = 1 << 20
LETTERS = 1 << 20


def plain(text: str | None) -> np.ndarray:
    """Lower-case letter bytes, words between single blanks; empty for null and letterless texts."""
    if not text:
        return np.zeros(0, np.uint8)
    data = B.LETTERS_ONLY[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    data = np.concatenate(([32], data, [32])).astype(np.uint8)
    blank = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    data = data[keep]
    return data if len(data) > 1 else np.zeros(0, np.uint8)


def codes(data: np.ndarray, n: int) -> np.ndarray:
    """Every n-gram of bytes as one number."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    wide = data.astype(np.int64)
    out = np.zeros(m, np.int64)
    for i in range(n):
        out = (out << 8) | wide[i:i + m]
    return out


def opened(piece):
    """(keys, ratios) of a piece, a tuple or a broadcast; a broadcast is read and not kept."""
    if isinstance(piece, tuple):
        return piece
    plain_file = piece._sc is None and getattr(piece, "_path", None) and not hasattr(piece, "_value")  # a task, not encrypted
    return piece.load_from_path(piece._path) if plain_file else piece.value


def looked_up(pieces, grams: np.ndarray) -> np.ndarray:
    """The ratio of each of the ascending ``grams``, NaN where no piece has it."""
    out = np.full(len(grams), np.nan)
    for piece in pieces:
        keys, ratios = opened(piece)
        a, b = np.searchsorted(grams, keys[0]), np.searchsorted(grams, keys[-1], "right")
        at = np.searchsorted(keys, grams[a:b])
        hit = keys[at] == grams[a:b]
        out[a:b][hit] = ratios[at[hit]]
    return out


@dataclass
class Model:
    grams: list            # pieces (keys, log ratios) of the 5-grams seen in training, in ranges of keys
    contexts: list         # the same of backoff weights of 4-byte contexts
    weights: np.ndarray    # logistic curve over `shape`

    @property
    def seen(self) -> np.ndarray:
        """Log ratios of all seen 5-grams in the order of their keys."""
        return np.concatenate([np.zeros(0, np.float32), *[opened(p)[1] for p in self.grams]])

    def ratios(self, texts) -> list[np.ndarray]:
        """The log ratio at every position: of the 5-gram, else of its context, else 0."""
        five = [codes(plain(t), ORDER) for t in texts]
        flat = np.concatenate([np.zeros(0, np.int64), *five])
        once = np.unique(flat)
        known = looked_up(self.grams, once)
        new = np.isnan(known)
        heads = once[new] >> 8  # ascending, too
        known[new] = np.nan_to_num(looked_up(self.contexts, heads))
        flat = known[np.searchsorted(once, flat)]
        return np.split(flat, np.cumsum([len(f) for f in five])[:-1])

    def shape(self, r: np.ndarray) -> np.ndarray:
        """Length-normalised log-likelihood difference of the whole text and its largest value over
        windows; zeros for a text without letters."""
        out = np.zeros(2 + len(WINDOWS))
        if not len(r):
            return out
        out[0] = r.mean()
        total = np.concatenate(([0.0], np.cumsum(r)))
        for i, w in enumerate(WINDOWS):
            size = min(w, len(r))
            out[1 + i] = (total[size:] - total[:-size]).max() / w
        out[-1] = np.log1p(len(r)) / 10
        return out

    def shapes(self, texts) -> np.ndarray:
        """``shape`` of every text, as many texts at a time as have ``LETTERS`` letters together."""
        out, some, n = [], [], 0
        for i, text in enumerate(texts):
            some.append(text)
            n += len(text or "")
            if n >= LETTERS or i == len(texts) - 1:
                out += [self.shape(r) for r in self.ratios(some)]
                some, n = [], 0
        return np.array(out, float).reshape(len(out), 2 + len(WINDOWS))

    def score(self, texts) -> np.ndarray:
        x = self.shapes(texts)
        z = np.column_stack([x, np.ones(len(x))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pieces(table: DataFrame, name: str, size: int = PIECE) -> list:
    """Broadcasts of (ascending keys, ratios) of a (slot, ratio) table, in ranges of about ``size``
    keys. The driver knows the first key of every range and holds one range at a time."""
    table = cut(table, f"toxicity-{name}")
    parts = -(-table.count() // size) or 1

    def pack(batches):
        import pyarrow as pa
        got = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        for a in range(0, got.num_rows if got else 0, size):
            keys, ratios = (got.column(i).slice(a, size).to_numpy() for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(keys[0])]), pa.array([len(keys)], pa.int64()), pa.array([keys.astype(np.int64).tobytes()], pa.binary()),
                 pa.array([ratios.astype(np.float32).tobytes()], pa.binary())], names=["first", "n", "keys", "ratios"])

    ranges = cut(table.select("slot", "ratio").repartitionByRange(parts, "slot").sortWithinPartitions("slot")
                 .mapInArrow(pack, "first long, n long, keys binary, ratios binary"), f"toxicity-{name}-ranges")
    groups, held = [], size
    for row in ranges.select("first", "n").orderBy("first").toLocalIterator():
        if held + row["n"] > size:
            groups.append([row["first"], row["first"]])
            held = 0
        groups[-1][1] = row["first"]
        held += row["n"]
    out = []
    for a, b in groups:
        got = sorted(ranges.where(F.col("first").between(a, b)).select("first", "keys", "ratios").collect())
        out.append(table.sparkSession.sparkContext.broadcast(
            (np.frombuffer(b"".join(r["keys"] for r in got), np.int64),
             np.frombuffer(b"".join(r["ratios"] for r in got), np.float32))))
    return out


def clean_labels(labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, _y) once per id; ids with both values, null ids and null labels are left out."""
    return (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.min(label).alias("_y"), F.max(label).alias("_y2"))
            .where(F.col("_y") == F.col("_y2")).select(F.col("doc_id").alias("_id"), F.col("_y").cast("int").alias("_y")))


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary) over ``rows`` (text, _y). Each task adds up what it has read before
    anything is shuffled."""
    def run(batches):
        size = 1 << 18
        keys, vals = [], []
        total = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)

        def merged(keys, vals, total):
            k = np.concatenate([total[0], *keys])
            v = np.concatenate([total[1], *vals])
            u, at = np.unique(k, return_inverse=True)
            return u, np.column_stack([np.bincount(at, v[:, i], len(u)) for i in (0, 1)]).astype(np.int64)

        def frames(total):
            for a in range(0, len(total[0]), size):
                yield pd.DataFrame({"gram": total[0][a:a + size], "t": total[1][a:a + size, 0],
                                    "o": total[1][a:a + size, 1]})

        waiting = 0
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["_y"]):
                u = np.unique(codes(plain(text), ORDER))  # a document votes once for an expression
                two = np.zeros((len(u), 2), np.int64)
                two[:, 0 if y else 1] = 1
                keys.append(u)
                vals.append(two)
                waiting += len(u)
                if waiting > 1 << 20:
                    total, keys, vals, waiting = merged(keys, vals, total), [], [], 0
                    if len(total[0]) > 1 << 22:
                        yield from frames(total)
                        total = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        yield from frames(merged(keys, vals, total))

    return (rows.select("text", "_y").mapInPandas(run, "gram long, t long, o long")
            .groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))


def log_ratios(grams: DataFrame, slots: int = SLOTS, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """(slot, ratio) tables: of seen 5-grams, and of 4-byte contexts. A slot is the gram itself.

    With fewer ``slots`` than keys, those shared by several grams hold the mean weighted by their counts.
    """
    low = lambda n: F.lit((1 << (8 * n)) - 1)
    # shared lower orders: a gram counts once for every different longer gram that ends in it
    kinds = grams.select(F.col("gram").bitwiseAND(low(4)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    levels = {4: kinds}
    for n in (3, 2, 1):
        kinds = (levels[n + 1].select(F.col("g").bitwiseAND(low(n)).alias("g"))
                 .groupBy("g").agg(F.count(F.lit(1)).alias("c")))
        levels[n] = kinds
    total, kinds = levels[1].agg(F.sum("c"), F.count(F.lit(1))).first()  # of at most 256 bytes
    shared = levels[1].select("g", ((F.col("c") - discount + discount * kinds / 256.0)
                                    / F.lit(float(total or 1))).alias("p"))
    for n in (2, 3, 4):
        ctx = F.shiftright("g", 8)
        here = levels[n].withColumn("h", ctx)
        per = here.groupBy("h").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        below = shared.select(F.col("g").alias("b"), F.col("p").alias("pb"))
        shared = (here.join(per, "h").withColumn("b", F.col("g").bitwiseAND(low(n - 1))).join(below, "b")
                  .select("g", ((F.greatest(F.col("c") - discount, F.lit(0.0))
                                 + discount * F.col("kinds") * F.col("pb")) / F.col("total")).alias("p")))
    once, twice, more = CLASS_DISCOUNTS
    given = lambda c: (F.when(F.col(c) >= 3, F.lit(more)).when(F.col(c) == 2, F.lit(twice))
                       .when(F.col(c) == 1, F.lit(once)).otherwise(F.lit(0.0)))
    per = (grams.groupBy(F.shiftright("gram", 8).alias("h"))
           .agg(*[F.sum(c).alias(f"n{c}") for c in "to"], *[F.sum(given(c)).alias(f"k{c}") for c in "to"]))
    # without any count of the context the class's backoff weight is 1
    weight = lambda c: F.when(F.col(f"n{c}") > 0, F.col(f"k{c}") / F.col(f"n{c}")).otherwise(F.lit(1.0))
    prob = lambda c: (F.when(F.col(f"n{c}") > 0, (F.col(c) - given(c)) / F.col(f"n{c}"))
                      .otherwise(F.lit(0.0)) + weight(c) * F.col("p"))
    seen = (grams.withColumn("h", F.shiftright("gram", 8)).withColumn("g", F.col("gram").bitwiseAND(low(4)))
            .join(per, "h").join(shared, "g")
            .select("gram", (F.col("t") + F.col("o")).alias("n"), F.log(prob("t") / prob("o")).alias("r")))
    contexts = per.select(F.col("h").alias("gram"), (F.col("nt") + F.col("no")).alias("n"),
                          F.log(weight("t") / weight("o")).alias("r"))

    def folded(df):
        if slots >= SLOTS:
            return df.select(F.col("gram").alias("slot"), F.col("r").alias("ratio"))
        return (df.groupBy(F.pmod("gram", F.lit(slots)).alias("slot"))
                .agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("ratio")))

    return folded(seen), folded(contexts)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Newton steps of a ridge logistic curve; the last weight is the intercept."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    pen = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen + 1e-9 * np.eye(len(w)),
                             z.T @ (y - p) - pen @ w)
    return np.concatenate([w[:-1] / sd, [w[-1] - (w[:-1] * mean / sd).sum()]])


def train(docs: DataFrame, labels: DataFrame, curve_rows: int = 6_000) -> Model:
    """The curve is fitted on at most ``curve_rows`` labelled documents of fold 4, and every other
    labelled document of folds 1 to 4 is counted. Fold 0 is never looked at. Of a repeated id the curve
    takes the least text."""
    marked = clean_labels(labels)
    chosen = sample_ids(marked.where(fold(F.col("_id")) == 4), "_id", curve_rows)
    chosen = cut(chosen, "toxicity-curve")
    used = (marked.where(fold(F.col("_id")).isin(1, 2, 3, 4)).join(F.broadcast(chosen), "_id", "left_anti")
            .withColumn("_id", F.col("_id").cast(docs.schema["doc_id"].dataType)))
    wanted = build(used, "_id")  # unlabelled texts are not shuffled
    texts = docs.select("doc_id", "text")
    texts = matching(texts, "doc_id", wanted) if wanted else texts.limit(0)
    counted = texts.join(used.hint("merge"), F.col("doc_id") == F.col("_id"))
    grams = cut(gram_counts(counted), "toxicity-grams")
    seen, contexts = log_ratios(grams)
    model = Model(pieces(seen, "seen"), pieces(contexts, "contexts"), np.zeros(3 + len(WINDOWS)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.select("_id", "text", "_y").transform(one_per_id, "_id")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["_y"], "x": list(model.shapes(pdf["text"].tolist()))})

    got = rows.select("text", "_y").mapInPandas(run, "y int, x array<double>").toArrow()
    y = np.asarray(got["y"].to_numpy(), float)
    x = np.array(got["x"].to_pylist(), float).reshape(len(y), 2 + len(WINDOWS))
    if len(y) and 0 < y.sum() < len(y):
        order = np.lexsort(np.column_stack([x, y]).T[::-1])
        model.weights = _logistic(x[order], y[order])
    else:
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        model.weights[-1] = np.log(rate / (1 - rate))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score and predicted appended (columns of those names are replaced). A null,
    empty or letterless text has no evidence and scores by the curve at zero."""
    kept = docs.drop("score", "predicted")
    schema = extended(kept, score="double")
    at = kept.columns.index("text")

    def run(batches):
        import pyarrow as pa
        for batch in slices(batches):
            values = model.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())],
                                             names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, schema).withColumn(
        "predicted", (F.col("score") >= F.lit(threshold)).cast("int"))
