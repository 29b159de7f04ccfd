"""Quality, language and toxicity models: held-out accuracy on given tables, edge cases, bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import empty_documents, odd_documents, odd_texts
from walkloom.llm import langid, quality, toxicity
from walkloom.llm.common import fold, one_per_id, sample_ids, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


@pytest.fixture(scope="module")
def models(docs, labels):
    return quality.train(docs, labels), langid.train(docs), toxicity.train(docs, labels)


def held_out(df):
    return df.where(fold(F.col("doc_id")) == 0)


def test_quality_on_held_out_rows(docs, labels, models):
    out = held_out(quality.score(docs, models[0])).join(labels, "doc_id").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.95


def test_language_on_held_out_rows(docs, models):
    out = held_out(langid.identify(docs, models[1])).toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97


def test_toxic_words_are_caught_and_clean_rows_left(docs, labels, models):
    out = held_out(toxicity.score(docs, models[2])).join(labels, "doc_id", "left").toPandas()
    words = out["text"].str.lower().str.contains("trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron")
    assert out[words]["predicted"].mean() > 0.85
    assert out[~words]["predicted"].mean() < 0.06


def test_odd_rows_get_defined_results(spark, models):
    df, clash = odd_documents(spark)
    n = df.count()
    q, t = quality.score(df, models[0]), toxicity.score(df, models[2])
    for out in (q, t):
        rows = out.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert all(r.labels == "mine-labels" and r["_row"] == "mine-_row" for r in rows)
    l = langid.identify(df, models[1]).collect()
    assert len(l) == n
    for r in l:
        letters = bool(r.text) and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert letters or (r.rejected and r.score == 0)


def test_nothing_to_learn_from(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = docs.limit(3)
    assert quality.score(few, quality.train(docs, none)).count() == 3
    assert toxicity.score(few, toxicity.train(docs, none)).where("predicted = 1").count() == 0
    assert langid.identify(few, langid.train(empty_documents(spark))).where("lang_pred <> 'und'").count() == 0
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(few, quality.train(docs, nulls)).count() == 3
    assert toxicity.score(few, toxicity.train(docs, nulls)).count() == 3


def test_empty_tables(spark, models):
    empty = empty_documents(spark)
    assert quality.score(empty, models[0]).collect() == []
    assert toxicity.score(empty, models[2]).collect() == []
    assert langid.identify(empty, models[1]).collect() == []


def test_training_never_sees_the_held_out_fold(spark, docs, labels):
    flipped = labels.withColumns({c: F.when(fold(F.col("doc_id")) == 0, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert all((x == y).all() for x, y in zip(a.terms, b.terms))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert np.allclose(a.weights, b.weights) and np.allclose(a.seen, b.seen, equal_nan=True)


def test_a_repeated_id_is_one_row_of_a_sample(spark, docs, labels):
    learnable = labels.where((fold(F.col("doc_id")) == 1) & F.col("quality").isNotNull()).select("doc_id").limit(40)
    some = docs.join(learnable, "doc_id").select("doc_id", "text", "lang")
    many = some.crossJoin(spark.range(50).select(F.col("id").alias("_n"))).withColumn(
        "text", F.when(F.col("_n") == 0, F.col("text")).otherwise(F.concat("text", F.lit(" more ~"), F.col("_n").cast("string")))).drop("_n")
    assert many.count() == 50 * some.count() and one_per_id(many, "doc_id").count() == some.count()
    assert quality.training_rows(many, labels.join(learnable, "doc_id"), "quality", 100).count() == some.count()
    # the least text of an id is its own beginning, so the models are those of single rows
    a, b = langid.train(some), langid.train(many.repartition(5))
    shown = lambda m: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(some, m).collect())
    assert shown(a) == shown(b)
    named = some.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert langid.identify(named, langid.train(named)).count() == some.count()


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y, n_pairs=2)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    assert (model.pairs[0][0], model.pairs[0][1]) == (0, 1)


def test_features_of_odd_texts_are_finite():
    for t in odd_texts():
        assert np.isfinite(quality.features(t)).all()


def kneser_ney(rows, slots):
    """Brute force over dictionaries: log ratio of every seen 5-gram and 4-byte context."""
    counts = {}
    for text, y in rows:
        for g in set(toxicity.codes(toxicity.plain(text), 5).tolist()):
            counts.setdefault(g, [0, 0])[0 if y else 1] += 1
    levels = {4: {}}
    for g in counts:
        levels[4][g & 0xFFFFFFFF] = levels[4].get(g & 0xFFFFFFFF, 0) + 1
    for n in (3, 2, 1):
        levels[n] = {}
        for g in levels[n + 1]:
            k = g & ((1 << 8 * n) - 1)
            levels[n][k] = levels[n].get(k, 0) + 1
    d = toxicity.DISCOUNT
    total, kinds = sum(levels[1].values()), len(levels[1])
    shared = {g: (c - d + d * kinds / 256) / total for g, c in levels[1].items()}
    for n in (2, 3, 4):
        new = {}
        for g, c in levels[n].items():
            here = [v for k, v in levels[n].items() if k >> 8 == g >> 8]
            new[g] = (max(c - d, 0) + d * len(here) * shared[g & ((1 << 8 * (n - 1)) - 1)]) / sum(here)
        shared = new
    give = lambda c: 0.0 if c == 0 else toxicity.CLASS_DISCOUNTS[min(c, 3) - 1]
    contexts = {}
    for g, (t, o) in counts.items():
        v = contexts.setdefault(g >> 8, [0, 0, 0.0, 0.0])
        v[0] += t
        v[1] += o
        v[2] += give(t)
        v[3] += give(o)
    weight = lambda v, i: v[2 + i] / v[i] if v[i] else 1.0
    seen = {}
    for g, c in counts.items():
        v = contexts[g >> 8]
        p = [(max(c[i] - give(c[i]), 0) / v[i] if v[i] else 0.0) + weight(v, i) * shared[g & 0xFFFFFFFF] for i in (0, 1)]
        seen[g] = np.log(p[0] / p[1])
    return seen, {h: np.log(weight(v, 0) / weight(v, 1)) for h, v in contexts.items()}


def test_log_ratios_equal_brute_force(spark):
    rows = [("you idiot fool", 1), ("a fine day, a fine text", 0), ("an idiot wrote a text", 1), ("text of a day", 0)]
    grams = toxicity.gram_counts(spark.createDataFrame(rows, "text string, _y int"))
    seen, contexts = (df.toPandas().set_index("slot")["ratio"].to_dict() for df in toxicity.log_ratios(grams, toxicity.SLOTS))
    for got, want in zip((seen, contexts), kneser_ney(rows, toxicity.SLOTS)):
        slots = {}
        for g, r in want.items():
            slots.setdefault(g % toxicity.SLOTS, []).append(r)
        single = {s: r[0] for s, r in slots.items() if len(r) == 1}
        assert set(got) == set(slots) and all(abs(got[s] - r) < 1e-9 for s, r in single.items())


def test_every_gram_keeps_its_own_ratio(spark):
    # two letter 5-grams that 1,048,573 buckets could not tell apart
    letters = [int.from_bytes(bytes([a, b, c, d, e])) for a in b"aeos" for b in b"bdfglmn" for c in range(97, 123)
               for d in range(97, 123) for e in range(97, 123)]
    at = {}
    one, two = next((at[g % 1_048_573], g) for g in letters if at.setdefault(g % 1_048_573, g) != g)
    toxic, plain = (g.to_bytes(5).decode() for g in (one, two))
    rows = [(f"he is {toxic} and {toxic}y", 1)] + [(f"the {plain} of day {'abcdefgh'[i]}", 0) for i in range(8)]
    seen, contexts = kneser_ney(rows, None)
    tables = toxicity.log_ratios(toxicity.gram_counts(spark.createDataFrame(rows, "text string, _y int")))
    parts = [toxicity.pieces(df, "test", size=9) for df in tables]
    model = toxicity.Model(*parts, np.zeros(5))
    assert len(parts[0]) > 2 and len(model.seen) == len(seen) and seen[one] > 0 > seen[two]
    texts = [t for t, _ in rows] + [None, "", f"she is {plain} and unseen {toxic}zz words"]
    for text, got in zip(texts, model.ratios(texts), strict=True):
        grams = toxicity.codes(toxicity.plain(text), 5).tolist()
        assert np.allclose(got, [seen.get(g, contexts.get(g >> 8, 0.0)) for g in grams], atol=1e-5)


def test_fold_four_beyond_the_curve_is_counted(spark):
    rows = [(i, f"text {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}vwxz") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    folds = dict(docs.select("doc_id", fold(F.col("doc_id"))).collect())
    of = lambda ids: {g for i, t in rows if i in ids for g in toxicity.codes(toxicity.plain(t), 5).tolist()}
    for taken in (3, 1000):
        model = toxicity.train(docs, labels, curve_rows=taken)
        curve = {r[0] for r in sample_ids(docs.where(fold(F.col("doc_id")) == 4), "doc_id", taken).collect()}
        want = of({i for i, f in folds.items() if f in (1, 2, 3, 4) and i not in curve})
        assert set(np.concatenate([toxicity.opened(p)[0] for p in model.grams]).tolist()) == want


def test_rejection_threshold():
    top, right = np.array([0.9, 0.8, 0.7, 0.6]), np.array([True, True, False, True])
    assert langid.reject_below(top, right, 0.0) == 0.8
    assert langid.reject_below(top, right, 0.5) == 0.6
    assert langid.reject_below(top, ~right, 0.0) == 1.0
