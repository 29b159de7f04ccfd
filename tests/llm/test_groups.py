"""Near duplicates and mixing against brute force, with hot groups, ties and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, empty_documents, odd_documents, words
from walkloom.llm import idfilter, minhash, mixing
from walkloom.llm.graph import components


def shingle_set(text):
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return set()
    return {tuple(tokens[i:i + 5]) for i in range(len(tokens) - 4)} or {tuple(tokens)}


def brute(rows):
    """{doc_id: (n, component)} by comparing everything with everything."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t))
    flat = [(i, s) for i, ss in sets.items() for s in ss]
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, s) in enumerate(flat):
        for j, t in flat[x + 1:]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}


def edited(rng, base, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in base]


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, passage = [], words(rng, 40)
    for g in range(12):
        base = words(rng, rng.choice([3, 8, 30, 120, 400]))
        rows += [" ".join(base)] * rng.choice([1, 2, 9])
        rows += [" ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.06]))) for _ in range(rng.choice([0, 3, 12]))]
    hot = words(rng, 150)
    rows += [" ".join(edited(rng, hot, 0.03)) for _ in range(80)]
    rows += [" ".join(words(rng, 60) + passage + words(rng, 60)) for _ in range(40)]
    # a chain: every link just similar enough, its ends not
    chain = [f"c{i}" for i in range(100)]
    rows += [" ".join(chain[k:k + 60]) for k in range(0, 40, 6)]
    rng.shuffle(rows)
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(rows)]
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    want = brute([d[:2] for d in docs])
    assert len(got) == len(docs)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(shingle_set(rows[i])) and r.kept == (i == want[i]) for i, r in got.items())


def test_a_common_passage_posts_nothing(spark, rng):
    """Documents that share a fifth of their text meet in lists, and prefix and skip merging drops them."""
    passage = words(rng, 30)
    rows = [(i, minhash.signature(minhash.shingles(" ".join(words(rng, 130, 10**6) + passage))).tolist()) for i in range(300)]
    reps = spark.createDataFrame(rows, "rep long, sig array<int>")
    assert minhash.posted(reps).count() < 300


def test_odd_rows(spark):
    df, clash = odd_documents(spark)
    rows = minhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i in (0, 1, 2):  # null, empty, blank
        assert (by[i].n_shingles, by[i].component_id, by[i].kept) == (0, i, True)
    assert by[6].n_shingles == 1 and by[6].component_id == 6
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    out = minhash.deduplicate(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.where("size <> 'mine-size'").count() == 0


def test_empty_tables(spark):
    empty = empty_documents(spark)
    assert minhash.near_duplicates(empty).collect() == []
    assert minhash.deduplicate(empty).collect() == []
    assert mixing.mix(empty).collect() == []
    assert mixing.emit(empty).collect() == []


def test_deduplicate_keeps_the_smallest_id(spark, rng):
    base = words(rng, 80)
    rows = [(7, " ".join(base)), (3, " ".join(base)), (9, " ".join([*base[:-1], "end"])), (5, "other text here"), (None, "x")]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    assert sorted((r.doc_id or -1) for r in minhash.deduplicate(df).collect()) == [-1, 3, 5]


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 200)]
    random.Random(1).shuffle(edges)
    got = {r.rep: r.comp for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_id_filter_loses_nothing_when_full(spark):
    ids = spark.range(0, 4000, 2)
    small = idfilter.build(ids, "id", max_bits=1 << 12)
    df = spark.range(4000)
    through = idfilter.matching(df, "id", small)
    assert ids.join(through, "id", "left_anti").count() == 0
    assert through.count() + idfilter.matching(df, "id", small, keep=False).count() == 4000
    assert idfilter.build(ids.limit(0), "id") is None


def water(sizes, weights, cap=3):
    """Targets by repeated sharing among those that are not yet full."""
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and left * weights[s] > cap * sizes[s] * w}
        if not over:
            return {s: cap * sizes[s] if s in full else (left * weights[s] / w if w else 0) for s in sizes}
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 40, 1000, 20000]) for i in range(rng.choice([1, 4, 17]))} | {None: 7}
    order = sorted(k for k in sizes if k is not None) + [None]
    weights = {s: [1, 2, 3][i % 3] for i, s in enumerate(order)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r for r in mixing.targets(mixing.cyclic_weights(df)).collect()}
    want = water(sizes, weights)
    assert {s: r.weight for s, r in got.items()} == weights
    assert all(abs(got[s].target - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_mix_comes_near_its_targets_and_repeats(spark, rng):
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), None, rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for knobs in ({}, {"broadcast_rows": 0, "salts": 4}):
        mixed = mixing.mix(df, **knobs)
        assert mixed.count() == 6000
        for r in mixed.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"), F.max(F.col("taken") / F.col("size")).alias("x")).collect():
            assert abs(r.n - r.t) < 0.05 * r.t and r.x <= 3
    again = mixing.mix(df.repartition(7)).select("doc_id", "taken")
    assert mixing.mix(df).select("doc_id", "taken").exceptAll(again).count() == 0


@pytest.mark.parametrize("sf,near", [("sf0.01", 0.05), ("sf0.1", 0.02)])
def test_given_sources_come_near_their_targets(spark, sf, near):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", "source")
    sums = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"), F.max("source_size").alias("s")).collect()
    assert sum(r.s >= 10_000 for r in sums) > 5
    assert [r for r in sums if r.s >= 10_000 and abs(r.n - r.t) > near * r.t] == []


def test_one_long_document_does_not_decide(spark):
    """Half of a source is one document: it is taken or the others are, in half of the sources each."""
    rows = [(1000 * s + i, " ".join(["w"] * (3000 if i == 0 else 30)), None, f"s{s:02}", 0) for s in range(24) for i in range(101)]
    df = spark.createDataFrame(rows, SCHEMA)
    weights = spark.createDataFrame([(f"s{s:02}", 1 + s % 2 * 2) for s in range(24)], "source string, weight long")
    got = mixing.mix(df, weights)
    for r in got.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect():
        assert abs(r.n - r.t) <= 30
    long = [r.copies for r in got.where("size = 3000").collect()]
    assert len(set(long)) > 1 and abs(sum(long) - 24) <= 6


def test_mix_of_odd_rows(spark):
    df, clash = odd_documents(spark)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count() and all(r.taken == r.size * r.copies and r["_source"] == "mine-_source" for r in rows)
    assert all(r.size == len((r.text or "").encode().split()) for r in rows)
    out = mixing.emit(df)
    assert out.columns == [*df.columns, "copy_"] and out.where("size <> 'mine-size' OR copy <> 'mine-copy'").count() == 0
    assert out.count() == sum(r.copies for r in rows)


def test_given_weights(spark):
    df = spark.createDataFrame([(i, "w w w w", None, "ab"[i % 2], 0) for i in range(400)], SCHEMA)
    weights = spark.createDataFrame([("a", 3), ("b", 1)], "source string, weight long")
    got = {r.source: r.target for r in mixing.mix(df, weights).select("source", "target").distinct().collect()}
    assert got == {"a": 1200.0, "b": 400.0}


def test_sources_without_a_weight_stay(spark):
    docs = spark.createDataFrame([(i, "one two three", None, s, 1) for i, s in enumerate(["a", "a", "b", "c", None, "d"])], SCHEMA)
    weights = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 0), ("unused", 2)], "source string, weight long")
    for knobs in ({}, {"broadcast_rows": 0}):
        rows = mixing.mix(docs, weights, **knobs).collect()
        assert sorted(r.doc_id for r in rows) == list(range(6))
        for r in rows:
            if r.source in ("a", "b"):
                assert r.target > 0
            else:
                assert (r.target, r.copies, r.taken, r.size, r.source_size) == (0.0, 0, 0, 3, 3)
    for bad in ([("a", 1), ("a", 2)], [("a", -1)], [(None, 1), (None, 1)]):
        with pytest.raises(ValueError, match="weights"):
            mixing.mix(docs, spark.createDataFrame(bad, weights.schema))
