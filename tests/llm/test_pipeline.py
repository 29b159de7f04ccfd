"""The pipeline's stages against brute force on a small table, and their contract."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import empty_documents, odd_documents
from tests.llm.test_groups import brute, water
from tests.llm.test_text_search import check
from walkloom.llm import mixing, quality, toxicity
from walkloom.llm.common import cut, table

SF = "/root/testdata/sf0.001"


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "mixing"]


def test_run_equals_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = docs.collect()
    model = quality.train(docs, labels)
    kept = [r for r in rows if model.score(quality.features(r.text)[None, :])[0] >= 0.3]
    left = cut(docs.join(spark.createDataFrame([(r.doc_id,) for r in kept], "doc_id long"), "doc_id", "left_semi"), "t")
    tox = toxicity.train(left, labels)
    kept = [r for r, s in zip(kept, tox.score([r.text for r in kept])) if s < 0.5]
    comp = brute([(r.doc_id, r.text) for r in kept])
    kept = [r for r in kept if comp[r.doc_id] == r.doc_id]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    kept = [r for r, c in zip(kept, check([(r.doc_id, r.text) for r in kept], items)) if not c[-1]]
    sizes = {}
    for r in kept:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    weights = {s: [1, 2, 3][i % 3] for i, s in enumerate(sorted(sizes))}
    targets = water(sizes, weights)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in kept}
    want = set()
    for r in mixing.mix(spark.createDataFrame(kept, docs.schema)).collect():
        assert abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target)
        want |= {(r.doc_id, n) for n in range(1, r.copies + 1)}
    assert {(r.doc_id, r.copy) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_every_stage_takes_odd_and_empty_tables(spark, name, stage):
    df, clash = odd_documents(spark)
    out = stage(spark, df, SF)
    last = name == "mixing"
    assert out.columns == df.columns + ["copy_"] * last
    assert out.where(F.col("size") != "mine-size").count() == 0
    assert last or out.count() <= df.count()
    assert stage(spark, empty_documents(spark), SF).collect() == []
