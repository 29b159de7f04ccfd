"""Absent inputs, flat stretches, broken files, failing writers, repeated dates."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import make_series, weekdays
from walkloom import session
from walkloom.functions.frames import by_series
from walkloom.operators import experiments as E
from walkloom.operators import features as feat
from walkloom.operators import joins as J
from walkloom.sources import readers, sinks


def official(spark, prices, name="a"):
    rows = [(name, d, float(p), float(70 + i % 7)) for i, (d, p) in enumerate(zip(weekdays(len(prices)), prices))]
    return spark.createDataFrame(rows, "series_id string, date date, price double, cross_price double")


def rsi(prices):
    r = np.diff(np.log(prices))
    gain = pd.Series(np.maximum(r, 0)).ewm(alpha=1 / 14, adjust=True).mean()
    loss = pd.Series(np.maximum(-r, 0)).ewm(alpha=1 / 14, adjust=True).mean()
    return np.concatenate([[np.nan], (100 - 100 / (1 + gain / loss)).where(np.arange(len(r)) >= 13)])


def test_rsi_survives_flat_stretches(spark):
    rng = np.random.default_rng(3)
    prices = np.concatenate([np.exp(np.cumsum(rng.normal(0, 0.01, 700))), np.zeros(1300)])
    prices[700:] = prices[699]
    prices = np.concatenate([prices, prices[-1] * np.exp(np.cumsum(rng.normal(0, 0.01, 200)))])
    got = feat.build(J.aligned(official(spark, prices)), keep=["rsi14", "skew20"]).orderBy("date").toPandas()
    # within the flat stretch both means shrink alike, so the ratio of the last move stays
    want = rsi(prices)
    assert np.nanmax(np.abs(got["rsi14"].to_numpy(float)[20:] - want[20:])) < 1e-6
    assert got["rsi14"][14:].notna().all()


def test_skew_of_a_window_without_variation_is_zero(spark):
    prices = np.concatenate([np.linspace(1, 2, 30), np.full(40, 2.0)])
    got = feat.build(J.aligned(official(spark, prices)), keep=["skew20", "vol20"]).orderBy("date").toPandas()
    assert (got["skew20"][52:] == 0).all()
    want = pd.Series(np.diff(np.log(prices))).rolling(20).skew()
    assert np.allclose(got["skew20"][21:45].astype(float), want[20:44], atol=1e-6)


@pytest.mark.parametrize("missing", ["market", "oil", "sentiment", "key_rate"])
def test_an_absent_table_follows_the_rule(spark, missing):
    pdf = make_series(420, 3, "a", gaps=False)
    day = pdf["date"].tolist()
    mk = lambda cols, schema: spark.createDataFrame(list(zip(*cols)), schema)
    tables = {
        "market": mk([["a"] * 420, day, pdf.close.tolist(), pdf.high.tolist(), pdf.low.tolist()],
                     "series_id string, date date, close double, high double, low double"),
        "oil": mk([day, pdf.oil.tolist()], "date date, value double"),
        "sentiment": mk([day, pdf.sentiment_raw.tolist()], "date date, sentiment double"),
        "key_rate": mk([day[:1], [5.0]], "date date, value double")}
    tables[missing] = None
    df = J.aligned(official(spark, pdf.price), **tables)
    got = feat.build(df).orderBy("date").toPandas()
    last = got.iloc[-1]
    if missing == "key_rate":
        assert (got[feat.RATE] == 0.0).all().all()
    else:
        assert last["key_rate"] == 5.0
    assert pd.isna(last["oil_ret20"]) == (missing == "oil")
    if missing == "sentiment":
        assert (got["sentiment"] == 0.0).all()


def test_an_empty_rate_table_counts_as_absent(spark):
    empty = spark.createDataFrame([], "date date, value double")
    df = J.aligned(official(spark, np.linspace(1, 2, 80)), key_rate=empty)
    assert feat.build(df, keep=["rate_change"]).where("key_rate <> 0.0 OR key_rate IS NULL").count() == 0


def test_a_rate_before_its_first_decision_is_unknown(spark):
    days = weekdays(80)
    rate = spark.createDataFrame([(days[40], 7.0), (days[40], 6.0)], "date date, value double")
    got = feat.build(J.aligned(official(spark, np.linspace(1, 2, 80)), key_rate=rate), keep=[]).orderBy("date").toPandas()
    assert got["key_rate"][:40].isna().all() and (got["key_rate"][40:] == 7.0).all() and len(got) == 80


@pytest.mark.parametrize("seed", range(3))
def test_asof_macro_never_looks_ahead(spark, seed):
    rng = random.Random(seed)
    days = weekdays(600)
    macro = [(rng.choice(days), float(rng.randint(1, 99))) for _ in range(40)]
    macro += [(macro[0][0], 1.5), macro[1]]  # a repeated date, a repeated row
    m = pd.DataFrame(macro, columns=["date", "value"]).groupby("date")["value"].max().sort_index()
    want = [float(m[m.index <= d].iloc[-1]) if (m.index <= d).any() else None for d in days]
    panel = spark.createDataFrame([(d,) for d in days], "date date")
    got = J.asof_macro(panel, spark.createDataFrame(macro, "date date, value double"), "value", "v").orderBy("date").collect()
    assert [r["v"] for r in got] == want


def test_partition_count_follows_the_setting(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        df = by_series(spark.createDataFrame([("a", 1)], "series_id string, x int"))
        assert "400" in df._jdf.queryExecution().logical().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_publish_keeps_the_old_version_when_a_writer_fails(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.publish(spark.range(5), path)
    bad = spark.range(1000).select(F.when(F.col("id") == 900, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        sinks.publish(bad, path)
    assert sinks.published(spark, path).count() == 5
    assert not sinks.publish(spark.range(5).where("id > 9"), path)
    assert sinks.published(spark, path).count() == 5
    assert sinks.publish(spark.range(7), path)
    assert sinks.published(spark, path).count() == 7
    assert sinks.publish(spark.range(0), path, keep_previous_if_empty=False)
    assert sinks.published(spark, path, schema="id long").count() == 0


def test_pretty_printed_candles_and_quarantine(spark, tmp_path):
    page = {"candles": {"columns": ["begin", "high", "close", "low"],
                        "data": [["2020-01-02 00:00:00", "3", "2", "1"], ["2020-01-03 00:00:00", "6", "5", "4"]]}}
    (tmp_path / "pretty.json").write_text(json.dumps(page, indent=2))
    (tmp_path / "lines.json").write_text(json.dumps(page | {"series_id": "x"}) + "\n{broken\n\n" + json.dumps(page | {"series_id": "y"}))
    (tmp_path / "bad.json").write_text("{\n not json")
    (tmp_path / "empty.json").write_text("")
    got = readers.json_candles(spark, str(tmp_path), series=F.lit("z")).orderBy("series_id", "date").collect()
    assert [(r.series_id, r.date.day, r.close, r.high, r.low) for r in got] == [
        (s, d, c, c + 1, c - 1) for s in "xyz" for d, c in ((2, 2.0), (3, 5.0))]
    docs = readers.documents(spark, str(tmp_path), readers.CANDLE_SCHEMA)
    assert sorted(r.broken for r in docs.where("broken IS NOT NULL").collect()) == ["{\n not json", "{broken"]
    with pytest.raises(Exception, match="unreadable document"):
        readers.strict_documents(docs).collect()


def test_a_broken_first_line_loses_only_itself(spark, tmp_path):
    good = [json.dumps({"timestamp": [86400 * i], "close": [float(i)]}) for i in range(1, 5)]
    (tmp_path / "cut.json").write_text("\n".join(['{"timestamp": [1, 2', *good[:2]]))
    (tmp_path / "type.json").write_text("\r\n".join(['{"timestamp": "x", "close": [7.0]}', *good[2:], "{}"]))
    (tmp_path / "pretty.json").write_text('{\n"extra":\n{"a": [1]},\n"timestamp": [432000],\n"close":\n[5.0]\n}\n')
    got = readers.json_parallel_arrays(spark, str(tmp_path)).collect()
    assert sorted((r.date.day, r.value) for r in got) == [(i + 1, float(i)) for i in range(1, 6)]
    docs = readers.documents(spark, str(tmp_path), readers.ARRAYS_SCHEMA)
    assert sorted(r.broken for r in docs.where("broken IS NOT NULL").collect()) == ['{"timestamp": "x", "close": [7.0]}', '{"timestamp": [1, 2']
    assert docs.where("doc IS NOT NULL").count() == 6


def test_documents_are_read_in_splits(spark, tmp_path):
    (tmp_path / "many.json").write_text("\n".join(json.dumps({"timestamp": [86400 * i], "close": [1.0]}) for i in range(3000)))
    (tmp_path / "pretty.json").write_text(json.dumps({"timestamp": [86400 * i for i in range(3000)], "close": [1.0] * 3000}, indent=1))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        docs = readers.documents(spark, str(tmp_path), readers.ARRAYS_SCHEMA)
        assert docs.where("broken IS NOT NULL").count() == 0 and docs.count() == 3001
        split = docs.where(F.col("file").contains("many")).select(F.spark_partition_id().alias("p")).distinct().count()
        assert split > 3 and readers.json_parallel_arrays(spark, str(tmp_path)).count() == 6000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_documents_are_read_and_parsed_once(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"timestamp": [86400], "close": [1.0]}\n{}\nnot json\n')
    docs = readers.documents(spark, str(tmp_path), readers.ARRAYS_SCHEMA)
    assert docs.inputFiles() and not any(f.endswith("a.json") for f in docs.inputFiles())
    rows = docs.collect()
    assert [r.broken for r in rows if r.doc is None] == ["not json"]
    assert sorted(r.doc.timestamp or [] for r in rows if r.doc is not None) == [[], [86400]]


def test_pretty_printed_arrays_and_quotes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "q").mkdir()
    (tmp_path / "a/x.json").write_text(json.dumps({"timestamp": [86400, 172800], "close": [1.5, None]}, indent=1))
    (tmp_path / "q/x.json").write_text(json.dumps({"series_id": "s", "rates": {"RUB": 9.5}, "time_last_update_utc": "Fri, 01 Jan 2021 00:00:01 +0000"}, indent=1))
    assert [(str(r.date), r.value) for r in readers.json_parallel_arrays(spark, str(tmp_path / "a")).collect()] == [("1970-01-02", 1.5)]
    assert [(str(r.date), r.price) for r in readers.json_spot(spark, str(tmp_path / "q")).collect()] == [("2021-01-01", 9.5)]


def test_a_machine_local_folder_is_only_for_one_machine(monkeypatch):
    class Fake:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "local-cluster[3,2,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake)


SNAPSHOT = "series_id string, date date, price double"


@pytest.mark.parametrize("seed", range(3))
def test_changes_by_digest_equal_the_full_comparison(spark, seed):
    rng = random.Random(seed)
    days = weekdays(150)
    old = [(s, d, rng.choice([None, 0.0, 1.5, round(rng.uniform(1, 9), 4)])) for s in "ab" for d in days]
    new = [(s, d, rng.choice([p, p, p, p, 2.5, None]) if d.month % 2 else p) for s, d, p in old if rng.random() > 0.01]
    new += [("c", days[3], 7.0)]
    a, b = spark.createDataFrame(old, SNAPSHOT), spark.createDataFrame(new, SNAPSHOT)
    rows = lambda df: sorted(map(repr, df.select("series_id", "date", "old_price", "new_price", "ratio").collect()))
    whole = J.snapshot_compare(a, b).where("changed")
    assert whole.count() > 10 and rows(J.snapshot_changes(a, b)) == rows(whole)
    assert J.snapshot_changes(a, a).isEmpty()
    counted = {(r.series_id, r.ratio): r.changed_rows for r in E.changed_ratios(J.snapshot_changes(a, b)).collect()}
    summary = {r.series_id: r for r in E.audit_summary(a, b).collect()}
    for s in "abc":
        ratios = [k for t, k in counted if t == s and k is not None]
        got = summary[s]
        assert (got.n_ratios, got.ratio_min, got.ratio_max) == (len(ratios), min(ratios, default=None), max(ratios, default=None))
        assert got.changed_rows == sum(n for (t, _), n in counted.items() if t == s)
        assert got.rows_old == sum(1 for t, _, p in old if t == s and p is not None)


def test_a_one_row_revision_reads_one_range(spark):
    days = weekdays(400)
    old = [(s, d, 1.0 + i) for s in "ab" for i, d in enumerate(days)]
    new = [(s, d, p + (0.5 if (s, d) == ("b", days[200]) else 0.0)) for s, d, p in old]
    a, b = spark.createDataFrame(old, SNAPSHOT), spark.createDataFrame(random.Random(1).sample(new, len(new)), SNAPSHOT)
    assert [tuple(r) for r in J.differing_ranges(a, b).collect()] == [("b", days[200].replace(day=1))]
    assert [(r.series_id, r.date, r.new_price) for r in J.snapshot_changes(a, b).collect()] == [("b", days[200], 201.5)]
    assert J.differing_ranges(a, a.where("false")).count() == a.selectExpr("series_id", "trunc(date, 'month')").distinct().count()
    # repeated rows count: digests of pairs do not cancel out
    pair = lambda p: spark.createDataFrame([("a", days[0], p)] * 2, SNAPSHOT)
    assert J.differing_ranges(pair(1.0), pair(2.0)).count() == 1


def test_equal_rows_of_an_upsert_have_one_winner(spark):
    stored = spark.createDataFrame([("k", 9, 9)], "key string, a int, b int")
    batch = [("k", 1, 5), ("k", 3, 2), ("k", 3, None), ("k", 2, 8)]
    for seed in range(3):
        rows = random.Random(seed).sample(batch, 4)
        df = spark.createDataFrame(rows, "key string, a int, b int").repartition(3)
        assert [tuple(r) for r in sinks.upsert_last_wins(stored, df, ["key"]).collect()] == [("k", 3, 2)]
