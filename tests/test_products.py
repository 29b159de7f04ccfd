"""Ledger, projection, calendar, health, sources, sinks and streams on small fixtures."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import day
from walkloom import params as P
from walkloom.operators import backtest as B
from walkloom.operators import calibration as C
from walkloom.operators import experiments as E
from walkloom.operators import health as H
from walkloom.operators import ledger as L
from walkloom.operators import predict as PR
from walkloom.operators import projection as PJ
from walkloom.operators import signals as S
from walkloom.sources import readers, sinks
from walkloom.streaming import live

DIRS = "series_id string, horizon int, prediction int, confidence double, neutral boolean"


def project(spark, dirs, vol=0.01):
    d = spark.createDataFrame([("s", *x) for x in dirs], DIRS)
    b = spark.createDataFrame([("s", day("2025-06-02"), 12.5, vol)],
                              "series_id string, base_date date, base_rate double, daily_vol double")
    return PJ.project(d, b).toPandas().sort_values(["horizon", "k"])


def test_calendar_skips_weekends_and_new_year(spark):
    base = spark.createDataFrame([(day("2025-12-30"),)], "base_date date")
    got = [r.date for r in PJ.future_dates(base, 5).orderBy("k").collect()]
    assert got == [day("2025-12-31"), day("2026-01-09"), day("2026-01-12"), day("2026-01-13"), day("2026-01-14")]
    assert PJ.future_dates(base, 90).count() == 90


def test_path_follows_shorter_horizons_first(spark):
    out = project(spark, [(7, 0, 0.8, False), (30, 1, 0.8, False), (60, 1, 0.6, False), (90, None, None, True)])
    g = out[out.horizon == 30].set_index("k")["rate"]
    assert g[7] < 12.5 and g[30] > 12.5 and len(g) == 30
    end = 12.5 * pow(2.718281828459045, 0.0161 * 0.6 * (30 / 7) ** 0.5)
    assert g[30] == pytest.approx(end, abs=1e-4)
    long = out[out.horizon == 90]
    assert long.set_index("k")["rate"][90] == pytest.approx(12.5, abs=1e-4)
    assert (out["low"] <= out["rate"]).all() and (out["high"] >= out["rate"]).all()
    assert long["half_band"].is_monotonic_increasing


def test_neutral_is_flat_and_silence_is_empty(spark):
    out = project(spark, [(7, None, None, True), (30, 1, 0.52, False)])
    seven = out[out.horizon == 7]
    assert (seven["rate"] == 12.5).all() and len(seven) == 7
    assert (out[out.horizon == 30]["rate"] == 12.5).all()
    out = project(spark, [(7, None, None, False), (30, 1, 0.7, False)])
    assert set(out["horizon"]) == {30}
    wide = project(spark, [(7, 1, 0.7, False), (30, 1, 0.7, False)], vol=None)
    assert wide[wide.horizon == 30]["half_band"].iloc[-1] == pytest.approx(0.012 * (1 + 30 / 90))


@pytest.fixture(scope="module")
def signals(aligned):
    return S.long_signals(aligned)


def test_ledger_records_once_settles_real_prices_and_reviews(spark, aligned, signals, frames):
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = L.history_rows(B.long_decisions(signals), stamp)
    rows = rows.unionByName(L.shadow_rows(PR.last_rows(signals), stamp))
    empty = spark.createDataFrame([], rows.schema)
    once = L.record(empty, rows)
    assert L.record(once, rows).count() == once.count() == rows.count()
    settled = L.settle(once, aligned).toPandas()
    assert settled[settled.prediction.isna()]["realized"].isna().all()
    prices = {k: dict(zip(v["date"], range(len(v)))) for k, v in frames.items()}
    for r in settled[settled.realized.notna()].iloc[::97].itertuples():
        g, i = frames[r.series_id], prices[r.series_id][r.as_of]
        assert r.realized_date == g["date"][i + r.horizon]
        assert bool(r.realized) == (g["price"][i + r.horizon] > g["price"][i])
    shadow = settled[settled.is_shadow == 1]
    assert shadow["realized"].isna().all() and len(shadow) >= 2
    rev = L.review(L.settle(once, aligned)).toPandas()
    cell = rev[(rev.series_id == "a") & (rev.horizon == 60) & (rev.is_shadow == 0)].iloc[0]
    mine = settled[(settled.series_id == "a") & (settled.horizon == 60) & (settled.is_shadow == 0)
                   & settled.realized.notna()].sort_values("as_of")
    hits = (mine.prediction == mine.realized)
    assert cell.n_all == len(mine) and cell.hit_20 == pytest.approx(hits[-20:].mean(), abs=1e-4)
    assert cell.n_50 == 50 and cell.hit_all == pytest.approx(hits.mean(), abs=1e-4)


def test_meta_leaves_out_probabilities(spark):
    df = spark.createDataFrame([("s", day("2024-01-01"), 7, 1, 0.6, 0.4)],
                               "series_id string, as_of date, horizon int, prediction int, prob_up double, prob_down double")
    assert df.select(L.meta_document(df, ("series_id", "as_of")).alias("m")).first().m == '{"horizon":7,"prediction":1}'


def test_long_now_states_reasons_and_sources(spark, signals):
    dec = B.long_decisions(signals)
    rep, gates, buckets = B.long_report(dec), B.gate_tables(dec), B.bucket_tables(dec)
    now = PR.long_now(signals, rep, gates, buckets).toPandas()
    assert len(now) == 6 and not now["neutral"].all()
    stated = now[~now["neutral"]]
    assert ((stated.prob_up + stated.prob_down - 1).abs() < 2e-3).all()
    assert set(now[now.horizon == 60]["confidence_source"]) == {"modern_oos_hit"}
    none = PR.long_now(signals, rep.where("false"), gates, buckets).toPandas()
    assert set(none["neutral_reason"]) == {"calibration_unavailable"} and none["prediction"].isna().all()
    off = PR.long_now(signals, B.long_report(B.long_decisions(signals, {30: "off"})), gates, buckets,
                      {30: "off"}).toPandas()
    assert set(off["neutral_reason"]) == {"no_validated_signal"}


def test_calibration_freshness_falls_back(spark):
    table = spark.createDataFrame([("s", 7, "z15", 0.9)], "series_id string, horizon int, bucket string, rate double")
    at = lambda made: C.usable_rates(table.withColumn("generated_ts", F.lit(made).cast("timestamp")),
                                     F.lit("2024-01-03 00:00:00").cast("timestamp")).first()
    assert at("2024-01-01 00:00:00")["rate"] == 0.9
    assert at("2023-12-31 23:59:59")["rate"] == 0.79 and not at("2024-01-03 00:00:01")["is_usable"]


def test_health_overall(spark):
    state = spark.createDataFrame([("s", 7, "healthy"), ("s", 30, "degraded"), ("e", 7, "no_data")],
                                  "series_id string, horizon int, status string")
    got = {r.series_id: r.overall_status for r in H.overall(state).collect()}
    assert got == {"s": "degraded", "e": "healthy"}
    stale = spark.createDataFrame([(7, True), (30, False)], "horizon int, is_stale boolean")
    got = {r.series_id: r.overall_status for r in H.overall(state, stale).collect()}
    assert got == {"s": "alert", "e": "healthy"}


def test_auc_with_ties(spark):
    rows = [("g", y, p) for y, p in [(1, .9), (0, .9), (1, .4), (0, .2), (0, .4), (1, .7)]]
    got = E.class_metrics(spark.createDataFrame(rows, "k string, y int, prob double"), ["k"]).first()
    pairs = [(1 if a > b else .5 if a == b else 0) for ya, a in [(r[1], r[2]) for r in rows] if ya == 1
             for yb, b in [(r[1], r[2]) for r in rows] if yb == 0]
    assert got["auc"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-6)


XML = """<?xml version="1.0" encoding="windows-1251"?>
<ValCurs ID="R1"><Record Date="09.01.2025" Id="R1"><Nominal>1</Nominal><Value>13,9650</Value></Record>
<Record Date="10.01.2025" Id="R1"><Nominal>10</Nominal><Value>139,0000</Value></Record>
<Record Date="11.01.2025" Id="R1"><Nominal>0</Nominal><Value>13,8000</Value></Record></ValCurs>"""


def test_rate_xml_normalises_units_and_quarantines(spark, tmp_path):
    (tmp_path / "r.xml").write_bytes(XML.encode("windows-1251"))
    raw = readers.rate_records(spark, str(tmp_path), charset="windows-1251")
    good, bad = readers.split_rates(raw)
    assert {str(r.date): r.price for r in good.collect()} == {"2025-01-09": 13.965, "2025-01-10": 13.9}
    assert bad.count() == 1
    with pytest.raises(Exception, match="bad unit size"):
        readers.strict_rates(raw).collect()


def test_html_and_candles(spark, tmp_path):
    (tmp_path / "a.html").write_text("<tr><td>26.07.2024</td>\n <td class=x> 18,00</td></tr><td>99.99.2024</td><td>1</td>")
    assert [(str(r.date), r.value) for r in readers.html_table(spark, str(tmp_path / "a.html")).collect()] == [("2024-07-26", 18.0)]
    (tmp_path / "c.json").write_text('{"series_id":"s","candles":{"columns":["open","close","high","low","begin"],'
                                     '"data":[[1,2.5,3,null,"2024-01-02 00:00:00"],[1,null,3,1,"2024-01-03 00:00:00"]]}}')
    got = [tuple(r) for r in readers.json_candles(spark, str(tmp_path / "c.json")).collect()]
    assert got == [("s", day("2024-01-02"), 2.5, 3.0, None)]


def test_upsert_keeps_old_values_and_labels(spark):
    schema = "date string, price double, cross_price double, source string"
    old = spark.createDataFrame([("d1", 1.0, 5.0, "cbr"), ("d2", 2.0, None, "erapi")], schema)
    new = spark.createDataFrame([("d1", 1.5, None, "erapi"), ("d2", None, 7.0, "cbr"), ("d3", 3.0, None, "erapi")], schema)
    got = {r.date: tuple(r)[1:] for r in sinks.upsert_coalesce(old, new, ["date"]).collect()}
    assert got == {"d1": (1.5, 5.0, "cbr"), "d2": (2.0, 7.0, "cbr"), "d3": (3.0, None, "erapi")}
    assert sinks.new_rows(old, new, ["date"]).count() == 1


def test_publish_keeps_previous_on_empty(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.publish(spark.range(3), path) and not sinks.publish(spark.range(0), path)
    assert sinks.published(spark, path).count() == 3


def ticks(spark, rows):
    return spark.createDataFrame([(i, dt.datetime.fromisoformat(ts), k, v) for i, ts, k, v in rows],
                                 "event_id bigint, ts timestamp_ntz, event_type string, value double")


def test_last_bar_goes_back_to_an_earlier_day(spark):
    bars = live.minute_bars(ticks(spark, [(1, "2024-03-01 10:00:05", "a", 1.0), (2, "2024-03-01 10:00:50", "a", 2.0),
                                          (3, "2024-02-20 10:00:00", "b", 9.0)]))
    run = F.lit("2024-03-04 09:00:00").cast("timestamp_ntz")
    assert [tuple(r) for r in live.last_bar(bars, run).collect()] == [("a", dt.datetime(2024, 3, 1, 10), 2.0)]


def test_streamed_bars_equal_batch_and_dedup(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    batch = ticks(spark, [(i, f"2024-03-01 10:{i:02d}:{(7 * i) % 60:02d}", "ab"[i % 2], float(i)) for i in range(40)])
    batch.repartition(3).write.parquet(src)
    stream = live.file_stream(spark, src, batch.schema.simpleString()[7:-1].replace(":", " "), files_per_trigger=1)
    live.run_to_folder(live.minute_bars(stream, "1 hour"), out, ck, live.AVAILABLE_NOW).awaitTermination()
    assert spark.read.parquet(src).count() == 40
    want = {tuple(r) for r in live.minute_bars(batch).collect()}
    got = {tuple(r) for r in spark.read.schema("series_id string, minute timestamp_ntz, open double, high double, low double, close double, n bigint").parquet(out).collect()}
    assert got <= want
    dup = live.dedup(live.file_stream(spark, src, "event_id bigint, ts timestamp, event_type string, value double"),
                     ["event_type"], "ts", "2 hours")
    live.run_to_folder(dup, out + "2", ck + "2", live.AVAILABLE_NOW).awaitTermination()
    assert spark.read.parquet(out + "2").count() == 2


def test_replayed_batch_is_not_applied_twice(spark, tmp_path):
    schema = "series_id string, date string, price double, source string"
    old = spark.createDataFrame([("s", "d1", 1.0, "erapi")], schema)
    batch = spark.createDataFrame([("s", "d1", None, "cbr", 2), ("s", "d1", 4.0, "erapi", 1)], schema + ", seq int")
    store = live.Deltas(spark, str(tmp_path / "store"), old.schema, batch.schema)
    store.seed(old)
    resolve = live.newest_values(["series_id", "date"])
    assert [tuple(r) for r in store.view(resolve).collect()] == [("s", "d1", 1.0, "erapi")]
    for _ in range(2):
        store.append(0, batch)
    assert [tuple(r) for r in store.view(resolve).collect()] == [("s", "d1", 4.0, "cbr")]
    store.compact(resolve)
    assert store.folded() == 1 and store.pending().count() == 0
    store.append(1, batch.withColumn("price", F.lit(9.0)))
    assert [tuple(r) for r in store.view(resolve).collect()] == [("s", "d1", 9.0, "cbr")]


def test_a_batch_costs_the_same_whatever_the_history(spark, tmp_path):
    sizes = []
    for n in (10, 20_000):
        old = spark.range(n).selectExpr("cast(id as string) k", "cast(id as double) price")
        store = live.Deltas(spark, str(tmp_path / f"h{n}"), old.schema)
        store.seed(old)
        before = {p for p in (tmp_path / f"h{n}").rglob("*.parquet")}
        store.append(0, spark.createDataFrame([("5", 1.0), ("new", 2.0)], old.schema).coalesce(1))
        sizes.append(sum(p.stat().st_size for p in (tmp_path / f"h{n}").rglob("*.parquet") if p not in before))
        view = {r.k: r.price for r in store.view(live.first_rows(["k"])).collect()}
        assert view["5"] == 5.0 and view["new"] == 2.0 and len(view) == n + 1
    assert sizes[0] == sizes[1]


def test_settled_rows_stay_and_open_rows_take_the_first_outcome(spark, tmp_path):
    schema = "k string, prediction int, realized double, realized_ret double, realized_date string"
    ledger = spark.createDataFrame([("a", 1, None, None, None), ("b", 1, 5.0, 0.1, "d0"), ("c", None, None, None, None)], schema)
    outcome = "k string, realized double, realized_ret double, realized_date string"
    rows = spark.createDataFrame([(k, 7.0, 0.2, "d1") for k in "abc"], outcome)
    store = live.Deltas(spark, str(tmp_path / "ledger"), ledger.schema, rows.schema)
    store.seed(ledger)
    store.append(0, rows)
    store.append(1, rows.withColumn("realized", F.lit(8.0)))
    got = {r.k: r.realized for r in store.view(live.open_rows_filled(["k"])).collect()}
    assert got == {"a": 7.0, "b": 5.0, "c": None}


def test_freshness_rules(spark):
    run = F.lit("2024-01-01 12:00:00").cast("timestamp")
    o = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "series_id string, price double")
    l = spark.createDataFrame([("a", 2.0, "2024-01-01 12:00:59"), ("b", 2.0, "2024-01-01 12:01:01"), ("c", -1.0, "2024-01-01 11:00:00")],
                              "series_id string, live_price double, f string").selectExpr("series_id", "live_price", "timestamp(f) fetched_ts")
    f = spark.createDataFrame([("a", 1, "2024-01-01 11:50:00"), ("b", 1, "2024-01-01 11:49:59")],
                              "series_id string, prediction int, u string").selectExpr("series_id", "prediction", "timestamp(u) updated_ts")
    got = {r.series_id: (r.shown_price, r.basis, r.prediction, r.is_stale) for r in live.freshness_pick(o, l, f, run, ["series_id"]).collect()}
    assert got == {"a": (2.0, "live", 1, False), "b": (1.0, "official", None, True), "c": (1.0, "official", None, True)}


def test_range_algorithms_and_islands(spark, aligned):
    out = S.range_algorithms(aligned, [30]).toPandas().sort_values(["series_id", "t"])
    g = out[out.series_id == "a"].reset_index(drop=True)
    p = g["price"]
    for t in range(130, 600, 37):
        lo, hi = p[t - 29:t + 1].min(), p[t - 29:t + 1].max()
        pos = (p[t] - lo) / (hi - lo)
        assert (1 if pos < .2 else 0 if pos > .8 else None) == (None if pd.isna(g["A_30"][t]) else g["A_30"][t])
        assert g["C_30"][t] == int(p[t] - lo < hi - p[t])
    flags = spark.createDataFrame([("s", i, f) for i, f in enumerate([1, 1, 0, 1, 0, 0, 1])], "series_id string, date int, f int")
    runs = S.islands(flags.withColumn("f", F.col("f") == 1), "f").orderBy("start").collect()
    assert [(r.start, r.end, r.rows) for r in runs] == [(0, 1, 2), (3, 3, 1), (6, 6, 1)]


def test_params_cover_all_horizons():
    assert set(P.DEFAULT_BUCKET_RATE) == set(P.HORIZONS) == set(P.HEALTH_THRESHOLDS)
