"""The daily job: nested forecast, ledger kept once, and a broken ledger that blocks nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import weekdays
from walkloom import params as P
from walkloom.operators import daily
from walkloom.sources import sinks

DAY = dt.date(2014, 6, 5)


@pytest.fixture(scope="module")
def inputs(spark):
    days = weekdays(160)
    official = spark.createDataFrame([("a", d, 10.0 + i % 7) for i, d in enumerate(days)], "series_id string, date date, price double")
    directions = spark.createDataFrame(
        [("a", DAY, n, p, c, p is None) for n, p, c in ((7, 1, 0.7), (30, 0, 0.6), (60, None, None), (90, 1, 0.8))],
        "series_id string, as_of date, horizon int, prediction int, confidence double, neutral boolean")
    bases = spark.createDataFrame([("a", DAY, 11.23456, 0.01)], "series_id string, base_date date, base_rate double, daily_vol double")
    signals = spark.createDataFrame([("a", DAY, 0.5, 1.0, 2, 1)], "series_id string, date date, z60 double, rev double, gate int, extreme int")
    return directions, bases, signals, official


def run(spark, folder, inputs, **kw):
    return daily.run(spark, folder, *inputs, F.lit("2014-06-05 18:00:00").cast("timestamp_ntz"), **kw)


def test_forecast_is_nested_and_capped(spark, tmp_path, inputs):
    folder = f"file://{tmp_path}"
    assert run(spark, folder, inputs, today=F.lit("2014-06-04").cast("date")) == daily.Day(True, None)
    rows = {r.horizon: r for r in sinks.published(spark, f"{folder}/{daily.FORECAST}").collect()}
    assert sorted(rows) == [7, 30, 60, 90] and all(r.as_of == dt.date(2014, 6, 4) and r.base_rate == 11.2346 for r in rows.values())
    assert [len(rows[n].forecast) for n in (7, 30, 60, 90)] == [7, 30, 60, 90]
    assert [p.k for p in rows[30].forecast] == list(range(1, 31))
    assert rows[7].term_anchors == [] and [(a.horizon, a.prediction) for a in rows[60].term_anchors] == [(7, 1), (30, 0), (60, None)]
    assert rows[30].direction.prediction == 0 and rows[60].direction.neutral


def test_a_day_run_twice_is_recorded_once_and_settled(spark, tmp_path, inputs):
    folder = f"file://{tmp_path}"
    assert run(spark, folder, inputs).ledger_error is None and run(spark, folder, inputs).ledger_error is None
    rows = sinks.published(spark, f"{folder}/{daily.LEDGER}").collect()
    assert sorted((r.horizon, r.model_version) for r in rows) == sorted(
        [(n, P.MODEL_VERSION) for n in (7, 30, 60, 90)] + [(30, P.SHADOW_Z_NO_GATE), (60, P.SHADOW_EXTREME), (60, P.SHADOW_RESONANCE)])
    due = {r.horizon: r.realized_date for r in rows if r.model_version == P.MODEL_VERSION}
    assert due[7] is not None and due[30] is not None and due[60] is None and due[90] is None


def test_a_broken_ledger_does_not_block_the_forecast(spark, tmp_path, inputs):
    folder = f"file://{tmp_path}"
    assert run(spark, folder, inputs).ledger_error is None
    before = sinks.current_version(spark, f"{folder}/{daily.LEDGER}")
    forecast = sinks.current_version(spark, f"{folder}/{daily.FORECAST}")
    directions, bases, signals, official = inputs
    broken = official.withColumn("price", F.raise_error(F.lit("no prices")).cast("double"))
    day = run(spark, folder, (directions, bases, signals, broken))
    assert day.published and "no prices" in day.ledger_error
    assert sinks.current_version(spark, f"{folder}/{daily.LEDGER}") == before
    assert sinks.current_version(spark, f"{folder}/{daily.FORECAST}") != forecast
