import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from walkloom import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session.build("local[4]", shuffle_partitions=4)


def weekdays(n, start="2014-01-06"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def make_series(n, seed, name, market_from=0, gaps=True):
    """Mean-reverting log price with a market that leads it."""
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = 0.97 * x[i - 1] + rng.normal(0, 0.01)
    price = np.round(12 * np.exp(x), 6)
    spread = np.sin(np.arange(n) / 9) * 0.01 + rng.normal(0, 0.004, n)
    close = np.round(price * np.exp(spread), 6)
    rows = pd.DataFrame({
        "series_id": name, "date": weekdays(n), "price": price,
        "cross_price": np.round(70 * np.exp(0.5 * x + np.cumsum(rng.normal(0, 0.004, n))), 6),
        "close": close, "high": close * (1 + rng.uniform(0.001, 0.01, n)),
        "low": close * (1 - rng.uniform(0.001, 0.01, n)),
        "oil": np.round(80 * np.exp(np.cumsum(rng.normal(0, 0.015, n))), 6),
        "sentiment_raw": np.round(rng.normal(0, 0.05, n), 4),
        "rate_raw": np.where(np.arange(n) % 60 == 0, 5 + np.arange(n) // 60 * 0.25, np.nan)})
    missing = np.arange(n) < market_from
    if gaps:
        missing = missing | (rng.uniform(size=n) < 0.08)
    rows.loc[missing, ["close", "high", "low"]] = np.nan
    rows["t"] = np.arange(n, dtype=np.int32)
    return rows


ALIGNED_SCHEMA = ("series_id string, date date, price double, cross_price double, close double, "
                  "high double, low double, oil double, sentiment_raw double, rate_raw double, t int")


def to_spark(spark, pdf, schema=ALIGNED_SCHEMA):
    clean = pdf.astype(object).where(pd.notna(pdf), None)
    return spark.createDataFrame([tuple(r) for r in clean.itertuples(index=False)], schema)


@pytest.fixture(scope="session")
def frames():
    return {"a": make_series(620, 7, "a", market_from=150), "b": make_series(560, 11, "b")}


@pytest.fixture(scope="session")
def aligned(spark, frames):
    df = to_spark(spark, pd.concat(frames.values()))
    return session.materialise(df, "test-aligned")


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def day(text):
    return dt.date.fromisoformat(text)
