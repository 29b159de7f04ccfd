"""Forecast paths: future trading dates, anchors per horizon, segments, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom import params as P
from walkloom.functions import scalars as X
from walkloom.functions.frames import SERIES
from walkloom.operators import joins as J


def is_trading_day(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~F.date_format(day, "MM-dd").isin(*P.FIXED_HOLIDAYS)


def future_dates(bases: DataFrame, n: int, base: str = "base_date") -> DataFrame:
    """The next n weekdays that are no fixed holiday: adds k (1..n) and date.

    2n + 30 calendar days always hold n trading days: 14 holidays a year at most.
    """
    span = F.sequence(F.date_add(base, 1), F.date_add(base, 2 * n + 30))
    days = F.slice(F.filter(span, is_trading_day), 1, n)
    keep = [c for c in bases.columns]
    out = bases.select(*keep, F.posexplode(days).alias("k", "date"))
    return out.withColumn("k", F.col("k") + 1)


def band_multiplier(n: Column) -> Column:
    out = F.lit(1.0)
    for horizon, mult in P.BAND_MULTIPLIER.items():
        out = F.when(n == horizon, mult).otherwise(out)
    return out


def project(directions: DataFrame, bases: DataFrame, by=SERIES) -> DataFrame:
    """Median path and band for every chart horizon.

    ``directions``: (by, horizon, prediction, confidence, neutral); ``bases``: (by,
    base_date, base_rate, daily_vol). A longer chart follows the shorter horizons'
    anchors first. The shortest chart without any direction, not even a neutral one, is
    empty.
    """
    w = Window.partitionBy(*by).orderBy("horizon")
    disp = X.anchor_displacement(F.col("prediction"), F.col("confidence"), F.col("horizon"))
    d = directions.withColumn("db", disp)
    segments = d.select(*by, F.coalesce(F.lag("horizon").over(w), F.lit(0)).alias("a"),
                        F.coalesce(F.lag("db").over(w), F.lit(0.0)).alias("da"),
                        F.col("horizon").alias("b"), "db")
    shortest = F.min("horizon").over(Window.partitionBy(*by))
    silent = F.col("prediction").isNull() & ~F.coalesce("neutral", F.lit(False))
    charts = (d.withColumn("_empty", silent & (F.col("horizon") == shortest))
              .where(~F.col("_empty")).select(*by, F.col("horizon").alias("n")))
    steps = charts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    placed = J.segment_range(steps, segments, list(by))
    dates = future_dates(bases, max(P.HORIZONS))
    full = placed.join(dates, [*by, "k"])
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    frac = (k - F.col("a")) / (F.col("b") - F.col("a"))
    path = F.log("base_rate") + F.col("da") + (F.col("db") - F.col("da")) * F.pow(
        frac, F.lit(P.SEGMENT_POWER))
    half = F.when(F.col("daily_vol") > 0,
                  F.col("daily_vol") * F.sqrt(k) * band_multiplier(F.col("n"))).otherwise(
        0.012 * F.sqrt(k / n) * (1.0 + n / 90.0))
    mid = F.exp(path)
    return full.select(*by, F.col("n").alias("horizon"), "k", "date", half.alias("half_band"),
                       F.round(mid, 4).alias("rate"),
                       F.round(F.least(F.exp(path - half), mid), 4).alias("low"),
                       F.round(F.greatest(F.exp(path + half), mid), 4).alias("high"))
