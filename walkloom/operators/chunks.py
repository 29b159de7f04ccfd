"""Chunked execution for series too long for one task.

Daily series are bounded by the calendar and run whole. Finer panels (minutes, ticks)
are not: there a single series may hold a third of all rows. This module splits such a
series into spans of ``chunk_rows`` rows, gives each span the rows it looks back on (and
forward to), runs any operator of this package with ``by = [series_id, chunk]`` and keeps
the rows that belong to the span. Row numbers and running totals are made in two
levels: inside a span of the order column, then over one row per span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom.functions.frames import SERIES

CHUNK = "chunk"


def offsets(per_span: DataFrame, by: list[str], span: str, cols: list[str]) -> DataFrame:
    """Exclusive prefix sums over the spans of each series (one row per span)."""
    w = Window.partitionBy(*by).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    return per_span.select(*by, span, *[
        F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_before_{c}") for c in cols])


def row_ids(df: DataFrame, span: Column, by=SERIES, order: str = "date") -> DataFrame:
    """0-based row position ``t`` without sorting a whole series in one task.

    ``span`` must grow with ``order`` (year of a date, day of a minute).
    """
    by = list(by)
    df = df.withColumn("_span", span)
    counts = df.groupBy(*by, "_span").agg(F.count(F.lit(1)).alias("rows"))
    before = offsets(counts, by, "_span", ["rows"])
    local = F.row_number().over(Window.partitionBy(*by, "_span").orderBy(order)) - 1
    return (df.withColumn("_local", local).join(before, [*by, "_span"])
            .withColumn("t", (F.col("_local") + F.col("_before_rows")).cast("int"))
            .drop("_span", "_local", "_before_rows"))


def run(df: DataFrame, operator: Callable[[DataFrame, list[str]], DataFrame], chunk_rows: int,
        lookback: int, lookahead: int = 0, by=SERIES) -> DataFrame:
    """``operator(df, by)`` over overlapping chunks; df carries the row position ``t``.

    Rows within ``lookback`` of a later chunk's start (``lookahead`` of an earlier
    chunk's end) are copied into that chunk and dropped again afterwards, so the result has
    the input's rows exactly once.
    """
    by = list(by)
    home = F.floor(F.col("t") / chunk_rows)
    first = F.floor((F.col("t") - lookahead) / chunk_rows)
    last = F.floor((F.col("t") + lookback) / chunk_rows)
    spread = df.withColumn("_home", home).withColumn(
        CHUNK, F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    out = operator(spread, [*by, CHUNK])
    return out.where(F.col(CHUNK) == F.col("_home")).drop("_home", CHUNK)


def running_totals(df: DataFrame, cols: list[str], chunk_rows: int, by=SERIES) -> DataFrame:
    """Inclusive running sums of ``cols`` over ``t`` as ``cum_<col>``, in two levels."""
    by = list(by)
    df = df.withColumn("_span", F.floor(F.col("t") / chunk_rows))
    totals = df.groupBy(*by, "_span").agg(*[F.sum(c).alias(c) for c in cols])
    before = offsets(totals, by, "_span", cols)
    w = Window.partitionBy(*by, "_span").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"_in_{c}": F.sum(c).over(w) for c in cols}).join(before, [*by, "_span"])
    return out.withColumns({
        f"cum_{c}": F.coalesce(F.col(f"_in_{c}"), F.lit(0)) + F.col(f"_before_{c}")
        for c in cols}).drop("_span", *[f"_in_{c}" for c in cols],
                             *[f"_before_{c}" for c in cols])


def oos_rates(df: DataFrame, hit: str, horizon: int, chunk_rows: int, by=SERIES) -> DataFrame:
    """Out-of-sample counts over chunks: samples realised at t are those of row t - horizon.

    The shift needs ``horizon`` rows of history per chunk, the totals one row per chunk.
    """
    def shift(part: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("t")
        old = F.lag(hit, horizon).over(w)
        return part.withColumns({"realised_n": F.when(old.isNotNull(), 1).otherwise(0),
                                 "realised_hits": F.coalesce(old.cast("int"), F.lit(0))})
    shifted = run(df, shift, chunk_rows, lookback=horizon, by=by)
    return running_totals(shifted, ["realised_n", "realised_hits"], chunk_rows, by)
