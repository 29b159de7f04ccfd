"""Window-frame helpers.

All frames are per series and ordered by date. ``by`` is the list of partition
columns, so the same expressions run on whole series (``["series_id"]``) or on
overlapping chunks of a long series (``["series_id", "chunk"]``, see
``walkloom.operators.chunks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

START = Window.unboundedPreceding
SERIES = ("series_id",)


def series_window(by=SERIES, order="date") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n-1 rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def preceding(w: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current row, without it."""
    return w.rowsBetween(-n, -1)


def upto(w: WindowSpec, lag: int = 0) -> WindowSpec:
    """Everything known ``lag`` rows ago: unbounded preceding .. -lag."""
    return w.rowsBetween(START, -lag)


def seen(x: Column, w: WindowSpec) -> Column:
    """Non-null values of x so far.

    For inputs whose nulls are only leading ones (returns, carried series) a
    trailing frame of n rows is complete exactly when ``seen >= n``. The running
    count costs one update per row, a counted frame would cost n.
    """
    return F.count(x).over(upto(w))


def full(agg: Column, n_seen: Column, w: WindowSpec, n: int) -> Column:
    """Aggregate over the last n rows, NULL until n values have been seen."""
    return F.when(n_seen >= n, agg.over(trailing(w, n)))


def row_id(w: WindowSpec) -> Column:
    """0-based row position inside the series."""
    return F.row_number().over(w) - 1


def carry(x: Column, w: WindowSpec) -> Column:
    """Last non-null value at or before the row."""
    return F.last(x, ignorenulls=True).over(upto(w))


def by_series(df: DataFrame, by=SERIES) -> DataFrame:
    """One shuffle on the series for all windows that follow.

    The partition count is given explicitly, as ``spark.sql.shuffle.partitions`` says: panels
    are small in bytes but heavy in window work, and adaptive execution would merge them into
    a single task by size.
    """
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(wanted, *by)


def wide_moments(df: DataFrame, cols, w: WindowSpec, n: int) -> DataFrame:
    """mean_<col> and std_<col> (population) over the last n rows for wide frames.

    Differences of running sums: the cost per row does not grow with n. Meant for values
    scattered around zero (deviations, momenta), where the squares cancel safely.
    """
    run = upto(w)
    df = df.withColumns({"_rows": F.count(F.lit(1)).over(run)}
                        | {f"_s_{c}": F.sum(c).over(run) for c in cols}
                        | {f"_q_{c}": F.sum(F.col(c) * F.col(c)).over(run) for c in cols})
    out = {}
    k = F.least(F.col("_rows"), F.lit(n))
    for c in cols:
        s, q = (F.col(f"_{a}_{c}") - F.lag(f"_{a}_{c}", n, 0.0).over(w) for a in "sq")
        out[f"mean_{c}"] = s / k
        out[f"std_{c}"] = F.sqrt(F.greatest(q / k - (s / k) * (s / k), F.lit(0.0)))
    drop = ["_rows", *[f"_{a}_{c}" for a in "sq" for c in cols]]
    return df.withColumns(out).drop(*drop)


def r6(x: Column) -> Column:
    """Report precision; adding 0.0 turns a negative zero into zero."""
    return F.round(x, 6) + F.lit(0.0)
