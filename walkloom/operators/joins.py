"""Alignment joins between the official calendar, the market and macro series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom.functions.frames import SERIES, by_series, carry, row_id, series_window

KEY = ["series_id", "date"]


def per_day(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table with one row per calendar day.

    The bound is the calendar, not the data: 36 525 rows per century, under 1 MB.
    Only tables that were grouped by date alone may pass through here.
    """
    return F.broadcast(df)


def date_union_ffill(primary: DataFrame, secondary: DataFrame, by=SERIES) -> DataFrame:
    """Full outer join of two (by, date, value) tables with both values carried forward.

    Days before the first primary value are dropped; ``filled`` marks days whose
    primary value was carried.
    """
    w = series_window(by)
    both = (primary.select(*by, "date", F.col("value").alias("price"))
            .join(secondary.select(*by, "date", F.col("value").alias("cross_price")),
                  [*by, "date"], "full"))
    return (both.select(*by, "date", carry(F.col("price"), w).alias("price"),
                        carry(F.col("cross_price"), w).alias("cross_price"),
                        F.col("price").isNull().alias("filled"))
            .where(F.col("price").isNotNull()))


def exact(official: DataFrame, market: DataFrame) -> DataFrame:
    return official.join(market, KEY, "inner")


def exact_then_carry(left: DataFrame, right: DataFrame, cols: list[str], by=SERIES,
                     on=("series_id", "date")) -> DataFrame:
    """Left equi join, then carry: right rows on days outside the left calendar are lost."""
    w = series_window(by)
    joined = left.join(right, list(on), "left")
    carried = {c: carry(F.col(c), w) for c in cols}
    return joined.withColumns(carried)


def asof_backward(left: DataFrame, right: DataFrame, cols: list[str], by=SERIES,
                  on: str = "date", chunk=None) -> DataFrame:
    """Last right row at or before each left row, including days the left side lacks.

    Both sides are unioned and the last right row is carried within the partition.
    ``chunk`` (a function of the order column, such as ``F.year``) splits a long
    series into separately processed spans; the last right row of earlier spans
    enters through a table with one row per span.
    """
    span = chunk(F.col(on)) if chunk else F.lit(0)
    # the values travel as one struct, so a right row with a NULL value stays a match
    payload = F.struct(*[F.col(c) for c in cols])
    lhs = left.withColumns({"_side": F.lit(1), "_span": span})
    rhs = right.select(*by, on, payload.alias("_right"), F.lit(0).alias("_side"),
                       span.alias("_span"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    w = Window.partitionBy(*by, "_span").orderBy(on, "_side")
    within = both.withColumn("_hit", carry(F.col("_right"), w)).where(F.col("_side") == 1)
    if chunk:
        ends = (rhs.groupBy(*by, "_span").agg(F.max_by("_right", on).alias("_end")))
        spans = (both.select(*by, "_span").distinct().join(ends, [*by, "_span"], "left"))
        ws = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.select(*by, "_span", F.last("_end", ignorenulls=True).over(ws).alias("_in"))
        within = within.join(spans, [*by, "_span"], "left").withColumn(
            "_hit", F.coalesce("_hit", "_in"))
    kept = [c for c in left.columns]
    return within.select(*kept, *[F.col("_hit")[c].alias(c) for c in cols])


def asof_macro(panel: DataFrame, macro: DataFrame, value: str, name: str) -> DataFrame:
    """As-of join of a date-only macro series onto every series of the panel.

    Of rows with the same date the largest value counts, so there is one row per calendar day. The
    series is spread over the days each value
    is in force, so the panel needs a plain equality on date and is neither scanned nor
    shuffled again. The last value stays in force without an end.
    """
    daily = (macro.where(F.col("date").isNotNull()).groupBy("date").agg(F.max(value).alias("_v"))
             .withColumn("_y", F.year("date")))
    # the next date: within the year, or the first one of the next year that has any
    years = daily.groupBy("_y").agg(F.min("date").alias("_first")).withColumn(
        "_after", F.lead("_first").over(Window.orderBy("_y")))  # one row per year
    inside = F.lead("date").over(Window.partitionBy("_y").orderBy("date"))
    steps = (daily.withColumn("_in", inside).join(F.broadcast(years.select("_y", "_after")), "_y")
             .select("date", "_v", F.coalesce("_in", "_after").alias("_next")))
    days = F.sequence(F.col("date"), F.coalesce(F.date_sub("_next", 1), F.col("date")))
    in_force = steps.select(F.explode(days).alias("date"), F.col("_v").alias(name))
    newest = (steps.where(F.col("_next").isNull())
              .select(F.struct("date", "_v").alias("s")).scalar())
    joined = panel.join(per_day(in_force), "date", "left")
    return joined.withColumn(name, F.when(F.col("date") > newest["date"], newest["_v"])
                             .otherwise(F.col(name)))


def asof_tolerance_rows(panel: DataFrame, flag: Column, cols: list[str], max_rows: int = 3,
                        by=SERIES) -> DataFrame:
    """Values of the flagged row itself, else of the nearest flagged row at most
    ``max_rows`` rows earlier. The panel carries its row position in ``t``."""
    w = series_window(by)
    own = F.when(flag, F.struct(F.col("t").alias("src_t"), *[F.col(c) for c in cols]))
    out = panel.withColumn("_own", own).withColumn("_near", carry(F.col("_own"), w))
    usable = (F.col("t") - F.col("_near.src_t")) <= max_rows
    picked = [F.when(usable, F.col("_near")[c]).alias(f"near_{c}") for c in ["src_t", *cols]]
    return out.select(*panel.columns, *picked)


def forward_outcome(panel: DataFrame, horizons, by=SERIES, price="price") -> DataFrame:
    """actual_N = 1 when the price N rows later is higher, 0 when not, NULL when unknown."""
    w = series_window(by)
    later = {n: F.lead(price, n).over(w) for n in horizons}
    return panel.withColumns({
        f"actual_{n}": F.when(x > F.col(price), 1).when(x.isNotNull(), 0)
        for n, x in later.items()})


def segment_range(steps: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Each step k with the anchor segment a < k <= b of its group.

    Anchors carry (by, a, da, b, db); groups hold at most one segment per horizon, so
    the equi join on ``by`` with the range as residual filter multiplies a step by at most
    four before the filter.
    """
    joined = steps.join(anchors, by)
    return joined.where((F.col("k") > F.col("a")) & (F.col("k") <= F.col("b")))


def interval_contaminated(panel: DataFrame, edge: Column, horizon: int, by=SERIES) -> DataFrame:
    """True when the label window [t, t+horizon] contains a flagged edge i (t <= i < t+horizon)."""
    w = series_window(by).rowsBetween(0, horizon - 1)
    return panel.withColumn("contaminated",
                            F.coalesce(F.max(edge.cast("int")).over(w) == 1, F.lit(False)))


def nearest_key(requests: DataFrame, table: DataFrame, request_key: str, table_key: str,
                value_cols: list[str], by: list[str]) -> DataFrame:
    """Row of ``table`` whose key is nearest to the requested key, smaller key on ties.

    Joined per group on ``by``; a calibration group holds four horizons.
    """
    joined = requests.join(table, by)
    # the order key makes |distance| decide first and the smaller key break ties
    rank = F.struct(F.abs(F.col(table_key) - F.col(request_key)), F.col(table_key))
    picked = F.min_by(F.struct(table_key, *value_cols), rank)
    group = [*by, request_key]
    out = joined.groupBy(*group).agg(picked.alias("_p"))
    return out.select(*group, *[F.col("_p")[c].alias(c) for c in [table_key, *value_cols]])


def measured_or_default(measured: DataFrame, defaults: DataFrame, keys: list[str],
                        min_n: int = 20) -> DataFrame:
    """Measured rate when it has at least ``min_n`` cases, else the built-in default.

    ``defaults`` is a literal table of at most 16 rows.
    """
    joined = measured.join(F.broadcast(defaults), keys, "left")
    rate = F.when(F.col("n") >= min_n, F.round(F.col("hits") / F.col("n"), 4)) \
        .otherwise(F.col("default_rate"))
    return joined.withColumn("rate", rate).drop("default_rate")


def snapshot_compare(old: DataFrame, new: DataFrame, by=SERIES) -> DataFrame:
    """Old and new value per date, whether they differ at 6 digits, and their ratio."""
    keys = [*by, "date"]
    both = (old.select(*keys, F.col("price").alias("old_price"))
            .join(new.select(*keys, F.col("price").alias("new_price")), keys, "full"))
    changed = ~F.round("old_price", 6).eqNullSafe(F.round("new_price", 6))
    ratio = F.try_divide("new_price", "old_price")
    return both.withColumns({"changed": changed, "ratio": F.round(ratio, 6)})


def differing_ranges(old: DataFrame, new: DataFrame, by=SERIES, unit: str = "month") -> DataFrame:
    """(by, range) of two snapshots whose rows differ at 6 digits, a range being a calendar unit.

    Each side is reduced to a row count and two digests per range that merge in any order, before
    anything is shuffled. Rows that differ only in how they are ordered have equal digests; two ranges
    that differ get equal ones with a probability of about 2^-90.
    """
    def digests(df, name):
        row = [F.col(c) for c in (*by, "date")] + [F.round("price", 6)]
        return df.groupBy(*by, F.trunc("date", unit).alias("range")).agg(F.struct(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*row)).alias("x"),
            F.sum(F.pmod(F.xxhash64(F.lit("sum"), *row), F.lit(1 << 31))).alias("s")).alias(name))
    joined = digests(old, "_old").join(digests(new, "_new"), [*by, "range"], "full")
    return joined.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*by, "range")


def snapshot_changes(old: DataFrame, new: DataFrame, by=SERIES, unit: str = "month") -> DataFrame:
    """The changed rows of ``snapshot_compare``, without joining the snapshots as a whole: only rows
    of ranges with different digests are shuffled by their date."""
    ranges = differing_ranges(old, new, by, unit)
    inside = lambda df: (df.withColumn("range", F.trunc("date", unit))
                         .join(ranges, [*by, "range"], "left_semi").drop("range"))
    return snapshot_compare(inside(old), inside(new), by).where("changed")


def metrics_delta(before: DataFrame, after: DataFrame, keys: list[str],
                  metrics: list[str]) -> DataFrame:
    """Long table (keys, metric, before, after, delta)."""
    def long(df, name):
        typed = df.select(*keys, *[F.col(m).cast("double") for m in metrics])
        return typed.unpivot(keys, metrics, "metric", name)
    joined = long(before, "before").join(long(after, "after"), [*keys, "metric"], "full")
    return joined.withColumn("delta", F.col("after") - F.col("before"))


def aligned(official: DataFrame, market: DataFrame | None = None, oil: DataFrame | None = None,
            sentiment: DataFrame | None = None, key_rate: DataFrame | None = None,
            by=SERIES) -> DataFrame:
    """One wide table on the official calendar: everything later windows need.

    Adds ``t`` (0-based row), market close/high/low of the same day, as-of oil and
    sentiment, and the key rate of the same day (carried later, inside the features).
    ``rate_absent`` tells an absent or empty rate table from a rate that is not yet known.
    """
    df = official
    if market is not None:
        df = df.join(market, KEY, "left")
    else:
        df = df.withColumns({c: F.lit(None).cast("double") for c in ("close", "high", "low")})
    if oil is not None:
        df = asof_macro(df, oil, "value", "oil")
    else:
        df = df.withColumn("oil", F.lit(None).cast("double"))
    if sentiment is not None:
        df = asof_macro(df, sentiment, "sentiment", "sentiment_raw")
    else:
        df = df.withColumn("sentiment_raw", F.lit(None).cast("double"))
    if key_rate is not None:
        daily = key_rate.where(F.col("date").isNotNull()).groupBy("date").agg(F.max("value").alias("rate_raw"))
        rows = key_rate.select(F.count(F.lit(1)).alias("n")).scalar()
        df = df.join(per_day(daily), "date", "left").withColumn("rate_absent", rows == 0)
    else:
        df = df.withColumns({"rate_raw": F.lit(None).cast("double"), "rate_absent": F.lit(True)})
    return by_series(df, by).withColumn("t", row_id(series_window(by)))


def all_of(cols: list[str]) -> Column:
    return reduce(lambda a, c: a & F.col(c).isNotNull(), cols[1:], F.col(cols[0]).isNotNull())
