"""Direction signals on the aligned table: market spread, reversion, extremes, regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkloom import params as P
from walkloom.functions import scalars as X
from walkloom.functions.frames import (SERIES, carry, preceding, row_id, seen,
                                       series_window, trailing, upto, wide_moments)
from walkloom.operators import joins as J


def _ensure_t(df: DataFrame, by) -> DataFrame:
    return df if "t" in df.columns else df.withColumn("t", row_id(series_window(by)))


def market_z(df: DataFrame, by=SERIES) -> DataFrame:
    """Spread z-score over the last 150 market rows (at least 60), per market row.

    Rows with a market price form their own window partition, so frames count market rows
    only; partitioning by (series, flag) is satisfied by the existing series shuffle.
    Adds dev, hlr, mrow (1-based market row), z_own, dev_change, z_prev.
    """
    df = _ensure_t(df, by).withColumns({
        "has_market": F.coalesce(F.col("close") > 0, F.lit(False)),
        "dev": X.spread(F.col("close"), F.col("price")),
        "hlr": F.when(F.col("close") > 0,
                      X.intraday_range(F.col("close"), F.col("high"), F.col("low")))})
    w = Window.partitionBy(*by, "has_market").orderBy("date")
    frame = trailing(w, P.ZDEV_WINDOW)
    z = (F.col("dev") - F.avg("dev").over(frame)) / (F.stddev_pop("dev").over(frame) + 1e-9)
    df = df.withColumn("mrow", F.when(F.col("has_market"), F.row_number().over(w)))
    df = df.withColumn("z_own", F.when(F.col("mrow") >= P.ZDEV_MIN_ROWS, z))
    return df.withColumns({"dev_change": F.col("dev") - F.lag("dev", 5).over(w),
                           "z_prev": F.lag("z_own").over(w)})


def range_median(df: DataFrame, by=SERIES) -> DataFrame:
    """Median of the intraday range so far, from 30 values on; one column hlr_median."""
    from walkloom.operators.medians import expanding_median
    med = expanding_median(df.where(F.col("hlr").isNotNull()), list(by), "t", "hlr",
                           "hlr_median", min_n=30)
    return df.join(med, [*by, "t"], "left")


def market_position(df: DataFrame, by=SERIES, max_rows: int = 3) -> DataFrame:
    """The market row each calendar row uses: its own, else at most three rows back.

    Adds z (only from the 60th market row on) and the confirmations' raw inputs.
    """
    cols = ["mrow", "z_own", "dev", "dev_change", "z_prev", "hlr"]
    cols += ["hlr_median"] if "hlr_median" in df.columns else []
    out = J.asof_tolerance_rows(df, F.col("has_market"), cols, max_rows, by)
    ok = F.col("near_mrow") >= P.ZDEV_MIN_ROWS
    return out.withColumn("z", F.when(ok, F.col("near_z_own")))


def confirms6(df: DataFrame, by=SERIES) -> DataFrame:
    """Six same-direction checks next to the market spread; shown, never used for confidence.

    Needs features oil_ret20 and sentiment_7d, the flag ``is_valid`` and hlr_median.
    """
    w = series_window(by)
    near = w.rowsBetween(-5, 0)
    close = F.when(F.col("has_market"), F.col("close"))
    mom = F.log(F.last(close, ignorenulls=True).over(near)) - F.log(
        F.first(close, ignorenulls=True).over(near))
    z = F.col("z")
    up = z > 0
    checks = {
        "c_momentum": (F.count(close).over(near) >= 2) & ((mom > 0) == up),
        "c_widening": (F.col("near_mrow") >= 6)
        & (X.sign_of(F.col("near_dev_change")) == X.sign_of(z)),
        "c_range": F.col("near_hlr") >= F.col("near_hlr_median"),
        "c_oil": F.col("is_valid") & ((F.col("oil_ret20") > 0) != up),
        "c_sentiment": F.col("is_valid") & (F.abs("sentiment_7d") > 0.01)
        & ((F.col("sentiment_7d") >= 0) == up),
        "c_streak": X.sign_of(F.col("near_z_prev")) == X.sign_of(z),
    }
    as_int = {k: F.when(z.isNotNull(), F.coalesce(c, F.lit(False)).cast("int"))
              for k, c in checks.items()}
    out = df.withColumns(as_int)
    return out.withColumn("confirms", sum((F.col(k) for k in checks), F.lit(0)))


def reversion(df: DataFrame, by=SERIES) -> DataFrame:
    """rev = -(lp - mean120) / std60; positive means oversold."""
    df = _ensure_t(df, by)
    w = series_window(by)
    lp = F.log("price")
    n = seen(F.col("price"), w)
    sd = F.sqrt(F.greatest(F.var_pop(lp).over(trailing(w, P.VOL_WINDOW)), F.lit(1e-12)))
    return df.withColumns({
        "lp": lp,
        "rev": F.when(n >= P.REV_MEAN_WINDOW,
                      -(lp - F.avg(lp).over(trailing(w, P.REV_MEAN_WINDOW))) / sd)})


def spread_z60(df: DataFrame, by=SERIES) -> DataFrame:
    """z of the carried spread over 60 calendar rows; adds close_carried, md, z60."""
    w = series_window(by)
    df = df.withColumn("close_carried", carry(F.col("close"), w))
    df = df.withColumn("md", X.spread(F.col("close_carried"), F.col("price")))
    md, n = F.col("md"), seen(F.col("md"), w)
    frame = trailing(w, P.Z_WINDOW)
    sd = F.sqrt(F.greatest(F.var_pop(md).over(frame), F.lit(1e-12)))
    return df.withColumn("z60", F.when(n >= P.Z_WINDOW, (md - F.avg(md).over(frame)) / sd))


def confirms3(df: DataFrame, by=SERIES) -> DataFrame:
    """Gate of the 30-row policy: momentum, widening spread, oil against the direction.

    The five-row differences run over rows that already have a z, so the first five such
    rows cannot pass those two checks.
    """
    w = series_window(by)
    z, md, close = F.col("z60"), F.col("md"), F.col("close_carried")
    k = F.count(z).over(upto(w)) - 1
    mom = F.log(close) - F.log(F.lag(close, 5).over(w))
    oil = F.log("oil")
    oil20 = F.when(seen(oil, w) >= 21, oil - F.lag(oil, 20).over(w))
    checks = {
        "g_momentum": (k >= 5) & ((mom > 0) == (z > 0)),
        "g_widening": (k >= 5) & (X.sign_of(md - F.lag(md, 5).over(w)) == X.sign_of(z)),
        "g_oil": (oil20 > 0) != (z > 0),
    }
    has_z = z.isNotNull()
    out = df.withColumns({c: F.when(has_z, F.coalesce(x, F.lit(False)).cast("int")).otherwise(0)
                          for c, x in checks.items()})
    return out.withColumn("gate", sum((F.col(c) for c in checks), F.lit(0)))


def breakout(df: DataFrame, by=SERIES, n: int = P.BREAKOUT_WINDOW) -> DataFrame:
    """1 above the highest of the prior n rows, 0 below their lowest, else NULL."""
    df = _ensure_t(df, by)
    prior = preceding(series_window(by), n)
    p = F.col("price")
    return df.withColumn("breakout", F.when(F.col("t") >= n, F.when(p > F.max(p).over(prior), 1)
                                            .when(p < F.min(p).over(prior), 0)))


def extreme_distance(df: DataFrame, by=SERIES, n: int = P.EXTREME_WINDOW,
                     share: float = P.EXTREME_SHARE) -> DataFrame:
    """Position in the n-row range: near the low -> 1, near the high -> 0, middle -> NULL."""
    df = _ensure_t(df, by)
    frame = trailing(series_window(by), n)
    p = F.col("price")
    lo, hi = F.min(p).over(frame), F.max(p).over(frame)
    df = df.withColumn("range_pos", F.when((F.col("t") >= n - 1) & (hi > lo),
                                           F.try_divide(p - lo, hi - lo)))
    pos = F.col("range_pos")
    return df.withColumn("extreme", F.when(pos < share, 1).when(pos > 1 - share, 0))


def high_vol(df: DataFrame, by=SERIES) -> DataFrame:
    """True when the 20-row volatility exceeds the median of the 252 volatilities before."""
    df = _ensure_t(df, by)
    w = series_window(by)
    df = df.withColumn("_r", F.log("price") - F.log(F.lag("price").over(w)))
    vol = F.sqrt(F.greatest(F.var_pop("_r").over(trailing(w, P.REGIME_VOL_WINDOW)), F.lit(1e-12)))
    df = df.withColumn("vol20p", F.when(seen(F.col("_r"), w) >= P.REGIME_VOL_WINDOW, vol))
    prior = preceding(w, P.REGIME_WINDOW)
    enough = (F.col("t") >= P.REGIME_WINDOW) & (
        F.count("vol20p").over(prior) > P.REGIME_MIN_FINITE)
    hv = enough & (F.col("vol20p") > F.percentile("vol20p", F.lit(0.5)).over(prior))
    return df.withColumn("high_vol", F.coalesce(hv, F.lit(False))).drop("_r")


def long_signals(df: DataFrame, by=SERIES, with_regime: bool = False) -> DataFrame:
    """All inputs of the long-horizon policies on one frame order."""
    out = confirms3(spread_z60(reversion(df, by), by), by)
    out = extreme_distance(breakout(out, by), by)
    out = out.withColumn("bucket", X.rev_bucket(F.col("rev")))
    return high_vol(out, by) if with_regime else out


def composite_reversion(df: DataFrame, by=SERIES) -> DataFrame:
    """score = -mean z of five features over the last 500 valid rows (at least 200).

    Needs the feature columns and ``is_valid``. Valid rows form their own window
    partition. Rows that are not valid keep a NULL score; valid rows with fewer than
    200 valid rows so far score 0.
    """
    w = Window.partitionBy(*by, "is_valid").orderBy("date")
    cols = P.REVERSION_FEATURES
    df = wide_moments(df, cols, w, P.COMPOSITE_WINDOW)
    mean_z = sum(((F.col(c) - F.col(f"mean_{c}")) / (F.col(f"std_{c}") + 1e-9) for c in cols),
                 F.lit(0.0)) / len(cols)
    enough = F.row_number().over(w) >= P.COMPOSITE_MIN_ROWS
    score = F.when(F.col("is_valid"), F.when(enough, -mean_z).otherwise(0.0))
    df = df.withColumn("score", score).drop(*[f"{m}_{c}" for m in ("mean", "std") for c in cols])
    return df.withColumn("strength", F.abs("score"))


def extreme_reversion(df: DataFrame, by=SERIES, k: float = 2.0) -> DataFrame:
    """Price at least k relative standard deviations away from its 20-row mean."""
    df = _ensure_t(df, by)
    w = series_window(by)
    p = F.col("price")
    mean20 = F.when(F.col("t") >= 19, F.avg(p).over(trailing(w, 20)))
    span = trailing(w, 250)
    mean250 = F.avg(p).over(span)
    rel_sd = F.when((F.col("t") >= 19) & (mean250 > 0) & (F.count(p).over(span) > 30),
                    F.try_divide(F.stddev_pop(p).over(span), mean250))
    df = df.withColumns({"mr_dev": F.try_divide(p - mean20, mean20), "rel_sd": rel_sd})
    ok = F.col("rel_sd") > 0
    return df.withColumns({
        "mr_trigger": F.coalesce(ok & (F.abs("mr_dev") >= k * F.col("rel_sd")), F.lit(False)),
        "mr_pred": F.when(ok, F.when(F.col("mr_dev") > 0, 0).otherwise(1)),
        "mr_strength": F.when(ok, F.abs(F.try_divide("mr_dev", "rel_sd"))).otherwise(0.0)})


def range_algorithms(df: DataFrame, horizons=P.HORIZONS, by=SERIES) -> DataFrame:
    """Five predictions from range extremes with look-back = horizon: columns A_N .. E_N."""
    df = _ensure_t(df, by)
    w = series_window(by)
    p, t = F.col("price"), F.col("t")
    ranges = {}
    for n in horizons:
        for width, tag in ((n, n), (max(5, n // 4), f"{n}s")):
            ranges[f"lo_{tag}"] = F.min(p).over(trailing(w, width))
            ranges[f"hi_{tag}"] = F.max(p).over(trailing(w, width))
        ranges[f"plo_{n}"] = F.min(p).over(preceding(w, n))
        ranges[f"phi_{n}"] = F.max(p).over(preceding(w, n))
    df = df.withColumns(ranges)
    out = {}
    for n in horizons:
        lo, hi = F.col(f"lo_{n}"), F.col(f"hi_{n}")
        pos = F.try_divide(p - lo, hi - lo)
        out[f"A_{n}"] = F.when(pos < 0.2, 1).when(pos > 0.8, 0)
        out[f"B_{n}"] = F.when(p > F.col(f"phi_{n}"), 1).when(p < F.col(f"plo_{n}"), 0)
        out[f"C_{n}"] = F.when(hi > lo, F.when(p - lo < hi - p, 1).otherwise(0))
        dhi, dlo = (x - F.lag(x, 20).over(w) for x in (hi, lo))
        out[f"D_{n}"] = F.when(t >= n + 20, F.when((dhi > 0) & (dlo > 0), 1)
                               .when((dhi < 0) & (dlo < 0), 0))
        ps = F.coalesce(F.try_divide(p - F.col(f"lo_{n}s"), F.col(f"hi_{n}s") - F.col(f"lo_{n}s")),
                        F.lit(0.5))
        pl = F.coalesce(pos, F.lit(0.5))
        out[f"E_{n}"] = F.when((ps < 0.3) & (pl < 0.3), 1).when((ps > 0.7) & (pl > 0.7), 0)
    return df.withColumns(out).drop(*ranges)


def jumps(df: DataFrame, by=SERIES, threshold: float = P.JUMP_THRESHOLD) -> DataFrame:
    """edge: the log move from this row to the next exceeds the threshold."""
    w = series_window(by)
    move = F.log(F.lead("price").over(w)) - F.log("price")
    return df.withColumns({"next_move": move, "next_date": F.lead("date").over(w)}).withColumn(
        "edge", F.abs("next_move") > threshold)


def islands(df: DataFrame, flag: str, by=SERIES) -> DataFrame:
    """Maximal runs of flagged rows: (by, start, end, rows)."""
    w = series_window(by)
    wf = Window.partitionBy(*by, flag).orderBy("date")
    grouped = df.withColumn("_run", F.row_number().over(w) - F.row_number().over(wf))
    return (grouped.where(F.col(flag)).groupBy(*by, "_run")
            .agg(F.min("date").alias("start"), F.max("date").alias("end"),
                 F.count(F.lit(1)).alias("rows")).drop("_run"))


def trailing_contamination(df: DataFrame, windows=(20, 60, 120, 150, 252),
                           by=SERIES) -> DataFrame:
    """hit_w: the last w rows touch an edge day (the day before or after a flagged move)."""
    w = series_window(by)
    day = F.col("edge") | F.lag("edge", 1, False).over(w)
    df = df.withColumn("edge_day", F.coalesce(day, F.lit(False)).cast("int"))
    return df.withColumns({f"hit_{n}": F.max("edge_day").over(trailing(w, n)) for n in windows})


def trend_regime(df: DataFrame, by=SERIES) -> DataFrame:
    w = series_window(by)
    mom = F.log("price") - F.log(F.lag("price", P.TREND_LOOKBACK).over(w))
    return df.withColumn("trend_regime", F.when(mom > P.TREND_HALF_WIDTH, "bull")
                         .when(mom < -P.TREND_HALF_WIDTH, "bear")
                         .when(mom.isNotNull(), "sideways").otherwise("unknown_warmup"))


def recent_volatility(df: DataFrame, by=SERIES, n: int = 60) -> DataFrame:
    """Sample deviation of the last n log returns, from 20 returns on."""
    w = series_window(by)
    df = df.withColumn("_r", F.log("price") - F.log(F.lag("price").over(w)))
    frame = trailing(w, n)
    return df.withColumn("daily_vol", F.when(F.count("_r").over(frame) >= 20,
                                             F.stddev_samp("_r").over(frame))).drop("_r")


def recent_trend(df: DataFrame, by=SERIES) -> DataFrame:
    """Percent change over the last 20 rows with a +-3 % band; NULL before row 25."""
    df = _ensure_t(df, by)
    change = (F.try_divide(F.col("price"), F.lag("price", 19).over(series_window(by))) - 1) * 100
    df = df.withColumn("trend_pct", F.when(F.col("t") >= 24, change))
    return df.withColumn("trend_label", F.when(F.col("trend_pct") > 3, "up")
                         .when(F.col("trend_pct") < -3, "down")
                         .when(F.col("trend_pct").isNotNull(), "flat").otherwise("no_data"))


def valid_rows(df: DataFrame, features: list[str], by=SERIES) -> DataFrame:
    """is_valid: every feature present; first_row: first row a walk-forward may start at."""
    df = df.withColumn("is_valid", J.all_of(features))
    whole = Window.partitionBy(*by)
    start = F.min(F.when(F.col("is_valid"), F.col("t"))).over(whole)
    return df.withColumn("first_row", F.greatest(F.lit(P.MIN_TRAIN), F.coalesce(start, F.lit(0))))


