"""Causal rolling features on the official calendar (35 columns).

Three projections, all on the same (series, date) frame order, so the series is
shuffled and sorted once. Returns, cross and oil levels have leading NULLs only, which is
why a running count decides whether a trailing frame is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkloom.functions.frames import SERIES, carry, full, seen, series_window, trailing

OWN = ["ret1", "mom5", "mom20", "vol5", "vol20", "skew20", "pos60", "level_z60", "rsi14",
       "dow", "ma20_dev", "ma60_dev", "slope20"]
CROSS = ["cross_ret1", "cross_ret5", "cross_ret20", "cross_vol20", "implied_mom5",
         "implied_mom20", "cross_corr60", "cross_beta60"]
OIL = ["oil_ret1", "oil_ret5", "oil_ret20", "oil_vol20", "oil_vol_ratio", "oil_corr60"]
SENTIMENT = ["sentiment", "sentiment_7d", "sentiment_30d", "sentiment_trend",
             "sentiment_coverage"]
RATE = ["key_rate", "rate_change", "rate_change_60d"]
ALL = OWN + CROSS + OIL + SENTIMENT + RATE

# The smoothing of rsi14 is an exponential mean with weight 1/14. Weighted running sums are
# restarted every RSI_BLOCK rows; the totals of all earlier blocks are folded into one pair.
RSI_BLOCK = 512
RSI_DECAY = 13.0 / 14.0

# Rows of history a feature value depends on: the rsi blocks are the longest reach.
LOOKBACK = 2 * RSI_BLOCK


def _levels(df: DataFrame, by) -> DataFrame:
    w = series_window(by)
    whole = Window.partitionBy(*by)
    rate = carry(F.col("rate_raw"), w)
    if "rate_absent" in df.columns:  # no rate table at all: 0.0, unlike NULL before the first decision
        rate = F.when(F.col("rate_absent"), F.lit(0.0)).otherwise(rate)
    active = F.avg(F.col("cross_price").isNotNull().cast("double")).over(whole) > 0.9
    return df.withColumns({
        "lp": F.log("price"),
        "lu": F.when(active, F.log(carry(F.col("cross_price"), w))),
        "lo": F.log("oil"),
        "key_rate": rate,
        "sentiment": F.coalesce("sentiment_raw", F.lit(0.0)),
        "sentiment_coverage": F.col("sentiment_raw").isNotNull().cast("double"),
    })


def _returns(df: DataFrame, by) -> DataFrame:
    w = series_window(by)
    lag = lambda c: F.lag(c).over(w)
    return df.withColumns({
        "r": F.col("lp") - lag("lp"),
        "ru": F.col("lu") - lag("lu"),
        "ro": F.col("lo") - lag("lo"),
    })


def _rsi_sums(df: DataFrame, by) -> DataFrame:
    offset = F.col("t") % RSI_BLOCK
    weight = F.pow(F.lit(1.0 / RSI_DECAY), offset)
    block = Window.partitionBy(*by, "_blk").orderBy("date")
    gain, loss = F.greatest("r", F.lit(0.0)), F.greatest(-F.col("r"), F.lit(0.0))
    gain, loss = (F.when(F.col("r").isNotNull(), x) for x in (gain, loss))
    run = block.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_blk", F.floor(F.col("t") / RSI_BLOCK)).withColumns({
        "_gain": F.coalesce(F.sum(gain * weight).over(run), F.lit(0.0)),
        "_loss": F.coalesce(F.sum(loss * weight).over(run), F.lit(0.0))})


def build(df: DataFrame, by=SERIES, keep: list[str] | None = None) -> DataFrame:
    """Features for the output of ``joins.aligned``; passes all input columns through."""
    by = list(by)
    w = series_window(by)
    base = _rsi_sums(_returns(_levels(df, by), by), by)
    offset = F.col("t") % RSI_BLOCK
    # blocks start at multiples of 512, so row 511 of a block holds the block's total; one entry
    # per earlier block, 72 in a century of days
    tail = F.pow(F.lit(RSI_DECAY), F.lit(RSI_BLOCK))
    totals = F.collect_list(F.when(offset == RSI_BLOCK - 1, F.struct(
        F.col("_gain").alias("g"), F.col("_loss").alias("l")))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    zero = F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("l"))

    def fold(past, block):
        # only the ratio of gain and loss matters: a block without any move leaves it, and the
        # numbers, as they are, so that it survives stretches of any length
        moved = F.struct((block["g"] + tail * past["g"]).alias("g"), (block["l"] + tail * past["l"]).alias("l"))
        return F.when((block["g"] == 0) & (block["l"] == 0), past).otherwise(moved)

    base = base.withColumn("_past", F.aggregate(totals, zero, fold)).withColumns({
                             "_pgain": F.col("_past.g"), "_ploss": F.col("_past.l"),
                             "_n": seen(F.col("lp"), w), "_nr": seen(F.col("r"), w),
                             "_nu": seen(F.col("ru"), w), "_no": seen(F.col("ro"), w),
                             "_nur": seen(F.when(F.col("r").isNotNull(), F.col("ru")), w),
                             "_nor": seen(F.when(F.col("r").isNotNull(), F.col("ro")), w)})
    n, nr, nu, no, nur, nor = (F.col(c) for c in ("_n", "_nr", "_nu", "_no", "_nur", "_nor"))
    lp, lu, lo, r, ru, ro = (F.col(c) for c in ("lp", "lu", "lo", "r", "ru", "ro"))
    fr = lambda agg, cnt, k: full(agg, cnt, w, k)
    # a sum of log returns is a difference of log levels: one lag instead of a frame
    moved = lambda level, cnt, k: F.when(cnt >= k, level - F.lag(level, k).over(w))
    raw = lambda x, k: F.sum(x).over(trailing(w, k))
    li = lp - lu

    # Sample moments of returns from sums inside the frame. Returns scatter around zero, so
    # the squares do not cancel, and plain sums are the cheapest aggregates a frame can hold.
    def cov(x, y, level_x, level_y, cnt, k):
        sx, sy = moved(level_x, cnt, k), moved(level_y, cnt, k)
        return F.when(cnt >= k, (raw(x * y, k) - sx * sy / k) / (k - 1))

    def var(x, level, cnt, k):
        return F.greatest(cov(x, x, level, level, cnt, k), F.when(cnt >= k, 0.0))

    sd = lambda x, level, cnt, k: F.sqrt(var(x, level, cnt, k))

    def corr(x, y, level_x, level_y, cnt, k):
        scale = F.sqrt(var(x, level_x, cnt, k) * var(y, level_y, cnt, k))
        return F.try_divide(cov(x, y, level_x, level_y, cnt, k), scale)

    def skew(k):
        m = moved(lp, nr, k) / k
        m2 = raw(r * r, k) / k - m * m
        m3 = raw(r * r * r, k) / k - 3 * m * raw(r * r, k) / k + 2 * m * m * m
        flat = fr(F.max(r), nr, k) == fr(F.min(r), nr, k)  # a window without variation has skew 0
        return F.when(flat, 0.0).when(
            nr >= k, (k * (k - 1)) ** 0.5 / (k - 2) * F.try_divide(m3, F.pow(m2, F.lit(1.5))))

    lo60, hi60 = fr(F.min(lp), n, 60), fr(F.max(lp), n, 60)
    mean20, mean60 = fr(F.avg(lp), n, 20), fr(F.avg(lp), n, 60)
    gain = F.col("_gain") + tail * F.col("_pgain")
    loss = F.col("_loss") + tail * F.col("_ploss")
    sent = F.col("sentiment")
    mean = lambda k: F.avg(sent).over(trailing(w, k))
    rate = F.col("key_rate")
    cols = {
        "ret1": r,
        "mom5": moved(lp, nr, 5),
        "mom20": moved(lp, nr, 20),
        "vol5": sd(r, lp, nr, 5),
        "vol20": sd(r, lp, nr, 20),
        "skew20": skew(20),
        "pos60": (lp - lo60) / (hi60 - lo60 + 1e-12),
        "level_z60": F.try_divide(lp - mean60, fr(F.stddev_samp(lp), n, 60)),
        "rsi14": F.when((nr >= 14) & (loss > 0), 100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))),
        "dow": F.weekday("date") / 6.0,
        "ma20_dev": lp - mean20,
        "ma60_dev": lp - mean60,
        # the published slope runs against time: a rising line gives a negative value
        "slope20": -fr(F.regr_slope(lp, F.col("t").cast("double")), n, 20),
        "cross_ret1": ru,
        "cross_ret5": moved(lu, nu, 5),
        "cross_ret20": moved(lu, nu, 20),
        "cross_vol20": sd(ru, lu, nu, 20),
        "implied_mom5": moved(li, nur, 5),
        "implied_mom20": moved(li, nur, 20),
        "cross_corr60": corr(r, ru, lp, lu, nur, 60),
        "cross_beta60": cov(r, ru, lp, lu, nur, 60) / (var(ru, lu, nu, 60) + 1e-12),
        "oil_ret1": ro,
        "oil_ret5": moved(lo, no, 5),
        "oil_ret20": moved(lo, no, 20),
        "oil_vol20": sd(ro, lo, no, 20),
        "oil_vol_ratio": sd(ro, lo, no, 5) / (sd(ro, lo, no, 60) + 1e-12),
        "oil_corr60": corr(r, ro, lp, lo, nor, 60),
        "sentiment_7d": mean(7),
        "sentiment_30d": mean(30),
        "sentiment_trend": mean(7) - mean(30),
        "rate_change": F.coalesce(rate - F.lag(rate).over(w), F.lit(0.0)),
        "rate_change_60d": F.coalesce(rate - F.lag(rate, 60).over(w), F.lit(0.0)),
    }
    wanted = set(ALL if keep is None else keep)
    out = base.withColumns({c: x for c, x in cols.items() if c in wanted})
    return out.drop("_past", "_blk", "_gain", "_loss", "_pgain", "_ploss", "_n", "_nr", "_nu", "_no",
                    "_nur", "_nor")


def unpivot(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """(keys, feature, value): one group per feature, so per-feature work spreads out."""
    return df.select(*keys, *[F.col(f).cast("double") for f in features]).unpivot(
        keys, features, "feature", "value")
