"""Signal health: realised hit rate of the last year against thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkloom import params as P
from walkloom.functions.frames import SERIES
from walkloom.operators import joins as J


def thresholds(spark) -> DataFrame:
    """Literal table of four rows."""
    return spark.createDataFrame([(n, h, a) for n, (h, a) in P.HEALTH_THRESHOLDS.items()],
                                 "horizon int, healthy double, alert double")


def evaluated_rows(market_signals: DataFrame, decisions: DataFrame, by=SERIES) -> DataFrame:
    """(by, date, horizon, hit) of realised predictions.

    Horizon 7 uses rows with a market price of the same day; longer ones the emitted
    decisions of their policy.
    """
    seven = (J.forward_outcome(market_signals, [7], by)
             .where(F.col("z_own").isNotNull() & F.col("actual_7").isNotNull())
             .select(*by, "date", F.lit(7).alias("horizon"),
                     (F.when(F.col("z_own") > 0, 1).otherwise(0) == F.col("actual_7"))
                     .cast("int").alias("hit")))
    longer = decisions.where("emitted").select(*by, "date", "horizon", "hit")
    return seven.unionByName(longer)


def status(evaluated: DataFrame, calendar: DataFrame, window_days: int = P.HEALTH_WINDOW_DAYS,
           by=SERIES) -> DataFrame:
    """Status per (series, horizon); series without recent rows report no_data.

    ``calendar`` is the official panel: the window ends at its newest date.
    """
    spark = evaluated.sparkSession
    ends = calendar.groupBy(*by).agg(F.max("date").alias("_today"))
    recent = (evaluated.join(ends, list(by))
              .where(F.col("date") >= F.date_sub("_today", window_days)))
    stats = recent.groupBy(*by, "horizon").agg(
        F.avg("hit").alias("_acc"), F.count(F.lit(1)).alias("n"),
        F.min("date").alias("first_eval_date"), F.max("date").alias("last_eval_date"))
    horizons = F.array(*[F.lit(n) for n in P.HEALTH_THRESHOLDS])
    frame = (ends.select(*by, F.explode(horizons).alias("horizon"))
             .join(F.broadcast(thresholds(spark)), "horizon"))
    out = frame.join(stats, [*by, "horizon"], "left")
    acc = F.col("_acc")
    label = (F.when(acc.isNull(), "no_data").when(acc >= F.col("healthy"), "healthy")
             .when(acc >= F.col("alert"), "degraded").otherwise("alert"))
    return out.select(*by, "horizon", F.round("_acc", 4).alias("rolling_acc"),
                      F.coalesce("n", F.lit(0)).alias("n"), "first_eval_date", "last_eval_date",
                      label.alias("status"))


def overall(state: DataFrame, staleness: DataFrame | None = None, by=SERIES) -> DataFrame:
    """One verdict per series. ``staleness`` (horizon, is_stale) turns horizons with data and a
    stale calibration into alerts; it holds one row per horizon."""
    if staleness is not None:
        state = state.join(F.broadcast(staleness), "horizon", "left")
        forced = F.coalesce("is_stale", F.lit(False)) & (F.col("status") != "no_data")
        state = state.withColumn("status", F.when(forced, "alert").otherwise(F.col("status")))
    alert, degraded = (F.bool_or(F.col("status") == s) for s in ("alert", "degraded"))
    return state.groupBy(*by).agg(
        F.when(alert, "alert").when(degraded, "degraded").otherwise("healthy")
        .alias("overall_status"), alert.alias("any_alert"),
        F.count_if(F.col("status") == "alert").alias("alerts"))


def staleness(spark, run_ts: Column, calibrated_ts: Column, long_report_ts: Column) -> DataFrame:
    """(horizon, is_stale) from the age of the two calibration products."""
    age = lambda ts: F.unix_timestamp(run_ts) - F.unix_timestamp(ts)
    stale = lambda ts, limit, future: F.coalesce(
        (age(ts) > limit) | ((age(ts) < 0) & F.lit(future)), F.lit(True))
    base = spark.createDataFrame([(n,) for n in P.HEALTH_THRESHOLDS], "horizon int")
    return base.withColumn("is_stale", F.when(
        F.col("horizon") == 7, stale(calibrated_ts, P.CALIBRATION_MAX_AGE_SEC, True)).otherwise(
        stale(long_report_ts, P.LONG_REPORT_MAX_AGE_SEC, False)))


def prediction_card(directions: DataFrame, direction_report: DataFrame, long_report: DataFrame,
                    state: DataFrame, by=SERIES) -> DataFrame:
    """Current direction with its own model's overall and last-year hit rates."""
    keys = [*by, "horizon"]
    accuracy = direction_report.where(F.col("horizon") == 7).select(
        *keys, F.col("market_accuracy").alias("overall")).unionByName(
        long_report.select(*keys, F.col("oos_hit").alias("overall")))
    return (directions.join(accuracy, keys, "left")
            .join(state.select(*keys, F.col("rolling_acc").alias("rolling"),
                               F.col("n").alias("rolling_n"), "status"), keys, "left"))

