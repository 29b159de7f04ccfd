"""Bucket calibration over full history, monotone pooling, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkloom import params as P
from walkloom.functions import scalars as X
from walkloom.functions.frames import SERIES
from walkloom.operators import backtest as B
from walkloom.operators import joins as J


def default_rates(spark: SparkSession) -> DataFrame:
    """Built-in default table: 16 literal rows (horizon, bucket, default_rate)."""
    rows = [(n, b, r) for n, table in P.DEFAULT_BUCKET_RATE.items() for b, r in table.items()]
    return spark.createDataFrame(rows, "horizon int, bucket string, default_rate double")


def bucket_counts(inputs: DataFrame, horizons=P.HORIZONS, by=SERIES) -> DataFrame:
    """(series, horizon, bucket, hits, n) of market-spread rows; all four buckets present."""
    df = J.forward_outcome(inputs, horizons, by).where(F.col("t") >= F.col("first_row"))
    z = F.col("z")
    long = B.per_horizon(df, horizons, [*by, "z", "is_valid", "strength"],
                         actual=lambda n: F.col(f"actual_{n}"))
    long = long.where(F.col("actual").isNotNull()).withColumn(
        "is_market", z.isNotNull() & ~B.strong_first(F.col("horizon")))
    hit = F.when(z > 0, 1).otherwise(0) == F.col("actual")
    zb = X.z_bucket7(z)
    mine = lambda b: F.col("is_market") & (zb == b)
    wide = long.groupBy(*by, "horizon").agg(
        *[F.count_if(mine(b)).alias(f"n_{b}") for b in P.Z7_BUCKETS],
        *[F.count_if(mine(b) & hit).alias(f"hits_{b}") for b in P.Z7_BUCKETS])
    cells = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"hits_{b}").alias("hits"),
                               F.col(f"n_{b}").alias("n")) for b in P.Z7_BUCKETS])
    return wide.select(*by, "horizon", F.explode(cells).alias("c")).select(*by, "horizon", "c.*")


def pool_monotonic(rates: DataFrame, by=SERIES) -> DataFrame:
    """Neighbouring buckets out of order get their pooled rate when a two-proportion test
    cannot tell them apart (|z| < 1.96, both with 20 cases); real differences stay.

    A group is the four buckets of one (series, horizon). The up to four passes over
    three neighbour pairs are one fold over twelve steps.
    """
    keys = [*by, "horizon"]
    cell = F.struct("bucket", "rate", "hits", "n")
    grouped = rates.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("c"))
    pick = lambda name: F.transform("c", lambda x: x[name])
    grouped = grouped.select(*keys, pick("bucket").alias("b"), pick("rate").alias("r0"),
                             pick("hits").alias("h"), pick("n").alias("n"))

    def step(rate, i):
        lo = i % 3
        hi = lo + 1
        at = lambda arr, k: F.get(arr, k)
        h, n = F.col("h"), F.col("n")
        p_lo, p_hi = (F.try_divide(at(h, k), at(n, k)) for k in (lo, hi))
        var = F.try_divide(p_lo * (1 - p_lo), at(n, lo)) + F.try_divide(p_hi * (1 - p_hi), at(n, hi))
        same = (at(n, lo) >= P.MIN_BUCKET_N) & (at(n, hi) >= P.MIN_BUCKET_N) & (var > 0) & (
            F.abs(F.try_divide(p_hi - p_lo, F.sqrt(var))) < 1.96)
        pooled = F.round(F.try_divide(at(h, lo) + at(h, hi), at(n, lo) + at(n, hi)), 4)
        merge = F.coalesce((at(rate, hi) < at(rate, lo)) & same, F.lit(False))
        return F.transform(rate, lambda v, k: F.when(merge & ((k == lo) | (k == hi)), pooled)
                           .otherwise(v))

    folded = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.col("r0"), step)
    return (grouped.withColumn("rate", folded)
            .select(*keys, F.explode(F.arrays_zip("b", "rate", "h", "n", "r0")).alias("x"))
            .select(*keys, F.col("x.b").alias("bucket"), F.col("x.h").alias("hits"),
                    F.col("x.n").alias("n"), F.col("x.r0").alias("raw_rate"),
                    F.col("x.rate").alias("rate")))


def market_buckets(inputs: DataFrame, horizons=P.HORIZONS, by=SERIES) -> DataFrame:
    """Calibrated rate per (series, horizon, |z| bucket)."""
    counts = bucket_counts(inputs, horizons, by)
    rated = J.measured_or_default(counts, default_rates(inputs.sparkSession),
                                  ["horizon", "bucket"], P.MIN_BUCKET_N)
    return pool_monotonic(rated, by)


def reversion_rates(inputs: DataFrame, horizons=P.HORIZONS, by=SERIES) -> DataFrame:
    """Hit rate of strong-reversion rows with default confidence; rate NULL below 20 cases."""
    df = J.forward_outcome(inputs, horizons, by).where(
        (F.col("t") >= F.col("first_row")) & F.col("is_valid") & (F.col("strength") >= 1.0))
    long = B.per_horizon(df, horizons, [*by, "score", "strength", "is_valid", "cross_ret20"],
                         actual=lambda n: F.col(f"actual_{n}"), base=P.DEFAULT_REVERSION_RATE.get)
    long = B.reversion_decision(long.where(F.col("actual").isNotNull()), F.col("base"))
    return (long.groupBy(*by, "horizon")
            .agg(F.count_if(F.col("mr_pred") == F.col("actual")).alias("hits"),
                 F.count(F.lit(1)).alias("n"))
            .withColumn("rate", F.when(F.col("n") >= P.MIN_BUCKET_N,
                                       F.round(F.col("hits") / F.col("n"), 4))))


def freshness(tables: DataFrame, run_ts, max_age_sec: int) -> DataFrame:
    """age_sec and is_usable (0 <= age <= limit) for tables with ``generated_ts``."""
    age = F.unix_timestamp(run_ts) - F.unix_timestamp("generated_ts")
    return tables.withColumn("age_sec", age).withColumn(
        "is_usable", F.coalesce((age >= 0) & (age <= max_age_sec), F.lit(False)))


def usable_rates(calibration: DataFrame, run_ts, by=SERIES) -> DataFrame:
    """Calibrated rates while fresh, the built-in defaults once stale."""
    checked = freshness(calibration, run_ts, P.CALIBRATION_MAX_AGE_SEC)
    joined = checked.join(F.broadcast(default_rates(calibration.sparkSession)),
                          ["horizon", "bucket"], "left")
    return joined.withColumn("rate", F.when(F.col("is_usable"), F.col("rate"))
                             .otherwise(F.col("default_rate"))).drop("default_rate")
