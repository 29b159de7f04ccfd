"""Current decisions: last row of every series, per horizon, with calibrated confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walkloom import params as P
from walkloom.functions import scalars as X
from walkloom.functions.frames import SERIES
from walkloom.operators import backtest as B


def last_rows(df: DataFrame, by=SERIES) -> DataFrame:
    """The newest row of every series."""
    newest = F.max("t").over(Window.partitionBy(*by))
    return df.withColumn("_last", newest).where(F.col("t") == F.col("_last")).drop("_last")


def market_direction(inputs: DataFrame, horizons=P.HORIZONS, by=SERIES,
                     rates: DataFrame | None = None,
                     reversion: DataFrame | None = None) -> DataFrame:
    """Direction per row and horizon in order of precedence: strong reversion for horizons
    in [30, 90), market spread, reversion fallback.

    ``rates`` (series, horizon, bucket, rate) and ``reversion`` (series, horizon, rate) are
    calibration tables; without them the built-in defaults apply.
    """
    z = F.col("z")
    shown = [*by, "date", "z", "score", "strength", "is_valid"]
    shown += ["confirms"] if "confirms" in inputs.columns else []
    df = B.per_horizon(inputs, horizons, [*shown, "cross_ret20"],
                       d_mr=P.DEFAULT_REVERSION_RATE.get,
                       **{f"d_{b}": (lambda n, b=b: P.DEFAULT_BUCKET_RATE[n][b]) for b in P.Z7_BUCKETS})
    keys = [*by, "horizon"]
    rate = {b: F.col(f"d_{b}") for b in P.Z7_BUCKETS}
    if rates is not None:
        wide = rates.groupBy(*keys).agg(*[
            F.max(F.when(F.col("bucket") == b, F.col("rate"))).alias(f"c_{b}") for b in P.Z7_BUCKETS])
        df = df.join(wide, keys, "left")
        rate = {b: F.coalesce(f"c_{b}", f"d_{b}") for b in P.Z7_BUCKETS}
    base = F.col("d_mr")
    if reversion is not None:
        df = df.join(reversion.select(*keys, F.col("rate").alias("c_mr")), keys, "left")
        base = F.coalesce("c_mr", "d_mr")
    strong = B.strong_first(F.col("horizon"))
    market = ~strong & z.isNotNull()
    df = B.reversion_decision(df, base).withColumn("_c7", X.confidence7(F.abs("z"), rate))
    df = df.withColumn("_pu", F.when(market, F.when(z > 0, F.col("_c7")).otherwise(1 - F.col("_c7")))
                       .otherwise(F.col("mr_up")))
    out = {
        "signal": F.when(strong, "meanrev_strong").when(z.isNotNull(), "moex_dev")
                   .otherwise("mean_rev"),
        "prediction": F.when(market, F.when(z > 0, 1).otherwise(0)).otherwise(F.col("mr_pred")),
        "confidence": F.when(market, F.col("_c7")).otherwise(F.col("mr_conf")),
        "prob_up": F.round("_pu", 3), "prob_down": F.round(1 - F.col("_pu"), 3),
        "z_bucket": F.when(market, X.z_bucket7(z)),
        "weak_signal": F.when(market, F.abs("z") < P.WEAK_Z),
    }
    return df.withColumns(out).select(*shown, "horizon", *out)


def usable_report(report: DataFrame, made: Column, run_ts: Column,
                  max_age: int = P.LONG_REPORT_MAX_AGE_SEC) -> DataFrame:
    """The rows of a long report that may be used at ``run_ts``: made at most ``max_age`` seconds before, and not
    after it. Horizons without a usable row are neutral in :func:`long_now`."""
    age = F.unix_timestamp(run_ts) - F.unix_timestamp(made)
    return report.where(F.coalesce((age >= 0) & (age <= max_age), F.lit(False)))


def long_now(signals: DataFrame, report: DataFrame, gates: DataFrame, buckets: DataFrame,
             policy: dict[int, str] | None = None, by=SERIES) -> DataFrame:
    """Last-row decision of the long-horizon policies.

    The confidence comes from the best source with enough cases; a reason is given when
    no direction can be stated. ``report`` may lack rows (stale or never made).
    """
    policy = policy or P.LONG_POLICY
    keys = [*by, "horizon"]
    plan = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(name).alias("policy"))
                     for n, name in policy.items()])
    now = last_rows(signals, by)
    hv = F.col("high_vol") if "high_vol" in now.columns else F.lit(False)
    now = now.select(*by, "date", "rev", "z60", "gate", "breakout", "extreme", "bucket",
                     hv.alias("high_vol"), F.explode(plan).alias("p")).select("*", "p.*").drop("p")
    rep = report.select(*keys, "oos_hit", "oos_emitted", "modern_hit", "passed_gate",
                        F.lit(True).alias("has_report"))
    cells = [*P.Z30_BUCKETS, "gate_failed", "rev_fallback"]
    g = gates.groupBy(*keys).agg(
        *[F.max(F.when(F.col("cell") == c, F.col(v))).alias(f"{c}_{v}")
          for c in cells for v in ("wins", "n", "rate")])
    b = buckets.groupBy(*keys, "bucket").agg(
        *[F.max(F.when(F.col("pool") == p, F.col(v))).alias(f"{p}_{v}")
          for p in ("plain", "confirmed", "weak") for v in ("wins", "n")])
    df = now.join(rep, keys, "left").join(g, keys, "left").join(b, [*keys, "bucket"], "left")

    rev, z, name = F.col("rev"), F.col("z60"), F.col("policy")
    has_z = z.isNotNull()
    rev_up, z_up = F.when(rev > 0, 1).otherwise(0), F.when(z > 0, 1).otherwise(0)
    era = F.coalesce("modern_hit", "oos_hit")
    num = lambda c: F.coalesce(F.col(f"{c}_n"), F.lit(0))
    agg_n = sum((num(c) for c in P.Z30_BUCKETS), F.lit(0))
    agg_w = sum((F.coalesce(F.col(f"{c}_wins"), F.lit(0)) for c in P.Z30_BUCKETS), F.lit(0))
    own_n = F.when(X.z_bucket30(z) == "z00", num("z00")).when(X.z_bucket30(z) == "z03", num("z03")) \
        .when(X.z_bucket30(z) == "z05", num("z05")).otherwise(num("z10"))
    curve = X.confidence30(F.abs(z), {c: F.col(f"{c}_rate") for c in P.Z30_BUCKETS})
    gate_ok = F.col("gate") >= P.GATE_MIN_CONFIRMS
    m = P.MIN_BUCKET_N
    source = (F.when(has_z & gate_ok & (own_n >= m), "z_bucket_dynamic")
              .when(has_z & gate_ok & (agg_n >= m), "moex_aggregate_dynamic")
              .when(has_z & ~gate_ok & (num("gate_failed") >= m), "gate_failed_dynamic")
              .when(~has_z & (num("rev_fallback") >= m), "rev_fallback_dynamic")
              .otherwise("modern_oos_hit"))
    z_conf = (F.when(source == "z_bucket_dynamic", curve)
              .when(source == "moex_aggregate_dynamic", F.try_divide(agg_w, agg_n))
              .when(source == "gate_failed_dynamic", F.col("gate_failed_rate"))
              .when(source == "rev_fallback_dynamic", F.col("rev_fallback_rate"))
              .otherwise(era))
    z_n = (F.when(source == "z_bucket_dynamic", own_n)
           .when(source == "moex_aggregate_dynamic", agg_n)
           .when(source == "gate_failed_dynamic", num("gate_failed"))
           .when(source == "rev_fallback_dynamic", num("rev_fallback"))
           .otherwise(F.col("oos_emitted")))
    resonates = F.coalesce(X.sign_of(z) == X.sign_of(rev), F.lit(False))
    weak_pool = (name == "weak_experimental") & F.col("high_vol")
    pool = lambda v: F.when(weak_pool, F.col(f"weak_{v}")).when(
        (name != "weak_experimental") & resonates, F.col(f"confirmed_{v}")).otherwise(
        F.col(f"plain_{v}"))
    bucket_rate = F.try_divide(pool("wins"), pool("n"))
    sig = F.when(name == "breakout", F.col("breakout")).when(name == "extreme_dist", F.col("extreme"))
    is_z, is_ext = name == "moex_z", name.isin("breakout", "extreme_dist")
    is_rev = name == "pure_rev"
    df = df.withColumns({
        "_conf": F.when(is_z, z_conf).when(is_rev | is_ext, era)
                  .otherwise(F.coalesce(F.col("oos_hit"), bucket_rate)),
        "_pred": F.when(is_z & has_z, z_up).when(is_ext, sig).otherwise(rev_up),
        "_n": F.when(is_z, z_n).when(is_rev | is_ext, F.col("oos_emitted"))
               .otherwise(F.coalesce(pool("n"), F.lit(0))),
        "_source": F.when(is_z, source).when(is_rev | is_ext, "modern_oos_hit")
                    .otherwise(F.when(F.col("oos_hit").isNotNull(), "rule_oos_hit")
                               .otherwise("bucket_rate")),
        "_brate": F.when(~(is_z | is_rev | is_ext), F.round(bucket_rate, 3))})
    reason = (F.when(F.col("has_report").isNull(), "calibration_unavailable")
              .when(name == "off", "no_validated_signal")
              .when(F.col("bucket") < 0, "insufficient_history")
              .when(is_ext & (sig.isNull() | F.col("_conf").isNull()), "no_validated_signal")
              .when(F.col("_conf").isNull(), "no_measurable_rate"))
    df = df.withColumn("neutral_reason", reason)
    stated = F.col("neutral_reason").isNull()
    conf = F.col("_conf")
    out = {
        "prediction": F.when(stated, F.col("_pred")),
        "confidence": F.when(stated, F.round("_conf", 3)),
        "prob_up": F.when(stated, X.prob_up(F.col("_pred"), conf)),
        "prob_down": F.when(stated, X.prob_down(F.col("_pred"), conf)),
        "signal": F.when(stated & is_z & has_z, "moex_spread").when(stated & is_ext, name)
                   .otherwise("long_reversion"),
        "experimental": F.when(stated, ~F.coalesce("passed_gate", F.lit(False))),
        "confidence_source": F.when(stated, F.col("_source")),
        "case_n": F.when(stated, F.col("_n").cast("bigint")),
        "bucket_rate": F.when(stated, F.col("_brate")),
        "strength_bucket": F.when(stated & is_z & has_z, X.z_bucket30(z)).when(
            stated & ~(is_z | is_rev | is_ext), X.rev_bucket_name(F.col("bucket"))),
        "gate_confirms": F.when(stated & is_z, F.col("gate")),
        "gate_passed": F.when(stated & is_z, has_z & gate_ok),
        "neutral": ~stated,
    }
    df = df.withColumns(out)
    return df.select(*by, F.col("date").alias("as_of"), "horizon", "policy", *out,
                     "neutral_reason", "modern_hit", F.round("rev", 3).alias("rev"),
                     F.round("z60", 3).alias("z"))


def term_divergence(directions: DataFrame, by=SERIES) -> DataFrame:
    """First shorter horizon whose direction contradicts the horizon's own."""
    # a group holds one direction per horizon, four at most
    said = F.array_sort(F.collect_list(F.struct("horizon", "prediction")))
    grouped = (directions.where(F.col("prediction").isin(0, 1))
               .groupBy(*by).agg(said.alias("said")))
    own = grouped.select(*by, "said", F.explode("said").alias("own")).select(*by, "said", "own.*")
    first = F.get(F.filter("said", lambda x: (x["horizon"] < F.col("horizon"))
                           & (x["prediction"] != F.col("prediction"))), F.lit(0))["horizon"]
    return (own.withColumn("short_horizon", first).where(F.col("short_horizon").isNotNull())
            .select(*by, "horizon", "prediction", "short_horizon"))
