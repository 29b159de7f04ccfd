"""Expanding-window out-of-sample walk-forwards.

The sequential rule "first admit the samples whose outcome just became known, then
decide" is one frame: everything up to N rows ago. Horizons are computed side by side on
the same series order and only then turned into rows, so four horizons need no more
shuffles than one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom import params as P
from walkloom.functions import scalars as X
from walkloom.functions.frames import SERIES, series_window, upto
from walkloom.operators import features as feat
from walkloom.operators import joins as J
from walkloom.operators import signals as S

WALK_FEATURES = list(feat.ALL)


# --------------------------------------------------------------------------- inputs

def direction_inputs(aligned: DataFrame, by=SERIES, with_confirms: bool = False) -> DataFrame:
    """Aligned table + features + validity + composite reversion + market z."""
    df = feat.build(aligned, by)
    df = S.composite_reversion(S.valid_rows(df, WALK_FEATURES, by), by)
    df = S.market_z(df, by)
    if with_confirms:
        df = S.range_median(df, by)
    df = S.market_position(df, by)
    return S.confirms6(df, by) if with_confirms else df


# ------------------------------------------------------------------ mean reversion

def _as_column(horizon: int | Column) -> Column:
    return F.lit(horizon) if isinstance(horizon, int) else horizon


def reversion_parts(horizon: int | Column) -> dict[str, Column]:
    """mid probability, mid confidence, blend weight and cross confirmation."""
    score = F.col("score")
    confirmed = ((_as_column(horizon) >= 30) & F.col("cross_ret20").isNotNull()
                 & ((score > 0) == (F.col("cross_ret20") > 0)))
    mid = 0.5 + 0.06 * X.clip(score, -2.0, 2.0)
    mid = X.clip(F.when(confirmed, 0.5 + (mid - 0.5) * 1.2).otherwise(mid), 0.0, 1.0)
    return {"mid": mid, "blend": X.clip(F.col("strength") - 1.0, 0.0, 1.0),
            "mr_confirmed": F.coalesce(confirmed, F.lit(False)).cast("int")}


def reversion_decision(rows: DataFrame, base: Column) -> DataFrame:
    """Adds the reversion decision to long rows with a ``horizon`` column.

    mid_conf, blend, mr_pred, mr_conf, mr_up, mr_signal, mr_confirms; flat (0, .5) on
    invalid rows. ``base`` is the calibrated rate that strong scores blend towards.
    """
    valid, strong = F.col("is_valid"), F.col("strength") >= 1.0
    df = rows.withColumns(reversion_parts(F.col("horizon")))
    df = df.withColumn("mid_conf", F.greatest("mid", 1 - F.col("mid")))
    df = df.withColumn("_mr", F.col("mid_conf") * (1 - F.col("blend")) + base * F.col("blend"))
    df = df.withColumn("_up", F.when(~strong, F.col("mid")).when(F.col("score") > 0, F.col("_mr"))
                       .otherwise(1 - F.col("_mr")))
    return df.withColumns({
        "mr_pred": F.when(valid & (F.col("_up") > 0.5), 1).otherwise(0),
        "mr_conf": F.when(valid, F.round("_mr", 3)).otherwise(0.5),
        "mr_up": F.when(valid, F.col("_up")).otherwise(0.5),
        "mr_signal": F.when(valid, F.when(strong, "meanrev_strong").otherwise("meanrev_medium"))
                      .otherwise("flat"),
        "mr_confirms": F.when(valid, F.col("mr_confirmed"))}).drop("_mr", "_up", "mid", "mr_confirmed")


def strong_first(horizon: int | Column) -> Column:
    """Horizons in [30, 90) prefer a strong reversion over the market spread."""
    n = _as_column(horizon)
    return F.coalesce((n >= 30) & (n < 90) & F.col("is_valid") & (F.col("strength") >= 1.0),
                      F.lit(False))


def per_horizon(df: DataFrame, horizons, cols: list[str], **values) -> DataFrame:
    """One row per horizon: the ``cols``, ``horizon`` and per-horizon values (name -> function
    of the horizon). Decisions are then written once, not once per horizon."""
    cells = F.array(*[F.struct(F.lit(n).alias("horizon"),
                               *[_value(fn(n)).alias(k) for k, fn in values.items()])
                      for n in horizons])
    return df.select(*cols, F.explode(cells).alias("_h")).select(*cols, "_h.*")


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# -------------------------------------------------------------- direction walk-forward

def oos_bucket_rates(horizon: int, w, sample: Column, hit: Column, bucket: Column) -> dict:
    """Rates of the four |z| buckets over samples realised at the row; defaults below 20."""
    frame = upto(w, horizon)
    out = {}
    for b in P.Z7_BUCKETS:
        mine = sample & (bucket == b)
        n = F.sum(F.when(mine, 1).otherwise(0)).over(frame)
        hits = F.sum(F.when(mine & hit, 1).otherwise(0)).over(frame)
        out[b] = F.when(n >= P.MIN_BUCKET_N, F.round(hits / n, 4)).otherwise(
            P.DEFAULT_BUCKET_RATE[horizon][b])
    return out


def _replay_strong(horizon_default: dict, min_n: int = P.MIN_BUCKET_N):
    """Fill strong-reversion rows: their confidence uses the hit rate of earlier strong
    rows, and a rate below one half turns the direction, so the rows depend on each other.

    The inner function refers to plain values only, so workers need not import this package.
    """

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").reset_index(drop=True)
        slim = pdf.drop(columns=["mid_conf", "blend", "score"])
        at = np.flatnonzero((pdf["signal"] == "meanrev_strong").to_numpy())
        if not len(at):
            return slim
        horizon = int(pdf["horizon"].iloc[0])
        t, actual, mid, blend, score = (pdf[c].to_numpy()[at] for c in (
            "t", "actual", "mid_conf", "blend", "score"))
        preds, confs = slim["pred"].to_numpy(copy=True), slim["conf"].to_numpy(copy=True)
        hit = np.zeros(len(at), dtype=bool)
        hits = known = 0
        for i in range(len(at)):
            while t[known] + horizon <= t[i]:
                hits += int(hit[known])
                known += 1
            base = round(hits / known, 4) if known >= min_n else horizon_default[horizon]
            conf = mid[i] * (1 - blend[i]) + base * blend[i]
            pred = int((conf if score[i] > 0 else 1 - conf) > 0.5)
            hit[i] = pred == actual[i]
            preds[at[i]], confs[at[i]] = pred, round(conf, 3)
        return slim.assign(pred=preds, conf=confs)

    return replay


def direction_decisions(inputs: DataFrame, horizons=P.HORIZONS, by=SERIES) -> DataFrame:
    """One row per (series, date, horizon) of the walk-forward with its known outcome."""
    by = list(by)
    w = series_window(by)
    df = J.forward_outcome(inputs, horizons, by).withColumn("_zb", X.z_bucket7(F.col("z")))
    z, az = F.col("z"), F.abs("z")
    up = F.when(z > 0, 1).otherwise(0)
    rates = {}
    for n in horizons:
        is_market = z.isNotNull() & ~strong_first(n)
        sample = is_market & (F.col("t") >= F.col("first_row")) & F.col(f"actual_{n}").isNotNull()
        for b, rate in oos_bucket_rates(n, w, sample, up == F.col(f"actual_{n}"),
                                        F.col("_zb")).items():
            rates[f"rate_{n}_{b}"] = rate
    df = df.withColumns(rates)
    df = df.where(F.col("t") >= F.col("first_row"))
    long = per_horizon(
        df, horizons, [*by, "date", "t", "z", "is_valid", "score", "strength", "cross_ret20"],
        actual=lambda n: F.col(f"actual_{n}"), base=P.DEFAULT_REVERSION_RATE.get,
        **{f"rate_{b}": (lambda n, b=b: F.col(f"rate_{n}_{b}")) for b in P.Z7_BUCKETS})
    long = reversion_decision(long.where(F.col("actual").isNotNull()), F.col("base"))
    strong = strong_first(F.col("horizon"))
    market = ~strong & z.isNotNull()
    conf = X.confidence7(az, {b: F.col(f"rate_{b}") for b in P.Z7_BUCKETS})
    long = long.select(
        *by, "date", "t", "horizon",
        F.when(strong, "meanrev_strong").when(z.isNotNull(), "moex_dev").otherwise("mean_rev")
        .alias("signal"),
        F.when(market, up).otherwise(F.col("mr_pred")).alias("pred"),
        F.when(market, conf).otherwise(F.col("mr_conf")).alias("conf"),
        "actual", "mid_conf", "blend", "score")
    if not any(30 <= n < 90 for n in horizons):
        return long.drop("mid_conf", "blend", "score")
    keep = [c for c in long.columns if c not in ("mid_conf", "blend", "score")]
    types = {f.name: f.dataType.simpleString() for f in long.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return long.groupBy(*by, "horizon").applyInPandas(
        _replay_strong(P.DEFAULT_REVERSION_RATE), schema)


def direction_report(decisions: DataFrame, by=SERIES,
                     threshold: float = P.CONFIDENT_THRESHOLD) -> DataFrame:
    """Hit rates per horizon: all, confident, majority baseline, market rows only."""
    hit = (F.col("pred") == F.col("actual")).cast("double")
    sure = F.col("conf") > threshold
    market = F.col("signal") == "moex_dev"
    count = lambda c: F.count_if(c)
    rate = lambda c: F.coalesce(F.round(F.avg(F.when(c, hit)), 4), F.lit(0.0))
    n = F.count(F.lit(1))
    ups = F.sum("actual")
    return decisions.groupBy(*by, "horizon").agg(
        n.alias("windows"), rate(F.lit(True)).alias("accuracy"),
        rate(sure).alias("confident_accuracy"), count(sure).alias("confident_windows"),
        F.round(count(sure) / n, 4).alias("confident_ratio"),
        F.round(F.greatest(ups, n - ups) / n, 4).alias("baseline_majority"),
        rate(market).alias("market_accuracy"), count(market).alias("market_windows"),
        rate(market & sure).alias("market_confident_accuracy"),
        count(market & sure).alias("market_confident_windows"))


# ------------------------------------------------------------------- long horizons

def _pool_rate(by, horizon: int, sample: Column, hit: Column) -> tuple[Column, Column]:
    """(n, rate) of the row's own reversion bucket over samples realised at the row.

    Inside a (series, bucket) partition rows are sparse, so the frame is a RANGE on the
    row position.
    """
    frame = Window.partitionBy(*by, "bucket").orderBy("t").rangeBetween(
        Window.unboundedPreceding, -horizon)
    n = F.sum(F.when(sample, 1).otherwise(0)).over(frame)
    hits = F.sum(F.when(sample & hit, 1).otherwise(0)).over(frame)
    return F.coalesce(n, F.lit(0)), F.try_divide(hits, n)


def long_decisions(signals: DataFrame, policy: dict[int, str] | None = None,
                   by=SERIES) -> DataFrame:
    """Walk-forward decisions of the long-horizon policies.

    ``signals`` comes from ``signals.long_signals``. One row per evaluable day and
    horizon: eligible, emitted, pred (NULL when silent), actual, used_conf, experimental.
    """
    policy = policy or P.LONG_POLICY
    by = list(by)
    rev, z = F.col("rev"), F.col("z60")
    has_z = z.isNotNull()
    rev_up = F.when(rev > 0, 1).otherwise(0)
    z_up = F.when(z > 0, 1).otherwise(0)
    confirmed = F.coalesce(X.sign_of(z) == X.sign_of(rev), F.lit(False))
    df = J.forward_outcome(signals, policy, by)
    pools = {}
    for n, name in policy.items():
        sample = (F.col("t") >= P.WARMUP) & (F.col("bucket") >= 0) & F.col(f"actual_{n}").isNotNull()
        hit = rev_up == F.col(f"actual_{n}")
        wanted = {}
        if name in ("dual_pool", "resonance_only"):
            wanted = {"plain": sample, "confirmed": sample & confirmed}
        elif name == "weak_experimental":
            wanted = {"weak": sample & F.col("high_vol")}
        for pool, cond in wanted.items():
            pools[f"{pool}_n_{n}"], pools[f"{pool}_rate_{n}"] = _pool_rate(by, n, cond, hit)
    if pools:
        df = df.withColumns(pools)
    rows = []
    for n, name in policy.items():
        eligible, used, experimental = F.lit(True), F.lit(False), F.lit(name == "weak_experimental")
        if name == "pure_rev":
            pred = rev_up
        elif name == "moex_z":
            pred = F.when(has_z, F.when(F.col("gate") >= P.GATE_MIN_CONFIRMS, z_up)).otherwise(rev_up)
        elif name in ("breakout", "extreme_dist"):
            pred = F.col("breakout" if name == "breakout" else "extreme")
        elif name == "weak_experimental":
            eligible = F.col("high_vol")
            ok = (F.col(f"weak_n_{n}") >= P.MIN_BUCKET_N) & (F.col(f"weak_rate_{n}") >= P.WEAK_GATE)
            pred = F.when(eligible & ok, rev_up)
        elif name in ("dual_pool", "resonance_only"):
            used = confirmed
            cell = lambda v: F.when(confirmed, F.col(f"confirmed_{v}_{n}")).otherwise(
                F.col(f"plain_{v}_{n}"))
            ok = (cell("n") >= P.MIN_BUCKET_N) & (cell("rate") >= P.LONG_GATE)
            ok = ok & confirmed if name == "resonance_only" else ok
            pred = F.when(ok, rev_up)
        elif name == "off":
            pred = F.lit(None).cast("int")
        else:
            raise ValueError(f"unknown policy {name!r}")
        rows.append(F.struct(
            F.lit(n).alias("horizon"), F.lit(name).alias("policy"), eligible.alias("eligible"),
            pred.cast("int").alias("pred"), F.col(f"actual_{n}").alias("actual"),
            used.alias("used_conf"), experimental.alias("experimental")))
    carried = [c for c in ("rev", "z60", "gate", "bucket", "high_vol") if c in df.columns]
    return (df.where((F.col("t") >= P.WARMUP) & (F.col("bucket") >= 0))
            .select(*by, "date", "t", *carried, F.explode(F.array(*rows)).alias("d"))
            .select(*by, "date", "t", *carried, "d.*").where(F.col("actual").isNotNull())
            .withColumn("confirmed", confirmed)
            .withColumn("emitted", F.col("pred").isNotNull())
            .withColumn("hit", (F.col("pred") == F.col("actual")).cast("int")))


def era_of(date: Column, eras=P.DEFAULT_ERAS) -> Column:
    """Name of the first era containing the date, NULL outside all of them."""
    within = [(date >= F.lit(lo).cast("date")) & (date < F.lit(hi).cast("date"))
              for _, lo, hi in eras]
    out = F.when(within[0], eras[0][0])
    for cond, (name, _, _) in zip(within[1:], eras[1:]):
        out = out.when(cond, name)
    return out


def long_report(decisions: DataFrame, eras=P.DEFAULT_ERAS, by=SERIES) -> DataFrame:
    """Per horizon: coverage, out-of-sample hit, gates, pools, and the last era's hit."""
    emitted = F.col("emitted")
    hit = F.when(emitted, F.col("hit").cast("double"))
    n_emit, n_elig = F.count_if(emitted), F.count_if(F.col("eligible"))
    oos = F.avg(hit)
    modern = era_of(F.col("date"), eras) == eras[-1][0]
    out = decisions.groupBy(*by, "horizon", "policy").agg(
        n_emit.alias("oos_emitted"), n_elig.alias("eligible_days"), oos.alias("_oos"),
        F.avg(F.when(F.col("used_conf"), hit)).alias("_conf_hit"),
        F.count_if(emitted & F.col("used_conf")).alias("confirmed_n"),
        F.avg(F.when(F.col("experimental"), hit)).alias("_weak_hit"),
        F.count_if(emitted & F.col("experimental")).alias("weak_n"),
        F.avg(F.when(modern, hit)).alias("_modern"),
        F.count_if(emitted & modern).alias("modern_n"))
    coverage = F.coalesce(F.try_divide("oos_emitted", "eligible_days"), F.lit(0.0))
    passed = F.coalesce((F.col("_oos") >= P.LONG_GATE) & (F.col("oos_emitted") >= 100)
                        & ~F.col("policy").isin("off", "weak_experimental"), F.lit(False))
    return out.select(
        *by, "horizon", "policy", "oos_emitted", "eligible_days",
        F.round("_oos", 4).alias("oos_hit"), F.round(coverage, 4).alias("coverage"),
        F.round("_conf_hit", 4).alias("confirmed_hit"), "confirmed_n",
        F.round("_weak_hit", 4).alias("weak_hit"), "weak_n",
        F.round("_modern", 4).alias("modern_hit"), "modern_n",
        passed.alias("passed_gate"), (passed & (coverage >= 0.30)).alias("full_protocol"),
        (~passed).alias("experimental"))


def long_era_table(decisions: DataFrame, eras=P.DEFAULT_ERAS, by=SERIES) -> DataFrame:
    emitted = decisions.where("emitted").withColumn("era", era_of(F.col("date"), eras))
    return (emitted.where(F.col("era").isNotNull()).groupBy(*by, "horizon", "policy", "era")
            .agg(F.round(F.avg("hit"), 4).alias("hit"), F.count(F.lit(1)).alias("n")))


def bucket_tables(decisions: DataFrame, by=SERIES) -> DataFrame:
    """Reversion-bucket hits over all realised rows by pool: plain, confirmed, weak."""
    pools = F.array_compact(F.array(
        F.lit("plain"), F.when(F.col("confirmed"), F.lit("confirmed")),
        F.when((F.col("policy") == "weak_experimental") & F.col("high_vol"), F.lit("weak"))
        if "high_vol" in decisions.columns else F.lit(None).cast("string")))
    rev_hit = (F.when(F.col("rev") > 0, 1).otherwise(0) == F.col("actual")).cast("int")
    return (decisions.withColumn("pool", F.explode(pools)).withColumn("_hit", rev_hit)
            .groupBy(*by, "horizon", "pool", "bucket")
            .agg(F.sum("_hit").alias("wins"), F.count(F.lit(1)).alias("n"))
            .withColumn("rate", F.round(F.col("wins") / F.col("n"), 4))
            .withColumn("bucket_name", X.rev_bucket_name(F.col("bucket"))))


def gate_tables(decisions: DataFrame, by=SERIES) -> DataFrame:
    """30-row spread policy: passed-gate hits per |z| bucket, gate failures, no-market rows."""
    rows = decisions.where(F.col("policy") == "moex_z")
    has_z = F.col("z60").isNotNull()
    passed = F.col("gate") >= P.GATE_MIN_CONFIRMS
    cell = F.when(~has_z, "rev_fallback").when(~passed, "gate_failed").otherwise(
        X.z_bucket30(F.col("z60")))
    direction = F.when(has_z, F.col("z60")).otherwise(F.col("rev"))
    hit = (F.when(direction > 0, 1).otherwise(0) == F.col("actual")).cast("int")
    return (rows.withColumn("cell", cell).withColumn("_hit", hit)
            .groupBy(*by, "horizon", "cell")
            .agg(F.sum("_hit").alias("wins"), F.count(F.lit(1)).alias("n"))
            .withColumn("rate", F.round(F.col("wins") / F.col("n"), 4)))
