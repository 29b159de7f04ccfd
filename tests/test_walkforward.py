"""Walk-forwards against a plain sequential simulation, and truncation invariance."""

import numpy as np
import pandas as pd
import pytest

from tests.conftest import to_spark
from walkloom import params as P
from walkloom.operators import backtest as B
from walkloom.operators import chunks
from walkloom.operators import features as feat
from walkloom.operators import signals as S
from walkloom.session import materialise


@pytest.fixture(scope="module")
def inputs(aligned):
    return materialise(B.direction_inputs(aligned), "test-inputs")


@pytest.fixture(scope="module")
def decisions(inputs):
    return B.direction_decisions(inputs).toPandas()


def simulate(g, n):
    """Day by day: first learn outcomes that became known today, then decide."""
    lp, z, t0 = np.log(g["price"].to_numpy()), g["z"].to_numpy(float), int(g["first_row"].iloc[0])
    learned = {b: [0, 0] for b in P.Z7_BUCKETS}
    strong_seen, log, out = [0, 0], {}, {}
    for t in range(t0, len(g) - n):
        past = log.get(t - n)
        if past is not None:
            kind, pred = past
            cell = strong_seen if kind == "strong" else learned[kind]
            cell[0] += int(pred == int(lp[t] > lp[t - n]))
            cell[1] += 1
        row = g.iloc[t]
        valid, score = bool(row["is_valid"]), float(row["score"]) if row["is_valid"] else 0.0
        strong = valid and abs(score) >= 1
        base = (round(strong_seen[0] / strong_seen[1], 4) if strong_seen[1] >= 20
                else P.DEFAULT_REVERSION_RATE[n])
        mid = 0.5 + 0.06 * np.clip(score, -2, 2)
        if n >= 30 and valid and (score > 0) == (row["cross_ret20"] > 0):
            mid = 0.5 + (mid - 0.5) * 1.2
        blend = np.clip(abs(score) - 1, 0, 1)
        conf = max(mid, 1 - mid) * (1 - blend) + base * blend
        up = mid if not strong else (conf if score > 0 else 1 - conf)
        if strong and 30 <= n < 90:
            out[t] = ("meanrev_strong", int(up > 0.5), round(conf, 3))
            log[t] = ("strong", out[t][1])
        elif np.isfinite(z[t]):
            table = {b: round(h / k, 4) if k >= 20 else P.DEFAULT_BUCKET_RATE[n][b]
                     for b, (h, k) in learned.items()}
            az = abs(z[t])
            c = np.interp(az, [0, .5, 1, 1.5], [table[b] for b in P.Z7_BUCKETS])
            out[t] = ("moex_dev", int(z[t] > 0), round(float(np.clip(c, .5, .85)), 3))
            bucket = "z15" if az > 1.5 else "z10" if az > 1 else "z05" if az > .5 else "z00"
            log[t] = (bucket, out[t][1])
        else:
            out[t] = ("mean_rev", int(up > 0.5) if valid else 0, round(conf, 3) if valid else 0.5)
    return out


@pytest.mark.parametrize("n", P.HORIZONS)
def test_direction_walkforward_equals_simulation(inputs, decisions, n):
    frame = inputs.toPandas().sort_values(["series_id", "t"])
    strong_rows = 0
    for name, g in frame.groupby("series_id"):
        want = simulate(g.reset_index(drop=True), n)
        got = decisions[(decisions.series_id == name) & (decisions.horizon == n)]
        assert len(got) == len(want) > 0
        for row in got.itertuples():
            signal, pred, conf = want[row.t]
            assert (row.signal, row.pred) == (signal, pred), (name, row.t)
            assert abs(row.conf - conf) < 2e-3
            strong_rows += signal == "meanrev_strong"
    if n in (30, 60):
        assert strong_rows > 20


def test_registered_walkforward_returns_all_horizons(spark, inputs, monkeypatch):
    from walkloom.plans import registry, reports
    monkeypatch.setattr(reports, "directions_input", lambda *_: inputs)
    rows = registry.QUERIES["bt_direction_walkforward_all"](spark, "").toPandas()
    summary = registry.QUERIES["agg_direction_report_all"](spark, "").toPandas()
    windows = summary.set_index(["series_id", "horizon"])["windows"].to_dict()
    frame = inputs.toPandas().sort_values(["series_id", "t"])
    assert set(rows.horizon) == set(P.HORIZONS)
    for name, g in frame.groupby("series_id"):
        g = g.reset_index(drop=True)
        for n in P.HORIZONS:
            want = {g["date"][t]: v for t, v in simulate(g, n).items()}
            got = rows[(rows.series_id == name) & (rows.horizon == n)]
            assert len(got) == len(want) == windows[name, n]
            for row in got.itertuples():
                assert (row.signal, row.pred) == want[row.date][:2] and abs(row.conf - want[row.date][2]) < 2e-3


def long_simulation(g, n, policy):
    lp, rev, z = np.log(g["price"].to_numpy()), g["rev"].to_numpy(float), g["z60"].to_numpy(float)
    pools, out = {"plain": {}, "confirmed": {}, "weak": {}}, {}
    agrees = lambda i: np.isfinite(z[i]) and np.sign(z[i]) == np.sign(rev[i])
    for t in range(P.WARMUP, len(g) - n):
        j = t - n
        if j >= P.WARMUP:
            hit = int((lp[t] > lp[j]) == (rev[j] > 0))
            member = {"plain": True, "confirmed": agrees(j), "weak": g["high_vol"].iloc[j]}
            for pool, inside in member.items():
                if inside:
                    cell = pools[pool].setdefault(g["bucket"].iloc[j], [0, 0])
                    cell[0] += hit
                    cell[1] += 1
        b, gate = g["bucket"].iloc[t], g["gate"].iloc[t]
        cell = lambda pool: pools[pool].get(b, (0, 0))
        good = lambda c, rate: c[1] >= 20 and c[0] / c[1] >= rate
        up = int(rev[t] > 0)
        if policy == "moex_z":
            out[t] = (int(z[t] > 0) if gate >= 2 else None) if np.isfinite(z[t]) else up
        elif policy == "pure_rev":
            out[t] = up
        elif policy in ("breakout", "extreme_dist"):
            v = g["breakout" if policy == "breakout" else "extreme"].iloc[t]
            out[t] = None if pd.isna(v) else int(v)
        elif policy == "weak_experimental":
            out[t] = up if g["high_vol"].iloc[t] and good(cell("weak"), .55) else None
        elif policy == "off":
            out[t] = None
        else:
            ok = good(cell("confirmed" if agrees(t) else "plain"), .70)
            out[t] = up if ok and (policy == "dual_pool" or agrees(t)) else None
    return out


@pytest.mark.parametrize("policy", P.POLICIES)
def test_long_policies_equal_simulation(aligned, policy):
    signals = S.long_signals(aligned, with_regime=True)
    got = B.long_decisions(signals, {30: policy}).toPandas()
    frame = signals.toPandas().sort_values(["series_id", "t"])
    for name, g in frame.groupby("series_id"):
        want = long_simulation(g.reset_index(drop=True), 30, policy)
        mine = got[got.series_id == name]
        assert len(mine) == len(want)
        for row in mine.itertuples():
            assert (None if pd.isna(row.pred) else int(row.pred)) == want[row.t], (name, row.t)


def same(a, b, cols):
    a, b = (x.sort_values(["series_id", "t"]).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        x, y = a[c], b[c]
        if x.dtype == object or y.dtype == object:
            x, y = pd.to_numeric(x, errors="coerce"), pd.to_numeric(y, errors="coerce")
        assert (x.isna() == y.isna()).all(), c
        assert np.allclose(x.dropna().astype(float), y.dropna().astype(float), atol=1e-9), c


CUT = 480
SIGNALS = ["rev", "z60", "gate", "breakout", "extreme", "bucket"]


def test_no_operator_looks_ahead(spark, aligned):
    prefix = aligned.where(f"t < {CUT}")
    run = lambda df: B.direction_inputs(df, with_confirms=True).toPandas()
    cols = [*feat.ALL, "score", "z", "confirms", "hlr_median"]
    whole = run(aligned)
    same(whole[whole.t < CUT], run(prefix), cols)
    run = lambda df: S.recent_trend(S.recent_volatility(S.extreme_reversion(S.trend_regime(
        S.long_signals(df, with_regime=True))))).toPandas()
    whole = run(aligned)
    same(whole[whole.t < CUT], run(prefix), [*SIGNALS, "high_vol", "mr_dev", "rel_sd", "daily_vol", "trend_pct"])


def test_chunked_run_equals_whole_series(aligned):
    whole = feat.build(aligned).toPandas()
    parts = chunks.run(aligned, lambda df, by: feat.build(df, by), 100, feat.LOOKBACK).toPandas()
    same(whole, parts, [c for c in feat.ALL if c not in ("key_rate", "rate_change", "rate_change_60d")])
    whole = S.long_signals(aligned).toPandas()
    parts = chunks.run(aligned, lambda df, by: S.long_signals(df, by), 150, 400).toPandas()
    same(whole, parts, ["rev", "breakout", "extreme", "bucket"])


def test_two_level_row_ids_and_totals(aligned):
    from pyspark.sql import functions as F
    ids = chunks.row_ids(aligned.drop("t").withColumn("x", F.lit(1)), F.year("date")).toPandas()
    want = aligned.toPandas().set_index(["series_id", "date"])["t"]
    got = ids.set_index(["series_id", "date"])["t"]
    assert (got.sort_index() == want.sort_index()).all()
    signals = S.reversion(aligned).withColumn(
        "hit", F.when(F.col("t") >= P.WARMUP, (F.col("rev") > 0).cast("int")))
    out = chunks.oos_rates(signals, "hit", 30, 64).toPandas()
    for _, g in out.groupby("series_id"):
        g = g.sort_values("t")
        known = g["hit"].shift(30)
        assert (known.notna().cumsum().to_numpy() == g["cum_realised_n"].to_numpy()).all()
        assert (known.fillna(0).cumsum().to_numpy() == g["cum_realised_hits"].to_numpy()).all()


def test_expanding_median_matches_numpy(aligned):
    from walkloom.operators.medians import expanding_median
    got = expanding_median(aligned, ["series_id"], "t", "close", "m", lag=30, start=120, min_n=30).toPandas()
    frame = aligned.toPandas().set_index(["series_id", "t"])["close"]
    for row in got.itertuples():
        past = [frame[(row.series_id, j)] for j in range(120, row.t - 29)]
        past = [x for x in past if not pd.isna(x)]
        assert (row.m is None or pd.isna(row.m)) if len(past) < 30 else abs(row.m - np.median(past)) < 1e-12


def test_predictable_series_beats_the_baseline(spark):
    """Blocks of spread drive the next month: the spread rule must see it."""
    n = 520
    push = np.where((np.arange(n) // 30) % 2 == 0, 1.0, -1.0)
    lp = np.log(12) + np.cumsum(push * 0.002)
    price = np.exp(lp)
    close = price * np.exp(push * 0.01 + np.random.default_rng(7).normal(0, .001, n))
    from tests.conftest import make_series
    pdf = make_series(n, 7, "p", gaps=False)
    pdf["price"], pdf["close"] = price, close
    df = B.direction_inputs(to_spark(spark, pdf))
    rep = B.direction_report(B.direction_decisions(df, [7])).first()
    assert rep["market_accuracy"] >= rep["baseline_majority"] + 0.15


@pytest.mark.parametrize("seed", range(4))
def test_prefix_medians_of_many_groups(seed):
    from walkloom.operators.medians import prefix_medians
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 40, 30)
    group = np.repeat(np.arange(30), sizes)
    at = np.concatenate([np.sort(rng.choice(90, n, replace=False)) for n in sizes])
    x = np.round(rng.normal(size=len(group)), 1)
    ok = rng.random(len(group)) < 0.8
    lag, least = [(0, 1), (7, 1), (0, 5), (30, 3)][seed]
    got = prefix_medians(group, at, x, ok, lag, least)
    for i in range(len(group)):
        past = x[(group == group[i]) & (at <= at[i] - lag) & ok]
        want = np.median(past) if len(past) >= least else np.nan
        assert got[i] == want or np.isnan(got[i]) and np.isnan(want)


def test_medians_do_not_depend_on_batches(spark, aligned, monkeypatch):
    from walkloom.operators import medians
    args = (["series_id"], "t", "close", "m")
    whole = {tuple(r) for r in medians.expanding_median(aligned, *args, min_n=3).collect()}
    monkeypatch.setattr(medians, "ROWS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        parts = {tuple(r) for r in medians.expanding_median(aligned, *args, min_n=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts == whole and len(whole) == aligned.count()
