"""Registered window, projection and join queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from walkloom import params as P
from walkloom.functions import scalars as X
from walkloom.operators import backtest as B
from walkloom.operators import experiments as E
from walkloom.operators import features as feat
from walkloom.operators import joins as J
from walkloom.operators import signals as S
from walkloom.oracle import ctes as Q
from walkloom.oracle.ctes import W, actual, prior, r, rows, upto
from walkloom.plans.registry import (full_base, market_base, price_base, query, report)
from walkloom.sources import panel

KEYS = ("series_id", "date")


# ---------------------------------------------------------------------- features

def _feature_query(name: str, cols: list[str], sql_cols: str | None = None,
                   blocks: tuple[str, ...] = ("feat",), source: str = "feat", gaps: dict | None = None) -> None:
    sql = Q.query(f"SELECT series_id, date, {sql_cols or r(*cols)} FROM {source}", *blocks, gaps=bool(gaps))

    @query(name, sql)
    def run(spark, d):
        return report(feat.build(full_base(spark, d, gaps=gaps), keep=cols), *KEYS, *cols)


_feature_query("feat_returns", ["ret1", "mom5", "mom20"])
_feature_query("feat_vol", ["vol5", "vol20"])
_feature_query("feat_range_pos60", ["pos60"])
_feature_query("feat_level_z60", ["level_z60"])
_feature_query("feat_dow", ["dow"])
_feature_query("feat_ma_dev", ["ma20_dev", "ma60_dev"])
_feature_query("feat_slope20", ["slope20"])
_feature_query("feat_cross", ["cross_ret1", "cross_ret5", "cross_ret20", "cross_vol20",
                              "implied_mom5", "implied_mom20"])
_feature_query("feat_corr60", ["cross_corr60"])
_feature_query("feat_beta60", ["cross_beta60"])
_feature_query("feat_oil", list(feat.OIL))
_feature_query("feat_sentiment", list(feat.SENTIMENT))
_feature_query("feat_rate", list(feat.RATE), gaps=panel.GAPS)
_feature_query(
    "feat_skew20", ["skew20"],
    r("""skew20=CASE WHEN n = 20 THEN sqrt(20*19)/18.0
      * (s3/20 - 3*(s1/20)*(s2/20) + 2*power(s1/20, 3)) / power(s2/20 - power(s1/20, 2), 1.5) END"""),
    ("ret",),
    f"""(SELECT series_id, date, count(r) OVER {rows(20)} AS n, sum(r) OVER {rows(20)} AS s1,
      sum(r*r) OVER {rows(20)} AS s2, sum(r*r*r) OVER {rows(20)} AS s3 FROM ret)""")
_feature_query(
    "feat_rsi14", ["rsi14"], r("rsi14=CASE WHEN n >= 14 AND l > 0 THEN 100 - 100/(1 + g/nullif(l, 0)) END"),
    ("ret",),
    f"""(SELECT a.series_id, a.date, any_value(a.n) AS n,
        sum(greatest(b.r, 0) * power(13/14.0::double, a.t - b.t)) AS g,
        sum(greatest(-b.r, 0) * power(13/14.0::double, a.t - b.t)) AS l
      FROM (SELECT *, count(r) OVER {upto()} AS n FROM ret) a LEFT JOIN ret b
        ON b.series_id = a.series_id AND b.t BETWEEN a.t - 399 AND a.t GROUP BY 1, 2)""")


# ---------------------------------------------------------------------- windows

_absent = ("key_rate", "rate_change", "rate_change_60d", "sentiment", "sentiment_7d", "sentiment_30d", "sentiment_coverage")


@query("feat_absent_inputs", Q.query(f"""
SELECT series_id, date, {", ".join(f"0.0::double AS {c}" for c in _absent)}, NULL::double AS oil_ret1, NULL::double AS oil_corr60,
  {r('mom5')} FROM feat""", "feat"))
def feat_absent_inputs(spark, d):
    """No market, oil, sentiment or rate table: rates and sentiment read 0.0, oil stays unknown."""
    names = [*_absent, "oil_ret1", "oil_corr60", "mom5"]
    df = feat.build(price_base(spark, d), keep=names)
    return report(df, *KEYS, *names)


@query("win_zdev150", Q.query(f"SELECT series_id, date, mrow, {r('dev', 'z=z_own')} FROM mk", "mk"))
def win_zdev150(spark, d):
    df = S.market_z(market_base(spark, d)).where("has_market")
    return report(df, *KEYS, F.col("mrow").cast("bigint").alias("mrow"), "dev",
                  F.col("z_own").alias("z"))


@query("win_zspread60", Q.query(f"SELECT series_id, date, {r('md', 'z60')} FROM ls", "ls"))
def win_zspread60(spark, d):
    return report(S.spread_z60(market_base(spark, d)), *KEYS, "md", "z60")


@query("win_rev", Q.query(f"SELECT series_id, date, {r('rev')} FROM ls", "ls"))
def win_rev(spark, d):
    return report(S.reversion(price_base(spark, d)), *KEYS, "rev")


@query("win_expanding_median", Q.query(f"SELECT series_id, date, {r('hlr', 'hlr_median')} FROM mk", "mk"))
def win_expanding_median(spark, d):
    df = S.range_median(S.market_z(market_base(spark, d)).where("has_market"))
    return report(df, *KEYS, "hlr", "hlr_median")


_c6 = {"c_momentum": "nclose >= 2 AND (mom > 0) = (z > 0)",
       "c_widening": "mrow >= 6 AND sign(dev_change) = sign(z)",
       "c_range": "hlr >= hlr_median",
       "c_oil": "is_valid AND (oil_ret20 > 0) <> (z > 0)",
       "c_sentiment": "is_valid AND abs(sentiment_7d) > 0.01 AND (sentiment_7d >= 0) = (z > 0)",
       "c_streak": "sign(z_prev) = sign(z)"}
_c6_cols = ", ".join(f"CASE WHEN z IS NOT NULL THEN coalesce(({e})::int, 0) END AS {n}"
                     for n, e in _c6.items())
_near6 = f"({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"


@query("win_confirms6", Q.query(f"""
SELECT *, ({' + '.join(_c6)})::int AS confirms FROM (SELECT series_id, date, {r('z')}, {_c6_cols}
  FROM (SELECT *, count(close) OVER {_near6} AS nclose,
    ln(last_value(close IGNORE NULLS) OVER {_near6}) - ln(first_value(close IGNORE NULLS) OVER {_near6}) AS mom
  FROM din))""", "din"))
def win_confirms6(spark, d):
    df = B.direction_inputs(full_base(spark, d), with_confirms=True)
    return report(df, *KEYS, "z", *_c6, "confirms")


@query("win_confirms3", Q.query(f"""
SELECT series_id, date, {r('z60')}, CASE WHEN z60 IS NULL THEN 0 ELSE coalesce(c1::int, 0) END AS g_momentum,
  CASE WHEN z60 IS NULL THEN 0 ELSE coalesce(c2::int, 0) END AS g_widening,
  CASE WHEN z60 IS NULL THEN 0 ELSE coalesce(c4::int, 0) END AS g_oil, gate::int AS gate,
  gate >= 2 AS gate_passed FROM ls""", "ls"))
def win_confirms3(spark, d):
    df = S.long_signals(market_base(spark, d))
    return report(df, *KEYS, "z60", "g_momentum", "g_widening", "g_oil", "gate",
                  (F.col("gate") >= P.GATE_MIN_CONFIRMS).alias("gate_passed"))


@query("win_breakout60", Q.query("SELECT series_id, date, breakout FROM ls", "ls"))
def win_breakout60(spark, d):
    return S.breakout(price_base(spark, d)).select(*KEYS, "breakout")


@query("win_extreme_dist252", Q.query(f"SELECT series_id, date, {r('range_pos')}, extreme FROM ls", "ls"))
def win_extreme_dist252(spark, d):
    return report(S.extreme_distance(price_base(spark, d)), *KEYS, "range_pos", "extreme")


@query("win_high_vol", Q.query(f"SELECT series_id, date, {r('vol20p')}, high_vol FROM hv", "hv"))
def win_high_vol(spark, d):
    return report(S.high_vol(price_base(spark, d)), *KEYS, "vol20p", "high_vol")


@query("win_composite_mr", Q.query(
    f"SELECT series_id, date, is_valid, {r('score', 'strength=abs(score)')} FROM comp", "comp"))
def win_composite_mr(spark, d):
    df = feat.build(full_base(spark, d))
    df = S.composite_reversion(S.valid_rows(df, B.WALK_FEATURES))
    return report(df, *KEYS, "is_valid", "score", "strength")


@query("win_extreme_mr", Q.query(f"""
SELECT series_id, date, {r('mr_dev', 'rel_sd')},
  coalesce(rel_sd > 0 AND abs(mr_dev) >= 2.0 * rel_sd, false) AS mr_trigger,
  CASE WHEN rel_sd > 0 THEN CASE WHEN mr_dev > 0 THEN 0 ELSE 1 END END AS mr_pred,
  {r('mr_strength=CASE WHEN rel_sd > 0 THEN abs(mr_dev / rel_sd) ELSE 0.0 END')}
FROM (SELECT series_id, date, CASE WHEN t >= 19 THEN (price - avg(price) OVER {rows(20)})
    / avg(price) OVER {rows(20)} END AS mr_dev,
  CASE WHEN t >= 19 AND count(price) OVER {rows(250)} > 30
    THEN stddev_pop(price) OVER {rows(250)} / avg(price) OVER {rows(250)} END AS rel_sd FROM al)""", "al"))
def win_extreme_mr(spark, d):
    return report(S.extreme_reversion(price_base(spark, d)), *KEYS, "mr_dev", "rel_sd",
                  "mr_trigger", "mr_pred", "mr_strength")


def _oos_sql() -> str:
    parts = []
    for n in P.LONG_HORIZONS:
        w = "PARTITION BY series_id, bucket ORDER BY t"
        frame = f"({w} RANGE BETWEEN UNBOUNDED PRECEDING AND {n} PRECEDING)"
        ok = "t >= 120 AND actual IS NOT NULL"
        parts.append(f"""SELECT series_id, date, {n} AS horizon, bucket,
          coalesce(count(*) FILTER (WHERE {ok}) OVER {frame}, 0) AS n,
          coalesce(count(*) FILTER (WHERE {ok} AND (rev > 0)::int = actual) OVER {frame}, 0) AS hits
        FROM (SELECT *, {actual(n)} AS actual FROM ls)""")
    return Q.query("SELECT series_id, date, horizon, bucket, n, hits, "
                   f"{r('rate=hits / nullif(n, 0)')} FROM ({' UNION ALL '.join(parts)}) "
                   "WHERE bucket >= 0", "ls")


@query("win_oos_bucket_rate", _oos_sql())
def win_oos_bucket_rate(spark, d):
    df = S.reversion(price_base(spark, d)).withColumn("bucket", X.rev_bucket(F.col("rev")))
    df = J.forward_outcome(df, P.LONG_HORIZONS)
    cols, rows_ = {}, []
    for n in P.LONG_HORIZONS:
        sample = (F.col("t") >= P.WARMUP) & F.col(f"actual_{n}").isNotNull()
        hit = F.when(F.col("rev") > 0, 1).otherwise(0) == F.col(f"actual_{n}")
        cols[f"n_{n}"], cols[f"rate_{n}"] = B._pool_rate(["series_id"], n, sample, hit)
        rows_.append(F.struct(F.lit(n).alias("horizon"), F.col(f"n_{n}").alias("n"),
                              F.col(f"rate_{n}").alias("rate")))
    df = df.withColumns(cols).where(F.col("bucket") >= 0)
    df = df.select(*KEYS, "bucket", F.explode(F.array(*rows_)).alias("x")).select(
        *KEYS, "x.horizon", "bucket", "x.n",
        F.coalesce(F.round(F.col("x.rate") * F.col("x.n")), F.lit(0)).cast("bigint").alias("hits"),
        "x.rate")
    return report(df, exact=())


@query("win_range_algos", Q.query(f"""
SELECT series_id, date, horizon, algo, pred FROM (
  {" UNION ALL ".join(f'''
  SELECT series_id, date, t, {n} AS horizon, unnest(['A','B','C','D','E']) AS algo,
    unnest([CASE WHEN hi > lo THEN CASE WHEN (price-lo)/(hi-lo) < 0.2 THEN 1 WHEN (price-lo)/(hi-lo) > 0.8 THEN 0 END END,
      CASE WHEN price > phi THEN 1 WHEN price < plo THEN 0 END,
      CASE WHEN hi > lo THEN CASE WHEN price-lo < hi-price THEN 1 ELSE 0 END END,
      CASE WHEN t >= {n} + 20 THEN CASE WHEN hi > lag(hi,20) OVER ({W}) AND lo > lag(lo,20) OVER ({W}) THEN 1
        WHEN hi < lag(hi,20) OVER ({W}) AND lo < lag(lo,20) OVER ({W}) THEN 0 END END,
      CASE WHEN ps < 0.3 AND pl < 0.3 THEN 1 WHEN ps > 0.7 AND pl > 0.7 THEN 0 END]) AS pred
  FROM (SELECT *, CASE WHEN his > los THEN (price-los)/(his-los) ELSE 0.5 END AS ps,
      CASE WHEN hi > lo THEN (price-lo)/(hi-lo) ELSE 0.5 END AS pl
    FROM (SELECT series_id, date, t, price, min(price) OVER {rows(n)} AS lo, max(price) OVER {rows(n)} AS hi,
      min(price) OVER {rows(max(5, n // 4))} AS los, max(price) OVER {rows(max(5, n // 4))} AS his,
      min(price) OVER {prior(n)} AS plo, max(price) OVER {prior(n)} AS phi FROM al))''' for n in P.HORIZONS)})
WHERE t >= 120""", "al"))
def win_range_algos(spark, d):
    df = S.range_algorithms(price_base(spark, d)).where(F.col("t") >= P.WARMUP)
    cells = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(a).alias("algo"),
                               F.col(f"{a}_{n}").alias("pred"))
                      for n in P.HORIZONS for a in "ABCDE"])
    return df.select(*KEYS, F.explode(cells).alias("x")).select(*KEYS, "x.*")


_edge = f"abs(ln(lead(price) OVER ({W})) - ln(price)) > 0.20"


@query("win_jumps", Q.query(f"""
SELECT series_id, date, lead(date) OVER ({W}) AS next_date,
  {r(f'next_move=ln(lead(price) OVER ({W})) - ln(price)')}, {_edge} AS edge FROM al
QUALIFY {_edge}""", "al"))
def win_jumps(spark, d):
    return report(S.jumps(price_base(spark, d)).where("edge"),
                  *KEYS, "next_date", "next_move", "edge")


_flip = "CASE WHEN month(date) IN (2, 7) THEN price * 10 ELSE price END"


def flipped(official):
    """Unit-flipped copy: quotes per ten units in two months of the year."""
    flip = F.month("date").isin(2, 7)
    return official.withColumns({
        "price": F.when(flip, F.col("price") * 10).otherwise(F.col("price")),
        "nominal": F.when(flip, 10).otherwise(1)})


@query("win_islands", Q.query(f"""
SELECT series_id, min(date) AS start, max(date) AS "end", count(*) AS rows FROM (
  SELECT *, row_number() OVER ({W}) - row_number() OVER (PARTITION BY series_id, flag ORDER BY date) AS g
  FROM (SELECT series_id, date, month(date) IN (2, 7) AS flag FROM official))
WHERE flag GROUP BY series_id, g""", "official"))
def win_islands(spark, d):
    new = panel.official(spark, d)
    both = J.snapshot_compare(flipped(new), new)
    return S.islands(both, "changed")


@query("win_trailing_contamination", Q.query(f"""
SELECT series_id, count(*) FILTER (WHERE edge_day = 1) AS n_edge_days,
  {", ".join(f"count(*) FILTER (WHERE h{n} = 1) AS rows_{n}" for n in (20, 60, 120, 150, 252))}
FROM (SELECT *, {", ".join(f"max(edge_day) OVER {rows(n)} AS h{n}" for n in (20, 60, 120, 150, 252))}
  FROM (SELECT series_id, date, coalesce(edge OR lag(edge, 1, false) OVER ({W}), false)::int AS edge_day
    FROM (SELECT series_id, date, {_edge} AS edge FROM (SELECT series_id, date, {_flip} AS price FROM official))))
GROUP BY 1""", "official"))
def win_trailing_contamination(spark, d):
    return contamination(S.jumps(flipped(panel.official(spark, d))))


def contamination(jumps):
    """Edge days, and rows with one in their window, of ``signals.jumps``."""
    df = S.trailing_contamination(jumps)
    return df.groupBy("series_id").agg(
        F.count_if(F.col("edge_day") == 1).alias("n_edge_days"),
        *[F.count_if(F.col(f"hit_{n}") == 1).alias(f"rows_{n}") for n in (20, 60, 120, 150, 252)])


@query("win_trend_regime", Q.query(f"""
SELECT series_id, date, CASE WHEN m > 0.03 THEN 'bull' WHEN m < -0.03 THEN 'bear'
  WHEN m IS NOT NULL THEN 'sideways' ELSE 'unknown_warmup' END AS trend_regime
FROM (SELECT series_id, date, ln(price) - ln(lag(price, 60) OVER ({W})) AS m FROM al)""", "al"))
def win_trend_regime(spark, d):
    return S.trend_regime(price_base(spark, d)).select(*KEYS, "trend_regime")


@query("win_recent_vol", Q.query(f"""
SELECT series_id, date, {r(f'daily_vol=CASE WHEN count(r) OVER {rows(60)} >= 20 THEN stddev_samp(r) OVER {rows(60)} END')}
FROM ret""", "ret"))
def win_recent_vol(spark, d):
    return report(S.recent_volatility(price_base(spark, d)), *KEYS, "daily_vol")


@query("win_recent_trend", Q.query(f"""
SELECT series_id, date, {r('trend_pct=p')}, CASE WHEN p > 3 THEN 'up' WHEN p < -3 THEN 'down'
  WHEN p IS NOT NULL THEN 'flat' ELSE 'no_data' END AS trend_label
FROM (SELECT *, CASE WHEN t >= 24 THEN (price / lag(price, 19) OVER ({W}) - 1) * 100 END AS p FROM al)""", "al"))
def win_recent_trend(spark, d):
    return report(S.recent_trend(price_base(spark, d)), *KEYS, "trend_pct", "trend_label")


# ---------------------------------------------------------------------- projections

@query("prj_spread", Q.query(f"""SELECT series_id, date, {r('dev=ln(close) - ln(price)')}
FROM al WHERE close > 0""", "al"))
def prj_spread(spark, d):
    df = J.exact(panel.official(spark, d), panel.market(spark, d))
    return report(df.select(*KEYS, X.spread(F.col("close"), F.col("price")).alias("dev")))


@query("prj_intraday_range", Q.query(f"""SELECT series_id, date,
  {r('hlr=CASE WHEN close <> 0 AND high <> 0 AND low <> 0 THEN (high-low)/close END')} FROM market""", "market"))
def prj_intraday_range(spark, d):
    m = panel.market(spark, d)
    return report(m.select(*KEYS, X.intraday_range(F.col("close"), F.col("high"), F.col("low")).alias("hlr")))


@query("prj_z_bucket7", Q.query(f"SELECT series_id, date, {Q.z7('z_own')} AS z_bucket FROM mk", "mk"))
def prj_z_bucket7(spark, d):
    df = S.market_z(market_base(spark, d)).where("has_market")
    return df.select(*KEYS, X.z_bucket7(F.col("z_own")).alias("z_bucket"))


@query("prj_z_bucket30", Q.query(f"SELECT series_id, date, {Q.z30('z60')} AS z_bucket FROM ls", "ls"))
def prj_z_bucket30(spark, d):
    return S.spread_z60(market_base(spark, d)).select(
        *KEYS, X.z_bucket30(F.col("z60")).alias("z_bucket"))


@query("prj_rev_bucket", Q.query("""SELECT series_id, date, bucket, CASE WHEN bucket >= 0 THEN
  ['strong_down','mid_down','weak_down','weak_up','mid_up','strong_up'][bucket+1] END AS bucket_name FROM ls""", "ls"))
def prj_rev_bucket(spark, d):
    df = S.reversion(price_base(spark, d)).withColumn("bucket", X.rev_bucket(F.col("rev")))
    return df.select(*KEYS, "bucket", X.rev_bucket_name(F.col("bucket")).alias("bucket_name"))


_lab = f"(lead(price, 30) OVER ({W}) - price) / price"


@query("prj_labels", Q.query(f"""
SELECT series_id, date, {r('r_fwd=x')}, CASE WHEN x > 0.01 THEN 1 WHEN x < -0.01 THEN -1
  WHEN x IS NOT NULL THEN 0 END AS y3, CASE WHEN x > 0 THEN 1 WHEN x IS NOT NULL THEN 0 END AS y2
FROM (SELECT series_id, date, {_lab} AS x FROM al)""", "al"))
def prj_labels(spark, d):
    return report(E.labels(price_base(spark, d)), *KEYS, "r_fwd", "y3", "y2")


_defaults7 = {b: str(v) + "::double" for b, v in P.DEFAULT_BUCKET_RATE[7].items()}
_rates30 = {"z00": 0.51, "z03": None, "z05": 0.58, "z10": 0.66}


@query("prj_conf_interp7", Q.query(f"""
SELECT series_id, date, {r(f"confidence={Q.conf7('abs(z_own)', _defaults7)}")} FROM mk""", "mk"))
def prj_conf_interp7(spark, d):
    df = S.market_z(market_base(spark, d)).where("has_market")
    table = {b: F.lit(v) for b, v in P.DEFAULT_BUCKET_RATE[7].items()}
    return report(df.select(*KEYS, X.confidence7(F.abs("z_own"), table).alias("confidence")))


@query("prj_conf_interp30", Q.query(f"""
SELECT series_id, date, {r('''confidence=CASE WHEN az IS NULL THEN NULL
  WHEN az < 0.5 THEN 0.51 + (0.58 - 0.51) * az / 0.5
  WHEN az < 1.0 THEN 0.58 + (0.66 - 0.58) * (az - 0.5) / 0.5 ELSE 0.66 END''')}
FROM (SELECT series_id, date, abs(z60) AS az FROM ls)""", "ls"))
def prj_conf_interp30(spark, d):
    table = {b: F.lit(v).cast("double") for b, v in _rates30.items()}
    df = S.spread_z60(market_base(spark, d))
    return report(df.select(*KEYS, F.when(F.col("z60").isNotNull(), X.confidence30(
        F.abs("z60"), table)).alias("confidence")))


_conf = Q.conf7("abs(z_own)", _defaults7)


@query("prj_prob_split", Q.query(f"""
SELECT series_id, date, pred, {r('prob_up=round(u, 3)', 'prob_down=round(1 - u, 3)')}
FROM (SELECT *, CASE WHEN pred = 1 THEN c ELSE 1 - c END AS u
  FROM (SELECT series_id, date, (z_own > 0)::int AS pred, {_conf} AS c FROM mk WHERE z_own IS NOT NULL))""", "mk"))
def prj_prob_split(spark, d):
    df = _scored_market(spark, d)
    return report(df.select(*KEYS, "pred", X.prob_up(F.col("pred"), F.col("conf")).alias("prob_up"),
                            X.prob_down(F.col("pred"), F.col("conf")).alias("prob_down")))


def _scored_market(spark, d):
    table = {b: F.lit(v) for b, v in P.DEFAULT_BUCKET_RATE[7].items()}
    df = S.market_z(market_base(spark, d)).where(F.col("z_own").isNotNull())
    return df.withColumns({"pred": F.when(F.col("z_own") > 0, 1).otherwise(0),
                           "conf": X.confidence7(F.abs("z_own"), table)})


@query("prj_conf_tier", Q.query(f"""
SELECT series_id, date, CASE WHEN c >= 0.65 THEN 'high' WHEN c >= 0.55 THEN 'mid' ELSE 'low' END AS tier,
  c < 0.55 AS is_weak, az < 0.3 AS weak_signal,
  CASE WHEN c < 0.55 THEN 'low' WHEN passed_gate THEN 'high' ELSE 'mid' END AS long_badge, horizon
FROM (SELECT series_id, date, abs(z_own) AS az, {_conf} AS c FROM mk WHERE z_own IS NOT NULL)
JOIN (SELECT series_id, horizon, passed_gate FROM lrep) USING (series_id)""", "mk", "lrep"))
def prj_conf_tier(spark, d):
    from walkloom.plans.reports import ERAS, long_rows
    gates = B.long_report(long_rows(spark, d), ERAS).select("series_id", "horizon", "passed_gate")
    df = _scored_market(spark, d).join(gates, "series_id")
    conf = F.col("conf")
    gate_passed = F.coalesce("passed_gate", F.lit(False))
    return df.select(*KEYS, "horizon", X.confidence_tier(conf).alias("tier"), (conf < 0.55).alias("is_weak"),
                     (F.abs("z_own") < P.WEAK_Z).alias("weak_signal"),
                     X.long_badge(conf, gate_passed).alias("long_badge"))


@query("prj_anchor_disp", Q.query(f"""
SELECT series_id, date, h AS horizon, {r('''disp=CASE WHEN c < 0.55 THEN 0.0 ELSE
  (CASE WHEN z_own > 0 THEN 1 ELSE -1 END) * 0.0161 * greatest(0, least(1, (c - 0.5) * 2)) * sqrt(h / 7.0) END''')}
FROM (SELECT series_id, date, z_own, {_conf} AS c, unnest([7, 30, 60, 90]) AS h
  FROM mk WHERE z_own IS NOT NULL)""", "mk"))
def prj_anchor_disp(spark, d):
    df = _scored_market(spark, d).withColumn("horizon", F.explode(F.array(*[F.lit(n) for n in P.HORIZONS])))
    return report(df.select(*KEYS, "horizon", X.anchor_displacement(
        F.col("pred"), F.col("conf"), F.col("horizon")).alias("disp")))


@query("prj_asof_cap", Q.query("""
SELECT series_id, max(date) AS newest, least(max(date), date '1999-06-30') AS as_of FROM official GROUP BY 1""",
                               "official"))
def prj_asof_cap(spark, d):
    newest = F.max("date")
    return panel.official(spark, d).groupBy("series_id").agg(
        newest.alias("newest"), F.least(newest, F.lit("1999-06-30").cast("date")).alias("as_of"))


@query("flt_valid_rows", Q.query("""
SELECT series_id, date, t::int AS t, first_row::int AS first_row FROM ft WHERE is_valid AND t >= first_row""", "ft"))
def flt_valid_rows(spark, d):
    df = S.valid_rows(feat.build(full_base(spark, d)), B.WALK_FEATURES)
    return df.where(F.col("is_valid") & (F.col("t") >= F.col("first_row"))).select(
        *KEYS, "t", "first_row")


@query("flt_min_history", Q.query("""
SELECT series_id, date, n FROM (SELECT o.*, count(*) OVER (PARTITION BY series_id) AS n FROM official o)
WHERE n >= 100""", "official"))
def flt_min_history(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    return panel.official(spark, d).withColumn("n", n).where(F.col("n") >= 100).select(*KEYS, "n")


# ---------------------------------------------------------------------- joins

@query("join_date_union_ffill", Q.query(f"""
SELECT series_id, date, price, cross_price, filled FROM (
  SELECT series_id, date, {Q.carry('a')} AS price, {Q.carry('b')} AS cross_price, a IS NULL AS filled
  FROM (SELECT coalesce(o.series_id, m.series_id) AS series_id, coalesce(o.date, m.date) AS date,
      o.price AS a, m.close AS b FROM official o FULL JOIN market m
      ON o.series_id = m.series_id AND o.date = m.date))
WHERE price IS NOT NULL""", "official", "market"))
def join_date_union_ffill(spark, d):
    a = panel.official(spark, d).withColumnRenamed("price", "value")
    b = panel.market(spark, d).withColumnRenamed("close", "value")
    return report(J.date_union_ffill(a, b), *KEYS, "price", "cross_price", "filled")


@query("join_exact", Q.query(f"""
SELECT o.series_id, o.date, o.price, m.close FROM official o
JOIN market m ON o.series_id = m.series_id AND o.date = m.date""", "official", "market"))
def join_exact(spark, d):
    return report(J.exact(panel.official(spark, d), panel.market(spark, d)), *KEYS, "price", "close")


@query("join_exact_then_carry", Q.query(f"""
SELECT series_id, date, {Q.carry("close")} AS close, {Q.carry("rate_raw")} AS rate FROM al""", "al", gaps=True))
def join_exact_then_carry(spark, d):
    df = J.exact_then_carry(panel.official(spark, d), panel.market(spark, d, **panel.GAPS["market"]), ["close"])
    rate = panel.key_rate(spark, d, **panel.GAPS["key_rate"]).withColumnRenamed("value", "rate")
    df = J.exact_then_carry(df, J.per_day(rate), ["rate"], on=("date",))
    return report(df, *KEYS, "close", "rate")


@query("join_asof_backward", Q.query(f"""
SELECT o.series_id, o.date, i.value AS oil, m.close AS market_close FROM official o
ASOF LEFT JOIN oil i ON o.date >= i.date
ASOF LEFT JOIN market m ON o.series_id = m.series_id AND o.date >= m.date""", "official", "oil", "market", gaps=True))
def join_asof_backward(spark, d):
    df = J.asof_macro(panel.official(spark, d), panel.oil(spark, d, **panel.GAPS["oil"]), "value", "oil")
    market = panel.market(spark, d, **panel.GAPS["market"]).select(*KEYS, F.col("close").alias("market_close"))
    return report(J.asof_backward(df, market, ["market_close"], chunk=F.year),
                  *KEYS, "oil", "market_close")


@query("join_asof_tolerance_rows", Q.query(
    f"SELECT series_id, date, src_t::int AS src_t, {r('dev')} FROM near", "near", gaps=True))
def join_asof_tolerance_rows(spark, d):
    df = S.market_position(S.market_z(market_base(spark, d, gaps=panel.GAPS)))
    return report(df, *KEYS, F.col("near_src_t").alias("src_t"), F.col("near_dev").alias("dev"))


@query("join_forward_outcome", Q.query(f"""
SELECT series_id, date, {", ".join(f"{actual(n)} AS actual_{n}" for n in P.HORIZONS)} FROM al""", "al"))
def join_forward_outcome(spark, d):
    return J.forward_outcome(price_base(spark, d), P.HORIZONS).select(
        *KEYS, *[f"actual_{n}" for n in P.HORIZONS])


@query("join_interval_contaminate", Q.query(f"""
WITH f AS (SELECT series_id, date, t, {_edge} AS edge FROM (SELECT series_id, date, t, {_flip} AS price FROM al))
SELECT a.series_id, a.date, count(b.t) > 0 AS contaminated FROM f a LEFT JOIN f b
  ON b.series_id = a.series_id AND b.edge AND b.t BETWEEN a.t AND a.t + 29 GROUP BY 1, 2""".replace(
    "WITH f AS", "SELECT * FROM (WITH f AS") + ")", "al"))
def join_interval_contaminate(spark, d):
    df = S.jumps(flipped(panel.official(spark, d)))
    return J.interval_contaminated(df, F.col("edge"), P.LABEL_HORIZON).select(*KEYS, "contaminated")


@query("join_semi_exists", Q.query("""
SELECT series_id, date, EXISTS (SELECT 1 FROM market m WHERE m.series_id = o.series_id AND m.date = o.date)
  AS has_market FROM official o""", "official", "market", gaps=True))
def join_semi_exists(spark, d):
    marks = panel.market(spark, d, **panel.GAPS["market"]).select(*KEYS, F.lit(True).alias("has_market"))
    return panel.official(spark, d).join(marks, list(KEYS), "left").select(
        *KEYS, F.coalesce("has_market", F.lit(False)).alias("has_market"))


@query("join_anti_new", Q.query(f"""
SELECT m.series_id, m.date, m.close FROM market m
WHERE NOT EXISTS (SELECT 1 FROM official o WHERE m.series_id = o.series_id AND m.date = o.date)""",
                                "official", "market"))
def join_anti_new(spark, d):
    return report(panel.market(spark, d).join(panel.official(spark, d), list(KEYS), "left_anti"),
                  *KEYS, "close")


def _snapshot_sql(main: str) -> str:
    return Q.query(main, "official")


@query("join_snapshot_compare", _snapshot_sql(f"""
SELECT series_id, date, old_price, new_price, changed, {r('ratio=new_price / old_price')}
FROM (SELECT series_id, date, {_flip} AS old_price, price AS new_price,
  round({_flip}, 6) <> round(price, 6) AS changed FROM official)"""))
def join_snapshot_compare(spark, d):
    new = panel.official(spark, d)
    return report(J.snapshot_compare(flipped(new), new), *KEYS, "old_price", "new_price",
                  "changed", "ratio")


