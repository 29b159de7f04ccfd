"""Registered aggregations, calibrations, decisions, ledger, health and experiments."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkloom import params as P
from walkloom.functions import scalars as X
from walkloom.operators import backtest as B
from walkloom.operators import calibration as C
from walkloom.operators import daily
from walkloom.operators import experiments as E
from walkloom.operators import features as feat
from walkloom.operators import health as H
from walkloom.operators import joins as J
from walkloom.operators import ledger as L
from walkloom.operators import predict as PR
from walkloom.operators import projection as PJ
from walkloom.operators import signals as S
from walkloom.oracle import ctes as Q
from walkloom.oracle.ctes import W, r, rows
from walkloom.plans.registry import (full_base, market_base, price_base, query, report,
                                     scored_news, sentiment)
from walkloom.plans.windows import _flip, contamination, flipped
from walkloom.session import materialise, shared_dir
from walkloom.sources import panel, sinks

KEYS = ("series_id", "date")
# Eras of the test panel (1995-2001); the default eras cover later years.
ERAS = Q.ERAS
SPLIT_YEAR = 1998
# Daily means of the test panel move by 0.7 (log) on an ordinary day; the method's jump edge of
# 0.2 would flag every row, so label windows use an edge that separates outliers here.
PANEL_JUMP = 1.8


def stamp():
    """Creation stamp of replayed ledger rows."""
    return F.lit("2001-09-01 00:00:00").cast("timestamp_ntz")


# ------------------------------------------------------------------ shared inputs

def directions_input(spark: SparkSession, d: str, **kw) -> DataFrame:
    return B.direction_inputs(full_base(spark, d), **kw)


def long_rows(spark: SparkSession, d: str, policy=None, with_regime=False, gaps=None) -> DataFrame:
    return B.long_decisions(S.long_signals(market_base(spark, d, gaps=gaps), with_regime=with_regime), policy)


def current_directions(spark: SparkSession, d: str) -> DataFrame:
    """(series_id, as_of, horizon, prediction, confidence, neutral, ...) of the newest rows."""
    # three consumers (newest rows, bucket rates, reversion rates) share one slim table
    inputs = materialise(directions_input(spark, d).select(
        "series_id", "date", "t", "price", "z", "score", "strength", "is_valid", "first_row",
        "cross_ret20"), "direction-inputs")
    now = PR.last_rows(inputs)
    seven = PR.market_direction(now, [7], rates=C.market_buckets(inputs, [7]),
                                reversion=C.reversion_rates(inputs, [7]))
    seven = seven.select("series_id", F.col("date").alias("as_of"), "horizon", "prediction",
                         "confidence", F.lit(False).alias("neutral"), "prob_up", "prob_down",
                         "signal")
    return materialise(seven.unionByName(current_long(spark, d).select(*seven.columns)),
                       "directions")


def current_long(spark: SparkSession, d: str, usable=lambda report: report) -> DataFrame:
    """``usable`` tells which rows of the long report count."""
    signals = materialise(S.long_signals(market_base(spark, d)).select(
        "series_id", "date", "t", "price", "rev", "z60", "gate", "breakout", "extreme", "bucket"),
        "long-signals")
    decisions = materialise(B.long_decisions(signals), "long-decisions")
    return PR.long_now(signals, usable(B.long_report(decisions, ERAS)), B.gate_tables(decisions),
                       B.bucket_tables(decisions))


def projection_bases(spark: SparkSession, d: str) -> DataFrame:
    df = PR.last_rows(S.recent_volatility(price_base(spark, d)))
    return df.select("series_id", F.col("date").alias("base_date"),
                     F.col("price").alias("base_rate"), "daily_vol")


def ledger_history(spark: SparkSession, d: str) -> DataFrame:
    """A ledger replayed over the whole panel: every walk-forward decision, unsettled."""
    seven = B.direction_decisions(directions_input(spark, d), [7])
    rows_ = long_rows(spark, d).select("series_id", "date", "horizon", "pred").unionByName(
        seven.select("series_id", "date", "horizon", "pred"))
    return L.history_rows(rows_, stamp())


def health_state(spark: SparkSession, d: str) -> DataFrame:
    evaluated = H.evaluated_rows(S.market_z(market_base(spark, d)), long_rows(spark, d))
    return H.status(evaluated, panel.official(spark, d))


# ------------------------------------------------------------------ 2.5 aggregations

@query("agg_ingest_stats", Q.query(f"""
SELECT 'rates' AS load, count(*) AS n_rows, count(DISTINCT date) AS n_dates,
  count(*) FILTER (WHERE a IS NULL AND price IS NOT NULL) AS filled, max(date) AS last_date, NULL::double AS mean_score
FROM (SELECT *, {Q.carry('a')} AS price FROM (SELECT coalesce(o.series_id, m.series_id) AS series_id,
    coalesce(o.date, m.date) AS date, o.price AS a FROM official o FULL JOIN market m
    ON o.series_id = m.series_id AND o.date = m.date)) WHERE price IS NOT NULL
UNION ALL SELECT 'market', count(*), count(DISTINCT date), 0, max(date), NULL FROM market
UNION ALL SELECT 'news', count(*), count(DISTINCT date), 0, max(date), round(avg(sentiment), 6) + 0.0 FROM scored""",
                                   "official", "market", "scored"))
def agg_ingest_stats(spark, d):
    a = panel.official(spark, d).withColumnRenamed("price", "value")
    b = panel.market(spark, d)
    filled = J.date_union_ffill(a, b.withColumnRenamed("close", "value"))
    stats = lambda df, name, n_filled, score: df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("date").alias("n_dates"),
        n_filled.cast("bigint").alias("filled"), F.max("date").alias("last_date"),
        score.cast("double").alias("mean_score")).select(F.lit(name).alias("load"), "*")
    zero, none = F.max(F.lit(0)), F.max(F.lit(None).cast("double"))
    out = (stats(filled, "rates", F.count_if("filled"), none)
           .unionByName(stats(b, "market", zero, none))
           .unionByName(stats(scored_news(spark, d), "news", zero, F.avg("sentiment"))))
    return report(out)


@query("agg_daily_sentiment", Q.query(f"SELECT date, {r('sentiment')}, n_articles FROM sent", "sent"))
def agg_daily_sentiment(spark, d):
    return report(sentiment(spark, d))


@query("agg_source_counts", Q.query("""
SELECT source, count(*) AS n, max(date) AS last_date FROM news GROUP BY 1""", "news"))
def agg_source_counts(spark, d):
    return panel.news(spark, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.max("date").alias("last_date"))


_POOL_POLICY = {30: "weak_experimental", 60: "pure_rev", 90: "dual_pool"}
_pool_parts = " UNION ALL ".join(f"""
SELECT {n} AS horizon, series_id, bucket, rev, coalesce(sign(z60) = sign(rev), false) AS confirmed,
  {'high_vol' if n == 30 else 'false'} AS weak, ((rev > 0)::int = actual)::int AS hit
FROM (SELECT l.*, h.high_vol, {Q.actual(n).replace('lead(price', 'lead(l.price').replace('> price', '> l.price').replace(W, 'PARTITION BY l.series_id ORDER BY l.date')} AS actual
  FROM ls l JOIN hv h ON h.series_id = l.series_id AND h.t = l.t) WHERE t >= 120 AND bucket >= 0 AND actual IS NOT NULL"""
                                 for n in P.LONG_HORIZONS)


@query("agg_bucket_hits", Q.query(f"""
SELECT series_id, horizon, pool, bucket, sum(hit)::bigint AS wins, count(*) AS n, {r('rate=round(sum(hit)/count(*), 4)')}
FROM (SELECT *, 'plain' AS pool FROM ({_pool_parts}) UNION ALL SELECT *, 'confirmed' FROM ({_pool_parts}) WHERE confirmed
  UNION ALL SELECT *, 'weak' FROM ({_pool_parts}) WHERE weak) GROUP BY 1, 2, 3, 4""", "ls", "hv"))
def agg_bucket_hits(spark, d):
    df = B.bucket_tables(long_rows(spark, d, _POOL_POLICY, with_regime=True))
    return report(df, "series_id", "horizon", "pool", "bucket", "wins", "n", "rate")


@query("agg_gate_buckets", Q.query("SELECT series_id, horizon, cell, wins, n, rate FROM gates", "gates", gaps=True))
def agg_gate_buckets(spark, d):
    return report(B.gate_tables(long_rows(spark, d, gaps=panel.GAPS)), exact=("rate",))


_dir_report = f"""
SELECT series_id, horizon, count(*) AS windows, {r('accuracy=round(avg(hit), 4)',
    'confident_accuracy=coalesce(round(avg(hit) FILTER (WHERE conf > 0.65), 4), 0)')},
  count(*) FILTER (WHERE conf > 0.65) AS confident_windows,
  {r('confident_ratio=round(count(*) FILTER (WHERE conf > 0.65) / count(*), 4)',
     'baseline_majority=round(greatest(sum(actual), count(*) - sum(actual)) / count(*), 4)',
     "market_accuracy=coalesce(round(avg(hit) FILTER (WHERE signal = 'moex_dev'), 4), 0)")},
  count(*) FILTER (WHERE signal = 'moex_dev') AS market_windows,
  {r("market_confident_accuracy=coalesce(round(avg(hit) FILTER (WHERE signal = 'moex_dev' AND conf > 0.65), 4), 0)")},
  count(*) FILTER (WHERE signal = 'moex_dev' AND conf > 0.65) AS market_confident_windows
FROM (SELECT *, (pred = actual)::int AS hit FROM wf4) GROUP BY 1, 2"""


@query("agg_direction_report", Q.query(_dir_report, "wf4"))
def agg_direction_report(spark, d):
    return report(B.direction_report(B.direction_decisions(directions_input(spark, d), P.HORIZONS)))


_lrep_cols = ("series_id, horizon, policy, oos_emitted, eligible_days, oos_hit, coverage, modern_hit, "
              "modern_n, passed_gate, full_protocol")


@query("agg_long_report", Q.query(f"SELECT {_lrep_cols} FROM lrep", "lrep"))
def agg_long_report(spark, d):
    df = B.long_report(long_rows(spark, d), ERAS)
    return df.select(*[c.strip() for c in _lrep_cols.split(",")])


@query("agg_eras", Q.query(f"""
SELECT series_id, horizon, policy, {Q.ERA} AS era, round(avg(hit), 4) AS hit, count(*) AS n FROM ld WHERE emitted
GROUP BY 1, 2, 3, 4""", "ld"))
def agg_eras(spark, d):
    return B.long_era_table(long_rows(spark, d), ERAS)


@query("agg_pool_monotonic", Q.query(
    "SELECT series_id, horizon, bucket, hits, n, raw_rate, rate FROM calr", "calr"))
def agg_pool_monotonic(spark, d):
    counts = C.bucket_counts(directions_input(spark, d))
    rated = J.measured_or_default(counts, C.default_rates(spark), ["horizon", "bucket"])
    return C.pool_monotonic(rated).select("series_id", "horizon", "bucket", "hits", "n",
                                          "raw_rate", "rate")


def label_rows(spark, d, gaps=None):
    return E.label_rows(market_base(spark, d, gaps=gaps), split_year=SPLIT_YEAR, jump=PANEL_JUMP)


_stats = f"""count(*) AS n, count(*) FILTER (WHERE y3 = 1) AS up, count(*) FILTER (WHERE y3 = 0) AS flat,
  count(*) FILTER (WHERE y3 = -1) AS down,
  round(count(*) FILTER (WHERE y3 = 1) / count(*), 4) AS up_pct, round(count(*) FILTER (WHERE y3 = 0) / count(*), 4) AS flat_pct,
  round(count(*) FILTER (WHERE y3 = -1) / count(*), 4) AS down_pct,
  round(greatest(count(*) FILTER (WHERE y3 = 1), count(*) FILTER (WHERE y3 = 0), count(*) FILTER (WHERE y3 = -1)) / count(*), 4) AS ternary_purity,
  count(*) FILTER (WHERE r_fwd > 0) AS binary_up,
  round(greatest(count(*) FILTER (WHERE r_fwd > 0), count(*) FILTER (WHERE r_fwd <= 0)) / count(*), 4) AS binary_purity,
  count(*) FILTER (WHERE y3 <> 0) AS nonflat_n,
  round(greatest(count(*) FILTER (WHERE y3 = 1), count(*) FILTER (WHERE y3 = -1)) / nullif(count(*) FILTER (WHERE y3 <> 0), 0), 4) AS nonflat_purity,
  {r('mean_r=avg(r_fwd)', 'median_r=quantile_cont(r_fwd, 0.5)')}"""


def _layer_sql(source: str) -> str:
    sets = ", ".join(["(series_id)"] + [f"(series_id, {c})" for c in E.LAYERS])
    name = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in E.LAYERS) + " ELSE 'overall' END"
    key = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN {c}::varchar" for c in E.LAYERS) + " ELSE 'all' END"
    return (f"SELECT series_id, {name} AS layer, {key} AS layer_key, {_stats} FROM {source} "
            f"GROUP BY GROUPING SETS ({sets})")


@query("agg_label_layers", Q.query(_layer_sql("lbl"), "lbl", gaps=True))
def agg_label_layers(spark, d):
    return report(E.label_layers(label_rows(spark, d, panel.GAPS)))


@query("agg_distribution", Q.query(f"""
SELECT series_id, count(*) AS n, {r('mean=avg(r_fwd)', 'std=stddev_samp(r_fwd)', 'min=min(r_fwd)', 'max=max(r_fwd)')},
  round(count(*) FILTER (WHERE r_fwd > 0) / count(*), 4) AS share_positive,
  round(count(*) FILTER (WHERE abs(r_fwd) <= 0.01) / count(*), 4) AS share_flat, {r('mean_abs=avg(abs(r_fwd))')},
  {", ".join(r(f"q{round(x * 100):02d}=quantile_cont(r_fwd, {x})") for x in E.QUANTILES)} FROM lbl GROUP BY 1""", "lbl"))
def agg_distribution(spark, d):
    return report(E.distribution(label_rows(spark, d)))


@query("agg_missing", Q.query("""
SELECT series_id, count(*) AS total_rows, count(*) FILTER (WHERE rn <= 30) AS no_future_trailing,
  0::bigint AS null_price, 0::bigint AS null_price_later, count(*) FILTER (WHERE rn > 30) AS labelable
FROM (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM official) GROUP BY 1""",
                              "official"))
def agg_missing(spark, d):
    return E.missing_labels(price_base(spark, d))


@query("agg_changed_by_year", Q.query("""
SELECT series_id, year(date)::int AS year, count(*) AS changed_rows FROM official WHERE month(date) IN (2, 7) GROUP BY 1, 2""",
                                      "official"))
def agg_changed_by_year(spark, d):
    new = panel.official(spark, d)
    return E.changed_by_year(J.snapshot_changes(flipped(new), new))


_review = ", ".join(
    f"count(*) FILTER (WHERE s AND rn <= {k}) AS n_{n}, round(avg((prediction = realized)::int) FILTER (WHERE s AND rn <= {k}), 4) AS hit_{n}"
    for k, n in ((20, "20"), (50, "50"), (100, "100"), (10**9, "all")))
_review_sql = f"""
SELECT series_id, horizon, model_version, max(is_shadow)::int AS is_shadow, {_review}, min(as_of) AS first_as_of, max(as_of) AS last_as_of,
  count(*) FILTER (WHERE prediction IS NULL) AS neutral_days,
  count(*) FILTER (WHERE realized IS NULL AND prediction IS NOT NULL) AS pending_days
FROM (SELECT *, row_number() OVER (PARTITION BY series_id, horizon, model_version, s ORDER BY as_of DESC) AS rn
  FROM (SELECT *, realized IS NOT NULL AND prediction IS NOT NULL AS s FROM settled)) GROUP BY 1, 2, 3"""


def settled_ledger(spark, d):
    return L.settle(ledger_history(spark, d), panel.official(spark, d))


@query("agg_ledger_review", Q.query(_review_sql, "settled"))
def agg_ledger_review(spark, d):
    return L.review(settled_ledger(spark, d))


@query("agg_health", Q.query("SELECT * FROM health", "health"))
def agg_health(spark, d):
    return health_state(spark, d)


@query("agg_health_overall", Q.query("""
SELECT series_id, CASE WHEN bool_or(status = 'alert') THEN 'alert' WHEN bool_or(status = 'degraded') THEN 'degraded'
  ELSE 'healthy' END AS overall_status, bool_or(status = 'alert') AS any_alert, count(*) FILTER (WHERE status = 'alert') AS alerts
FROM (SELECT series_id, CASE WHEN horizon = 7 AND status <> 'no_data' THEN 'alert' ELSE status END AS status FROM health)
GROUP BY 1""", "health"))
def agg_health_overall(spark, d):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    # the bucket calibration is three days old (limit two), the long report too (limit seven)
    stale = H.staleness(spark, ts("2001-08-04 00:00:00"), ts("2001-08-01 00:00:00"),
                        ts("2001-08-01 00:00:00"))
    return H.overall(health_state(spark, d), stale)


Q.block("sc", ("ls",), f"""
SELECT series_id, era, y, 1 / (1 + exp(-greatest(-10, least(10, rev)))) AS prob FROM (SELECT series_id, {Q.ERA} AS era, rev,
  CASE WHEN lead(price, 30) OVER ({W}) > price THEN 1 WHEN lead(price, 30) OVER ({W}) IS NOT NULL THEN 0 END AS y FROM ls)
WHERE y IS NOT NULL AND rev IS NOT NULL""")


@query("agg_class_metrics", Q.query(f"""
SELECT b.series_id, b.era, b.n, {r('hit=b.hit', 'brier=b.brier',
    'auc=(k.rank_sum - k.pos * (k.pos + 1) / 2.0) / nullif(k.pos * (b.n - k.pos), 0)')}
FROM (SELECT series_id, era, count(*) AS n, avg(((prob >= 0.5)::int = y)::int) AS hit, avg((prob - y) * (prob - y)) AS brier
  FROM sc GROUP BY 1, 2) b
JOIN (SELECT series_id, era, sum(y) AS pos, sum(CASE WHEN y = 1 THEN rk END) AS rank_sum FROM (
  SELECT *, rank() OVER (PARTITION BY series_id, era ORDER BY prob)
    + (count(*) OVER (PARTITION BY series_id, era, prob) - 1) / 2.0 AS rk FROM sc) GROUP BY 1, 2) k
  ON k.series_id = b.series_id AND k.era = b.era""", "sc"))
def agg_class_metrics(spark, d):
    df = E.labels(S.reversion(price_base(spark, d)))
    rev = X.clip(F.col("rev"), -10.0, 10.0)
    scored = df.where(F.col("y2").isNotNull() & F.col("rev").isNotNull()).select(
        "series_id", B.era_of(F.col("date"), ERAS).alias("era"), F.col("y2").alias("y"),
        (1 / (1 + F.exp(-rev))).alias("prob"))
    return report(E.class_metrics(scored, ["series_id", "era"]))


# ------------------------------------------------------------------ 2.7 top-k, sets

@query("top_tail_n", Q.query("""
SELECT series_id, date, price FROM official QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 150""",
                             "official"))
def top_tail_n(spark, d):
    span = max(5 * 30, 60)
    n = min(max(span, 30), 2000)
    return sinks.latest_per_key(panel.official(spark, d), ["series_id"], "date", n).select(
        *KEYS, "price")


@query("top_k_moves", Q.query(f"""
SELECT series_id, from_date, to_date, {r('move=exp(m) - 1')} FROM (SELECT series_id, date AS from_date,
  lead(date) OVER ({W}) AS to_date, ln(lead(price) OVER ({W})) - ln(price) AS m FROM official)
WHERE m IS NOT NULL ORDER BY abs(m) DESC, series_id, from_date LIMIT 8""", "official"))
def top_k_moves(spark, d):
    return report(E.top_moves(price_base(spark, d)))


@query("top_latest_per_key", Q.query("""
SELECT series_id, horizon, model_version, as_of, prediction, realized FROM settled WHERE realized IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY series_id, horizon, model_version ORDER BY as_of DESC) <= 20""", "settled"))
def top_latest_per_key(spark, d):
    rows_ = settled_ledger(spark, d).where(F.col("realized").isNotNull())
    return sinks.latest_per_key(rows_, ["series_id", "horizon", "model_version"], "as_of", 20).select(
        "series_id", "horizon", "model_version", "as_of", "prediction", "realized")


_shadow_sql = """
SELECT series_id, date AS as_of, 30 AS horizon, 'shadow-30d-z-nogate' AS model_version, 1 AS is_shadow,
  CASE WHEN z60 IS NOT NULL THEN (z60 > 0)::int WHEN rev IS NOT NULL THEN (rev > 0)::int END AS prediction, NULL::double AS confidence FROM lastls
UNION ALL SELECT series_id, date, 60, 'shadow-60d-edist', 1, extreme, NULL FROM lastls
UNION ALL SELECT series_id, date, 60, 'shadow-60d-resonance', 1, CASE WHEN rev IS NOT NULL AND gate >= 2
  AND (rev > 0)::int = (z60 > 0)::int AND (z60 > 0)::int = extreme THEN (rev > 0)::int END, NULL FROM lastls"""
_record_sql = f"""
SELECT series_id, as_of, horizon, '2026.09-gate2' AS model_version, 0 AS is_shadow, prediction, confidence FROM pnow
UNION ALL SELECT * FROM ({_shadow_sql}) WHERE prediction IS NOT NULL"""
_REC = ("series_id", "as_of", "horizon", "model_version", "is_shadow", "prediction", "confidence")


def todays_rows(spark, d):
    production = L.production_rows(current_directions(spark, d), stamp())
    shadows = L.shadow_rows(PR.last_rows(S.long_signals(market_base(spark, d))), stamp())
    return production.unionByName(shadows)


@query("set_union_rows", Q.query(_record_sql, "pnow", "lastls"))
def set_union_rows(spark, d):
    return todays_rows(spark, d).select(*_REC)


@query("set_date_equality", Q.query("""
SELECT * FROM (SELECT 'flipped' AS other, true AS identical, 0::bigint AS only_official, 0::bigint AS only_other)
UNION ALL SELECT 'market', a = 0 AND b = 0, a, b FROM (SELECT
  (SELECT count(*) FROM (SELECT series_id, date FROM official EXCEPT SELECT series_id, date FROM market)) AS a,
  (SELECT count(*) FROM (SELECT series_id, date FROM market EXCEPT SELECT series_id, date FROM official)) AS b)""",
                                    "official", "market"))
def set_date_equality(spark, d):
    official = panel.official(spark, d).select(*KEYS)
    def compare(other, name):
        left = official.exceptAll(other).select(F.lit(1).alias("a"), F.lit(0).alias("b"))
        right = other.exceptAll(official).select(F.lit(0).alias("a"), F.lit(1).alias("b"))
        sums = left.unionByName(right).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"),
                                           F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
        return sums.select(F.lit(name).alias("other"),
                           ((F.col("a") == 0) & (F.col("b") == 0)).alias("identical"),
                           F.col("a").alias("only_official"), F.col("b").alias("only_other"))
    return compare(flipped(panel.official(spark, d)).select(*KEYS), "flipped").unionByName(
        compare(panel.market(spark, d).select(*KEYS), "market"))


# ------------------------------------------------------------------ 2.8 scalar keys

@query("txt_lexicon_score", Q.query(f"""
SELECT doc_id, {r('''score=CASE WHEN len(w) = 0 THEN 0.0 ELSE (len(list_filter(w, lambda x: x IN ('the','of','and')))
  - len(list_filter(w, lambda x: x IN ('to','a','in'))))::double / len(w) END''')}, len(w)::int AS words
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)"""))
def txt_lexicon_score(spark, d):
    text = F.col("text")
    return report(panel.table(spark, d, "documents").select(
        "doc_id", X.lexicon_score(text, list(panel.POSITIVE), list(panel.NEGATIVE)).alias("score"),
        F.size(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("words")))


_holidays = ", ".join(f"'{h}'" for h in P.FIXED_HOLIDAYS)
_future = f"""
SELECT series_id, base_date, row_number() OVER (PARTITION BY series_id ORDER BY d)::int AS k, d AS date
FROM (SELECT series_id, base_date, cast(unnest(generate_series(base_date + 1, base_date + 210, INTERVAL 1 DAY)) AS date) AS d
  FROM (SELECT series_id, max(date) AS base_date FROM official GROUP BY 1))
WHERE isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN ({_holidays})
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY d) <= 90"""


@query("cal_future_dates", Q.query(_future, "official"))
def cal_future_dates(spark, d):
    bases = panel.official(spark, d).groupBy("series_id").agg(F.max("date").alias("base_date"))
    return PJ.future_dates(bases, 90)


# ------------------------------------------------------------------ 2.4 calibration joins

@query("join_default_fallback", Q.query(
    "SELECT series_id, horizon, bucket, hits, n, raw_rate AS rate FROM raw", "raw"))
def join_default_fallback(spark, d):
    return J.measured_or_default(C.bucket_counts(directions_input(spark, d)),
                                 C.default_rates(spark), ["horizon", "bucket"]).select(
        "series_id", "horizon", "bucket", "hits", "n", "rate")


@query("join_nearest_key", Q.query("""
SELECT series_id, bucket, wanted, arg_min(horizon, abs(horizon - wanted) * 1000 + horizon)::int AS horizon,
  arg_min(rate, abs(horizon - wanted) * 1000 + horizon) AS rate
FROM calr CROSS JOIN (SELECT unnest([5, 14, 45, 75, 120]) AS wanted) GROUP BY 1, 2, 3""", "calr"))
def join_nearest_key(spark, d):
    table = C.market_buckets(directions_input(spark, d))
    wanted = F.array(*[F.lit(x) for x in (5, 14, 45, 75, 120)])
    requests = table.select("series_id", "bucket").distinct().withColumn("wanted", F.explode(wanted))
    return J.nearest_key(requests, table, "wanted", "horizon", ["rate"], ["series_id", "bucket"])


@query("join_segment_range", Q.query("""
SELECT s.series_id, s.k, g.a, g.b, g.prediction FROM
  (SELECT DISTINCT series_id, unnest(range(1, 91))::int AS k FROM official) s JOIN
  (SELECT series_id, prediction, horizon AS b, coalesce(lag(horizon) OVER (PARTITION BY series_id ORDER BY horizon), 0)::int AS a FROM pnow) g
  ON g.series_id = s.series_id AND s.k > g.a AND s.k <= g.b""", "official", "pnow"))
def join_segment_range(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy("series_id").orderBy("horizon")
    anchors = current_directions(spark, d).select(
        "series_id", F.coalesce(F.lag("horizon").over(w), F.lit(0)).alias("a"),
        F.col("horizon").alias("b"), "prediction")
    steps = (panel.official(spark, d).select("series_id").distinct()
             .withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(90)))))
    return J.segment_range(steps, anchors, ["series_id"]).select(
        "series_id", "k", "a", "b", "prediction")


_settle_cols = f"series_id, as_of, horizon, prediction, realized, {r('realized_ret')}, realized_date"


@query("join_ledger_settle", Q.query(f"SELECT {_settle_cols} FROM settled", "settled"))
def join_ledger_settle(spark, d):
    return report(settled_ledger(spark, d), "series_id", "as_of", "horizon", "prediction", "realized",
                  "realized_ret", "realized_date")


_METRICS = ("oos_hit", "oos_emitted", "coverage", "eligible_days")


@query("join_metrics_delta", Q.query(f"""
SELECT a.series_id, a.horizon, a.metric, {r('before=a.value', 'after=b.value', 'delta=b.value - a.value')}
FROM (SELECT series_id, horizon, unnest(['oos_hit','oos_emitted','coverage','eligible_days']) AS metric,
    unnest([oos, emitted::double, round(emitted / n, 4), n::double]) AS value FROM (
    SELECT series_id, horizon, round(avg(hit), 4) AS oos, count(*) FILTER (WHERE pred IS NOT NULL) AS emitted, count(*) AS n
    FROM ({Q.long_rows({30: "pure_rev", 60: "pure_rev", 90: "pure_rev"})}) GROUP BY 1, 2)) a
JOIN (SELECT series_id, horizon, unnest(['oos_hit','oos_emitted','coverage','eligible_days']) AS metric,
    unnest([oos_hit, oos_emitted::double, coverage, eligible_days::double]) AS value FROM lrep) b
  ON a.series_id = b.series_id AND a.horizon = b.horizon AND a.metric = b.metric""", "ls", "lrep"))
def join_metrics_delta(spark, d):
    signals = S.long_signals(market_base(spark, d))
    before = B.long_report(B.long_decisions(signals, {n: "pure_rev" for n in P.LONG_HORIZONS}), ERAS)
    after = B.long_report(B.long_decisions(signals), ERAS)
    return report(J.metrics_delta(before, after, ["series_id", "horizon"], list(_METRICS)))


# ------------------------------------------------------------------ 2.9 composites

_mr_union = " UNION ALL ".join(
    f"SELECT series_id, date, {n} AS horizon, mr_pred AS prediction, mr_conf AS confidence, round(mr_up, 3) AS prob_up, "
    f"mr_signal AS signal, mr_confirms AS confirms FROM ({Q.reversion_sql(n, Q.DEFAULT[n][4] + '::double').replace('FROM src', 'FROM din')})"
    for n in P.HORIZONS)


@query("sig_meanrev_direction", Q.query(
    f"SELECT series_id, date, horizon, prediction, {r('confidence', 'prob_up')}, signal, confirms FROM ({_mr_union})", "din"))
def sig_meanrev_direction(spark, d):
    long = B.per_horizon(directions_input(spark, d), P.HORIZONS,
                         [*KEYS, "score", "strength", "is_valid", "cross_ret20"],
                         base=P.DEFAULT_REVERSION_RATE.get)
    out = B.reversion_decision(long, F.col("base"))
    return report(out.select(*KEYS, "horizon", F.col("mr_pred").alias("prediction"),
                             F.col("mr_conf").alias("confidence"),
                             F.round("mr_up", 3).alias("prob_up"), F.col("mr_signal").alias("signal"),
                             F.col("mr_confirms").alias("confirms")))


_dir_cols = ("series_id, date, horizon, signal, prediction, "
             f"{r('confidence', 'prob_up', 'prob_down')}, z_bucket, weak_signal")


@query("sig_market_direction", Q.query(" UNION ALL ".join(
    f"SELECT {_dir_cols} FROM ({Q.direction_sql(n)})" for n in P.HORIZONS), "din"))
def sig_market_direction(spark, d):
    return report(PR.market_direction(directions_input(spark, d)), *KEYS, "horizon", "signal",
                  "prediction", "confidence", "prob_up", "prob_down", "z_bucket", "weak_signal")


_wf_rows = f"SELECT series_id, date, horizon, signal, pred, {r('conf')}, actual FROM wf4"


@query("bt_direction_walkforward", Q.query(_wf_rows, "wf4"))
def bt_direction_walkforward(spark, d):
    """All four horizons; strong rows of 30 and 60 depend on earlier strong rows."""
    df = B.direction_decisions(directions_input(spark, d), P.HORIZONS)
    return report(df, *KEYS, "horizon", "signal", "pred", "conf", "actual")


@query("bt_direction_walkforward_mid", Q.query(_dir_report.replace("FROM wf4", "FROM wf4 WHERE horizon IN (30, 60)"), "wf4"))
def bt_direction_walkforward_mid(spark, d):
    """The report of horizons 30 and 60."""
    return report(B.direction_report(B.direction_decisions(directions_input(spark, d), [30, 60])))


query("bt_direction_walkforward_all", Q.query(_wf_rows, "wf4"))(bt_direction_walkforward)
query("agg_direction_report_all", Q.query(_dir_report, "wf4"))(agg_direction_report)


@query("cal_market_buckets", Q.query(
    "SELECT series_id, horizon, bucket, hits, n, rate FROM calr UNION ALL "
    "SELECT series_id, horizon, 'meanrev', hits, n, rate FROM mrr", "calr", "mrr"))
def cal_market_buckets(spark, d):
    inputs = directions_input(spark, d)
    cols = ["series_id", "horizon", "bucket", "hits", "n", "rate"]
    mr = C.reversion_rates(inputs).withColumn("bucket", F.lit("meanrev"))
    return C.market_buckets(inputs).select(*cols).unionByName(mr.select(*cols))


@query("cal_freshness", Q.query("""
SELECT series_id, horizon, bucket, age_sec, age_sec BETWEEN 0 AND 172800 AS is_usable,
  CASE WHEN age_sec BETWEEN 0 AND 172800 THEN rate ELSE default_rate END AS rate
FROM (SELECT c.*, r.default_rate, epoch(timestamp '2001-08-03 00:00:00')::bigint
    - epoch(timestamp '2001-08-03 18:00:00' - (ascii(c.series_id) - 48) * INTERVAL 16 HOUR)::bigint AS age_sec
  FROM calr c JOIN raw r ON r.series_id = c.series_id AND r.horizon = c.horizon AND r.bucket = c.bucket)""", "calr", "raw"))
def cal_freshness(spark, d):
    # generation stamps spread over the series so that fresh, stale and future ones occur
    hours = (F.ascii("series_id") - 48) * 16
    made = F.lit("2001-08-03 18:00:00").cast("timestamp") - F.make_interval(hours=hours)
    table = C.market_buckets(directions_input(spark, d)).withColumn("generated_ts", made)
    out = C.usable_rates(table, F.lit("2001-08-03 00:00:00").cast("timestamp"))
    return out.select("series_id", "horizon", "bucket", "age_sec", "is_usable", "rate")


_ld_cols = f"series_id, date, horizon, policy, pred, actual, hit, emitted, confirmed"


@query("bt_long_walkforward", Q.query(f"SELECT {_ld_cols} FROM ld", "ld"))
def bt_long_walkforward(spark, d):
    return long_rows(spark, d).select(*[c.strip() for c in _ld_cols.split(",")])


def _pool_policy_sql() -> str:
    parts = []
    for n, p in {30: "weak_experimental", 60: "resonance_only", 90: "dual_pool"}.items():
        frame = f"(PARTITION BY series_id, bucket ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {n} PRECEDING)"
        ok = "t >= 120 AND actual IS NOT NULL"
        pools = ", ".join(
            f"count(*) FILTER (WHERE {ok} AND {c}) OVER {frame} AS n_{k}, "
            f"count(*) FILTER (WHERE {ok} AND {c} AND rev_up = actual) OVER {frame} AS h_{k}"
            for k, c in (("plain", "true"), ("confirmed", "confirmed"), ("weak", "high_vol")))
        used = {"weak_experimental": "high_vol AND n_weak >= 20 AND h_weak / n_weak >= 0.55",
                "dual_pool": "CASE WHEN confirmed THEN n_confirmed >= 20 AND h_confirmed / n_confirmed >= 0.70 "
                             "ELSE n_plain >= 20 AND h_plain / n_plain >= 0.70 END",
                "resonance_only": "confirmed AND n_confirmed >= 20 AND h_confirmed / n_confirmed >= 0.70"}[p]
        parts.append(f"""SELECT series_id, date, {n} AS horizon, '{p}' AS policy,
            {'high_vol' if p == 'weak_experimental' else 'true'} AS eligible, CASE WHEN {used} THEN rev_up END AS pred, actual
          FROM (SELECT *, {pools} FROM (SELECT l.series_id, l.date, l.t, l.bucket, h.high_vol, (l.rev > 0)::int AS rev_up,
              coalesce(sign(l.z60) = sign(l.rev), false) AS confirmed, CASE WHEN l.later > l.price THEN 1 WHEN l.later IS NOT NULL THEN 0 END AS actual
            FROM (SELECT *, lead(price, {n}) OVER ({W}) AS later FROM ls) l JOIN hv h ON h.series_id = l.series_id AND h.t = l.t))
          WHERE t >= 120 AND bucket >= 0 AND actual IS NOT NULL""")
    return " UNION ALL ".join(parts)


@query("bt_long_walkforward_pools", Q.query(_pool_policy_sql(), "ls", "hv"))
def bt_long_walkforward_pools(spark, d):
    policy = {30: "weak_experimental", 60: "resonance_only", 90: "dual_pool"}
    df = long_rows(spark, d, policy, with_regime=True)
    return df.select(*KEYS, "horizon", "policy", "eligible", "pred", "actual")


def _long_sql(reason: str, source: str) -> str:
    return f"""
SELECT series_id, date AS as_of, horizon, policy, CASE WHEN ok THEN pred END AS prediction,
  {r('confidence=CASE WHEN ok THEN round(conf, 3) END', 'prob_up=CASE WHEN ok THEN round(CASE WHEN pred = 1 THEN conf ELSE 1 - conf END, 3) END')},
  CASE WHEN ok AND policy = 'moex_z' AND z60 IS NOT NULL THEN 'moex_spread' WHEN ok AND policy = 'extreme_dist' THEN policy ELSE 'long_reversion' END AS signal,
  CASE WHEN ok THEN NOT passed_gate END AS experimental, CASE WHEN ok THEN source END AS confidence_source,
  CASE WHEN ok THEN case_n::bigint END AS case_n, neutral_reason
FROM (SELECT * EXCLUDE (neutral_reason), {reason} AS neutral_reason, ({reason}) IS NULL AS ok FROM {source})"""


_long_columns = ("series_id", "as_of", "horizon", "policy", "prediction", "confidence", "prob_up", "signal", "experimental",
                 "confidence_source", "case_n", "neutral_reason")


@query("pred_long_now", Q.query(_long_sql("neutral_reason", "plong"), "plong"))
def pred_long_now(spark, d):
    return report(current_long(spark, d), *_long_columns)


@query("pred_long_stale", Q.query(_long_sql(
    "CASE WHEN (ascii(series_id) - 49) * 4 - 1 BETWEEN 0 AND 7 THEN neutral_reason ELSE 'calibration_unavailable' END", "plong"), "plong"))
def pred_long_stale(spark, d):
    """Reports made one day after the run, and 3, 7, 11 and 15 days before it: the first and the last two make every horizon neutral."""
    run = F.lit("2001-08-03 00:00:00").cast("timestamp")
    days = (F.ascii("series_id") - 49) * 4 - 1
    made = F.timestamp_seconds(F.unix_timestamp(run) - days * 86_400)
    return report(current_long(spark, d, lambda rows: PR.usable_report(rows, made, run)), *_long_columns)


@query("fc_projection", Q.query(f"""
SELECT series_id, horizon, k, date, round(exp(path), 4) AS rate, round(least(exp(path - half), exp(path)), 4) AS low,
  {r('half_band=half')}
FROM (SELECT s.series_id, c.horizon, s.k, s.date, ln(b.price) + g.da + (g.db - g.da) * pow((s.k - g.a) / (g.b - g.a), 0.7) AS path,
    CASE WHEN b.vol > 0 THEN b.vol * sqrt(s.k) * CASE c.horizon WHEN 30 THEN 1.51 WHEN 60 THEN 1.81 WHEN 90 THEN 2.02 ELSE 1.0 END
      ELSE 0.012 * sqrt(s.k / c.horizon) * (1.0 + c.horizon / 90.0) END AS half
  FROM ({_future}) s
  JOIN pnow c ON c.series_id = s.series_id AND s.k <= c.horizon
    AND NOT (c.horizon = 7 AND c.prediction IS NULL AND NOT c.neutral)
  JOIN (SELECT series_id, horizon AS b, db, coalesce(lag(horizon) OVER w, 0) AS a, coalesce(lag(db) OVER w, 0.0) AS da FROM (
      SELECT series_id, horizon, CASE WHEN prediction IS NOT NULL AND confidence >= 0.55 THEN (CASE WHEN prediction = 0 THEN -1 ELSE 1 END)
        * 0.0161 * greatest(0, least(1, (confidence - 0.5) * 2)) * sqrt(horizon / 7.0) ELSE 0.0 END AS db FROM pnow)
    WINDOW w AS (PARTITION BY series_id ORDER BY horizon)) g ON g.series_id = s.series_id AND s.k > g.a AND s.k <= g.b
  JOIN (SELECT series_id, price, CASE WHEN count(r) OVER {rows(60)} >= 20 THEN stddev_samp(r) OVER {rows(60)} END AS vol
    FROM ret QUALIFY t = max(t) OVER (PARTITION BY series_id)) b ON b.series_id = s.series_id)""", "pnow", "official", "ret"))
def fc_projection(spark, d):
    # daily volatility of the test panel is so high that the upper band reaches 1e9, where
    # four digits are beyond double precision; the log half-width carries the same information
    df = PJ.project(current_directions(spark, d), projection_bases(spark, d))
    return report(df, "series_id", "horizon", "k", "date", "rate", "low", "half_band",
                  exact=("rate", "low"))


@query("sig_term_divergence", Q.query("""
SELECT a.series_id, a.horizon, a.prediction, min(b.horizon) AS short_horizon FROM pnow a JOIN pnow b
  ON b.series_id = a.series_id AND b.horizon < a.horizon AND b.prediction <> a.prediction GROUP BY 1, 2, 3""", "pnow"))
def sig_term_divergence(spark, d):
    return PR.term_divergence(current_directions(spark, d))


@query("led_record", Q.query(f"""
SELECT model_version, is_shadow, horizon, count(*) AS n_rows, count(prediction) AS n_directions
FROM ({_record_sql}) GROUP BY 1, 2, 3""", "pnow", "lastls"))
def led_record(spark, d):
    """Recording the same day twice adds the rows once."""
    rows_ = materialise(todays_rows(spark, d), "ledger-rows")
    empty = spark.createDataFrame([], rows_.schema)
    once = L.record(empty, rows_)
    twice = L.record(once, rows_)
    return twice.groupBy("model_version", "is_shadow", "horizon").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("prediction").alias("n_directions"))


@query("job_daily", Q.query(f"""
SELECT p.series_id, p.as_of, p.horizon, p.prediction, {r('confidence')}, p.horizon::int AS points,
  CASE WHEN p.horizon = 7 THEN 0 ELSE row_number() OVER (PARTITION BY p.series_id ORDER BY p.horizon) END::int AS anchors, l.ledger_rows
FROM pnow p JOIN (SELECT series_id, count(*) AS ledger_rows FROM ({_record_sql}) GROUP BY 1) l ON l.series_id = p.series_id""",
                            "pnow", "lastls"))
def job_daily(spark, d):
    """The published forecast of a day that was run twice, and how many rows the ledger has."""
    folder = f"{shared_dir(spark)}/daily-{uuid.uuid4().hex}"
    signals = materialise(PR.last_rows(S.long_signals(market_base(spark, d))), "daily-signals")
    directions, bases = current_directions(spark, d), materialise(projection_bases(spark, d), "daily-bases")
    official = materialise(panel.official(spark, d), "daily-official")
    for _ in range(2):
        day = daily.run(spark, folder, directions, bases, signals, official, stamp())
        if day.ledger_error:
            raise RuntimeError(day.ledger_error)
    told = sinks.published(spark, f"{folder}/{daily.FORECAST}")
    kept = sinks.published(spark, f"{folder}/{daily.LEDGER}").groupBy("series_id").agg(F.count(F.lit(1)).alias("ledger_rows"))
    return report(told.select("series_id", "as_of", "horizon", "direction.prediction", "direction.confidence",
                              F.size("forecast").alias("points"), F.size("term_anchors").alias("anchors")).join(kept, "series_id"))


@query("led_shadow", Q.query(f"SELECT * FROM ({_shadow_sql.replace('FROM lastls', 'FROM ls')}) WHERE prediction IS NOT NULL", "ls"))
def led_shadow(spark, d):
    """The shadow rules replayed over every day of the panel."""
    return L.shadow_rows(S.long_signals(market_base(spark, d)), stamp()).select(*_REC)


@query("led_settle", Q.query("""
SELECT horizon, count(*) AS n_rows, count(realized) AS n_settled, count(*) FILTER (WHERE realized = prediction) AS n_hits,
  max(realized_date) AS last_realized FROM settled GROUP BY 1""", "settled"))
def led_settle(spark, d):
    return settled_ledger(spark, d).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("realized").alias("n_settled"),
        F.count_if(F.col("realized") == F.col("prediction")).alias("n_hits"),
        F.max("realized_date").alias("last_realized"))


@query("led_review", Q.query(f"""SELECT series_id, horizon, n_all, hit_all, n_20, hit_20, neutral_days, pending_days
FROM ({_review_sql})""", "settled"))
def led_review(spark, d):
    return L.review(settled_ledger(spark, d)).select(
        "series_id", "horizon", "n_all", "hit_all", "n_20", "hit_20", "neutral_days", "pending_days")


@query("mon_health", Q.query("""
SELECT h.series_id, h.horizon, h.rolling_acc, h.n, h.status, o.overall_status FROM health h JOIN (
  SELECT series_id, CASE WHEN bool_or(status = 'alert') THEN 'alert' WHEN bool_or(status = 'degraded') THEN 'degraded'
    ELSE 'healthy' END AS overall_status FROM health GROUP BY 1) o ON o.series_id = h.series_id""", "health"))
def mon_health(spark, d):
    state = health_state(spark, d)
    verdict = H.overall(state).select("series_id", "overall_status")
    return state.join(verdict, "series_id").select("series_id", "horizon", "rolling_acc", "n",
                                                   "status", "overall_status")


@query("card_predict", Q.query("""
SELECT p.series_id, p.as_of, p.horizon, p.prediction, p.confidence, coalesce(w.acc, l.oos_hit) AS overall, h.rolling_acc AS rolling,
  h.n AS rolling_n, h.status FROM pnow p
LEFT JOIN (SELECT series_id, horizon, coalesce(round(avg((pred = actual)::int) FILTER (WHERE signal = 'moex_dev'), 4), 0) AS acc
  FROM wf WHERE horizon = 7 GROUP BY 1, 2) w ON w.series_id = p.series_id AND w.horizon = p.horizon
LEFT JOIN lrep l ON l.series_id = p.series_id AND l.horizon = p.horizon
LEFT JOIN health h ON h.series_id = p.series_id AND h.horizon = p.horizon""", "pnow", "wf", "lrep", "health"))
def card_predict(spark, d):
    long_report = B.long_report(long_rows(spark, d), ERAS)
    direction = B.direction_report(B.direction_decisions(directions_input(spark, d), [7]))
    card = H.prediction_card(current_directions(spark, d), direction, long_report,
                             health_state(spark, d))
    return card.select("series_id", "as_of", "horizon", "prediction", "confidence", "overall",
                       "rolling", "rolling_n", "status")


@query("exp_label_diagnostic_layers", Q.query(
    f"SELECT 'raw' AS frame, * FROM ({_layer_sql('lbl')}) UNION ALL "
    f"SELECT 'clean', * FROM ({_layer_sql('(SELECT * FROM lbl WHERE clean)')})", "lbl", gaps=True))
def exp_label_diagnostic_layers(spark, d):
    rows_ = label_rows(spark, d, panel.GAPS)
    raw = E.label_layers(rows_).select(F.lit("raw").alias("frame"), "*")
    return report(raw.unionByName(
        E.label_layers(rows_.where("clean")).select(F.lit("clean").alias("frame"), "*")))


def factor_long(spark, d):
    df = E.labels(S.reversion(feat.build(full_base(spark, d))))
    names = [*feat.ALL, "rev"]
    return feat.unpivot(df, names, ["series_id", "date", "t", "y2"])


@query("win_oos_threshold", Q.query(f"""
SELECT series_id, date, feature, {r('threshold')}, (value > threshold)::int AS pred FROM fac
WHERE t >= 120 AND value IS NOT NULL AND n_known >= 30 AND y2 IS NOT NULL""", "fac"))
def win_oos_threshold(spark, d):
    df = E.factor_decisions(factor_long(spark, d)).where(F.col("rule") == "median")
    return report(df, *KEYS, "feature", "threshold", "pred")


@query("exp_single_factor", Q.query("SELECT * FROM frep", "frep"))
def exp_single_factor(spark, d):
    return E.factor_report(E.factor_decisions(factor_long(spark, d)), ERAS)


@query("agg_factor_ranking", Q.query("""
SELECT series_id, feature, rule AS best_rule, hit AS best_hit, n AS best_n, era3_hit AS best_last_era_hit FROM frep
QUALIFY row_number() OVER (PARTITION BY series_id, feature ORDER BY hit DESC, rule) = 1""", "frep"))
def agg_factor_ranking(spark, d):
    rep = E.factor_report(E.factor_decisions(factor_long(spark, d)), ERAS)
    return E.factor_ranking(rep).orderBy(F.col("best_last_era_hit").desc_nulls_last())


def _range_sql() -> str:
    from walkloom.plans.registry import ORACLES
    preds = ORACLES["win_range_algos"]
    head, body = preds.rsplit("\nSELECT series_id, date, horizon, algo, pred FROM (", 1)
    body = "SELECT series_id, date, t, horizon, algo, pred FROM (" + body
    acts = " UNION ALL ".join(f"SELECT series_id, t, {n} AS horizon, {Q.actual(n)} AS actual FROM al" for n in P.HORIZONS)
    return f"""{head}
SELECT p.series_id, p.horizon, p.algo, count(pred) AS n, round(avg((pred = actual)::int), 4) AS hit,
  count(pred) FILTER (WHERE p.t >= s.rows * 0.6) AS n_late,
  round(avg((pred = actual)::int) FILTER (WHERE p.t >= s.rows * 0.6), 4) AS hit_late,
  round(count(pred) / count(*), 3) AS coverage
FROM ({body}) p JOIN ({acts}) a ON a.series_id = p.series_id AND a.t = p.t AND a.horizon = p.horizon
JOIN (SELECT series_id, count(*) AS rows FROM al GROUP BY 1) s ON s.series_id = p.series_id
WHERE actual IS NOT NULL GROUP BY 1, 2, 3"""


@query("exp_range_algos", _range_sql())
def exp_range_algos(spark, d):
    base = price_base(spark, d)
    sizes = base.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
    return E.range_report(E.range_decisions(base), sizes)


_edge = f"coalesce(abs(ln(lead(p) OVER ({W})) - ln(p)) > 0.20, false)"
_edge_price = f"abs(ln(lead(price) OVER ({W})) - ln(price)) > 0.20"


_audit_sql = f"""
SELECT o.series_id, count(*) AS rows_old, count(*) AS rows_new, true AS dates_identical,
  count(*) FILTER (WHERE changed) AS changed_rows, count(DISTINCT ratio) FILTER (WHERE changed) AS n_ratios,
  min(ratio) FILTER (WHERE changed) AS ratio_min, max(ratio) FILTER (WHERE changed) AS ratio_max,
  any_value(e.edges_old) AS edges_old, any_value(e.edges_new) AS edges_new
FROM (SELECT series_id, round({_flip}, 6) <> round(price, 6) AS changed, round(price / ({_flip}), 6) AS ratio FROM official) o
JOIN (SELECT a.series_id, a.n AS edges_old, b.n AS edges_new FROM
  (SELECT series_id, count(*) FILTER (WHERE e) AS n FROM (SELECT series_id, {_edge} AS e FROM (SELECT series_id, date, {_flip} AS p FROM official)) GROUP BY 1) a
  JOIN (SELECT series_id, count(*) FILTER (WHERE e) AS n FROM (SELECT series_id, {_edge} AS e FROM (SELECT series_id, date, price AS p FROM official)) GROUP BY 1) b
  ON a.series_id = b.series_id) e ON e.series_id = o.series_id GROUP BY 1"""


_ratios_sql = f"""SELECT series_id, round(price / ({_flip}), 6) AS ratio, count(*) AS changed_rows FROM official
WHERE round({_flip}, 6) <> round(price, 6) GROUP BY 1, 2"""


@query("exp_snapshot_audit_summary", Q.query(_audit_sql, "official"))
def exp_snapshot_audit_summary(spark, d):
    new = panel.official(spark, d)
    return E.audit_summary(flipped(new), new)


@query("exp_snapshot_audit_ratios", Q.query(_ratios_sql, "official"))
def exp_snapshot_audit_ratios(spark, d):
    new = panel.official(spark, d)
    return E.changed_ratios(J.snapshot_changes(flipped(new), new))


def _sections(**parts: DataFrame) -> DataFrame:
    """One table of several, the name of each in a column ``section``; columns a part lacks are NULL."""
    named = [df.select(F.lit(name).alias("section"), "*") for name, df in parts.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def _united(**parts: str) -> str:
    return " UNION ALL BY NAME ".join(f"SELECT '{name}' AS section, * FROM ({sql})" for name, sql in parts.items())


def _contamination_sql(source: str) -> str:
    spans = (20, 60, 120, 150, 252)
    return f"""SELECT series_id, count(*) FILTER (WHERE edge_day = 1) AS n_edge_days,
  {", ".join(f"count(*) FILTER (WHERE h{n} = 1) AS rows_{n}" for n in spans)}
FROM (SELECT *, {", ".join(f"max(edge_day) OVER {rows(n)} AS h{n}" for n in spans)}
  FROM (SELECT series_id, date, coalesce(edge OR lag(edge, 1, false) OVER ({W}), false)::int AS edge_day
    FROM (SELECT series_id, date, {_edge_price} AS edge FROM {source}))) GROUP BY 1"""


_dist_sql = f"""SELECT series_id, count(*) AS n, {r('mean=avg(r_fwd)', 'std=stddev_samp(r_fwd)', 'min=min(r_fwd)', 'max=max(r_fwd)')},
  round(count(*) FILTER (WHERE r_fwd > 0) / count(*), 4) AS share_positive,
  round(count(*) FILTER (WHERE abs(r_fwd) <= 0.01) / count(*), 4) AS share_flat, {r('mean_abs=avg(abs(r_fwd))')},
  {", ".join(r(f"q{round(x * 100):02d}=quantile_cont(r_fwd, {x})") for x in E.QUANTILES)} FROM lbl GROUP BY 1"""
_missing_sql = """SELECT series_id, count(*) AS total_rows, count(*) FILTER (WHERE rn <= 30) AS no_future_trailing,
  0::bigint AS null_price, 0::bigint AS null_price_later, count(*) FILTER (WHERE rn > 30) AS labelable
FROM (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM official) GROUP BY 1"""


_diagnostic_sql = Q.query(_united(
    layers=f"SELECT 'raw' AS frame, * FROM ({_layer_sql('lbl')}) UNION ALL "
           f"SELECT 'clean', * FROM ({_layer_sql('(SELECT * FROM lbl WHERE clean)')})",
    missing=_missing_sql, distribution=_dist_sql,
    jumps=f"""SELECT series_id, date, next_date, {r('next_move')}, edge FROM (
      SELECT series_id, date, lead(date) OVER ({W}) AS next_date, ln(lead(price) OVER ({W})) - ln(price) AS next_move,
        {_edge_price} AS edge FROM official) WHERE edge""",
    contamination=_contamination_sql("official")), "lbl", "official", gaps=True)


@query("exp_label_diagnostic", _diagnostic_sql)
def exp_label_diagnostic(spark, d):
    """Layers with missing reasons, distribution, jump edges and contamination counts."""
    prices = price_base(spark, d)
    jumps = S.jumps(prices)
    return _sections(layers=exp_label_diagnostic_layers(spark, d), missing=E.missing_labels(prices),
                     distribution=report(E.distribution(label_rows(spark, d, panel.GAPS))),
                     jumps=report(jumps.where("edge"), *KEYS, "next_date", "next_move", "edge"),
                     contamination=contamination(jumps))


_values = """SELECT series_id, horizon, unnest(['oos_hit','oos_emitted','coverage','eligible_days']) AS metric,
  unnest([oos_hit, oos_emitted::double, coverage, eligible_days::double]) AS value FROM """


_whole_audit_sql = Q.query(_united(
    summary=_audit_sql, ratios=_ratios_sql,
    changed_by_year="SELECT series_id, year(date)::int AS year, count(*) AS changed_rows FROM official WHERE month(date) IN (2, 7) GROUP BY 1, 2",
    islands=f"""SELECT series_id, min(date) AS start, max(date) AS "end", count(*) AS rows FROM (
      SELECT *, row_number() OVER ({W}) - row_number() OVER (PARTITION BY series_id, flag ORDER BY date) AS g
      FROM (SELECT series_id, date, month(date) IN (2, 7) AS flag FROM official)) WHERE flag GROUP BY series_id, g""",
    contamination=_contamination_sql("official_old"),
    metrics=f"""SELECT a.series_id, a.horizon, a.metric, {r('before=a.value', 'after=b.value', 'delta=b.value - a.value')}
      FROM ({_values} lrep_old) a JOIN ({_values} lrep) b
        ON a.series_id = b.series_id AND a.horizon = b.horizon AND a.metric = b.metric"""), "official", "lrep", "lrep_old")


@query("exp_snapshot_audit", _whole_audit_sql)
def exp_snapshot_audit(spark, d):
    """Summary with the ratios of changed rows, changes by year, islands of changed rows, contamination of the old snapshot and metric deltas."""
    new = panel.official(spark, d)
    old = flipped(new)
    changes = J.snapshot_changes(old, new)
    metrics = [B.long_report(B.long_decisions(S.long_signals(J.aligned(side, panel.market(spark, d), panel.oil(spark, d)))), ERAS)
               for side in (old.drop("nominal"), new)]
    return _sections(summary=E.audit_summary(old, new), ratios=E.changed_ratios(changes), changed_by_year=E.changed_by_year(changes),
                     islands=S.islands(J.snapshot_compare(old, new), "changed"),
                     contamination=contamination(S.jumps(old)),
                     metrics=report(J.metrics_delta(*metrics, ["series_id", "horizon"], list(_METRICS))))


query("exp_label_diagnostic_all", _diagnostic_sql)(exp_label_diagnostic)
query("exp_snapshot_audit_all", _whole_audit_sql)(exp_snapshot_audit)
