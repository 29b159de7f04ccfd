"""Registered streaming queries: each drains a file source once and returns the result table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkloom.operators import backtest as B
from walkloom.operators import joins as J
from walkloom.operators import ledger as L
from walkloom.operators import signals as S
from walkloom.oracle import ctes as Q
from walkloom.oracle.ctes import r
from walkloom.plans.registry import query, report
from walkloom.plans.reports import ERAS, ledger_history
from walkloom.session import materialise, shared_dir
from walkloom.sources import panel
from walkloom.streaming import live

KEYS = ["series_id", "date"]


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark, d):
    return live.file_stream(spark, d, live.EVENT_SCHEMA, "events.parquet")


def _drain(query_) -> None:
    query_.awaitTermination()


_bars_sql = """SELECT series_id, minute, high, low, close, n FROM bars"""


@query("str_minute_bars", Q.query(_bars_sql, "bars"))
def str_minute_bars(spark, d):
    """Candles from the event stream; complete output through one update per window."""
    out = _folder(spark, "bars")

    def each(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    bars = live.minute_bars(_events(spark, d))
    _drain(live.run_batches(bars, each, _folder(spark, "ck"), live.AVAILABLE_NOW, "update"))
    emitted = spark.read.parquet(out)
    # a later batch replaces an earlier state of the same window
    newest = F.max_by(F.struct("high", "low", "close", "n"), "b")
    return emitted.groupBy("series_id", "minute").agg(newest.alias("x")).select(
        "series_id", "minute", "x.*")


@query("str_last_bar", Q.query(f"""
SELECT series_id, max(minute) AS minute, max_by(close, minute) AS price FROM bars
WHERE minute > (SELECT max(minute) FROM bars) - INTERVAL 7 DAY GROUP BY 1""", "bars"))
def str_last_bar(spark, d):
    bars = live.minute_bars(panel.table(spark, d, "events"))
    newest = bars.agg(F.max("minute").alias("m")).scalar()
    return live.last_bar(bars, newest)


@query("str_last_bar_stream", Q.query("""
SELECT event_type AS series_id, date_trunc('minute', max(ts)) AS minute, max_by(value, event_id) FILTER (WHERE m = mx) AS price
FROM (SELECT *, date_trunc('minute', ts) AS m, max(date_trunc('minute', ts)) OVER (PARTITION BY event_type) AS mx FROM events) GROUP BY 1"""))
def str_last_bar_stream(spark, d):
    """State of one row per series: the newest event of the newest minute."""
    out = _folder(spark, "last")
    events = _events(spark, d).withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    order = F.struct("minute", "event_id")
    last = events.groupBy(F.col("event_type").alias("series_id")).agg(
        F.max_by(F.struct("minute", F.col("value").alias("price")), order).alias("x"))
    last = last.select("series_id", "x.*")

    def each(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    _drain(live.run_batches(last, each, _folder(spark, "ck"), live.AVAILABLE_NOW, "complete"))
    emitted = spark.read.parquet(out)
    newest = F.max_by(F.struct("minute", "price"), "b")
    return emitted.groupBy("series_id").agg(newest.alias("x")).select("series_id", "x.*")


@query("str_micro_refresh", Q.query("SELECT series_id, horizon, policy, oos_emitted, eligible_days, oos_hit FROM lrep", "lrep"))
def str_micro_refresh(spark, d):
    """Orders arrive in four files. A batch adds its sums to the panel and recomputes the report of the series it
    touches; the newest report of a series counts."""
    orders = panel.table(spark, d, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    landed = _folder(spark, "orders-in")
    orders.repartition(4, F.dayofyear("o_orderdate") % 4).write.parquet(landed)
    sums = T.StructType.fromDDL("series_id string, date date, total bigint, n bigint")
    cols = ("series_id", "horizon", "policy", "oos_emitted", "eligible_days", "oos_hit")
    parts = live.Deltas(spark, _folder(spark, "sums"), sums)
    parts.seed(spark.createDataFrame([], sums))
    market, oil = (materialise(df, "refresh-static") for df in (panel.market(spark, d), panel.oil(spark, d)))
    reports = _folder(spark, "refresh")
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(landed)

    def each(batch, batch_id):
        batch = batch.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(
            F.sum(panel.cents(F.col("o_totalprice"))).alias("total"), F.count(F.lit(1)).alias("n"))
        parts.append(batch_id, batch)
        stored = parts.view(lambda base, deltas: base.unionByName(deltas.drop("b")))
        touched = parts.pending().where(F.col("b") == batch_id).select("series_id").distinct()
        prices = (stored.join(touched, "series_id", "left_semi").groupBy("series_id", "date")
                  .agg(panel.mean_of_cents(F.sum("total"), F.sum("n"), panel.OFFICIAL_SCALE).alias("price"))
                  .withColumn("cross_price", F.lit(None).cast("double")))
        rep = B.long_report(B.long_decisions(S.long_signals(J.aligned(prices, market, oil))), ERAS)
        rep.select(*cols).write.mode("overwrite").parquet(f"{reports}/b={batch_id}")

    _drain(live.run_batches(stream, each, _folder(spark, "ck"), live.AVAILABLE_NOW))
    newest = F.max_by(F.struct(*cols[2:]), "b")
    found = spark.read.parquet(reports).groupBy("series_id", "horizon").agg(newest.alias("x"))
    return found.select("series_id", "horizon", "x.*")


@query("str_ledger_dedup", Q.query("""
SELECT series_id, as_of, horizon, model_version, prediction, 1 AS n FROM led""", "led"))
def str_ledger_dedup(spark, d):
    """The same ledger rows arrive twice, in several files; every key is stored once."""
    rows_ = ledger_history(spark, d)
    landed = _folder(spark, "ledger-in")
    for _ in range(2):
        rows_.repartition(3, "horizon").write.mode("append").parquet(landed)
    keys = ["series_id", *L.KEY]
    store = live.Deltas(spark, _folder(spark, "ledger"), rows_.schema)
    store.seed(rows_.where(F.lit(False)))
    stream = spark.readStream.schema(rows_.schema).option("maxFilesPerTrigger", 2).parquet(landed)
    _drain(live.run_batches(stream, lambda batch, i: store.append(i, batch), _folder(spark, "ck"), live.AVAILABLE_NOW))
    store.compact(live.first_rows(keys))
    return store.base().groupBy("series_id", "as_of", "horizon", "model_version").agg(
        F.max("prediction").alias("prediction"), F.count(F.lit(1)).cast("int").alias("n"))


@query("str_settle", Q.query(f"""
SELECT series_id, as_of, horizon, prediction, realized, {r('realized_ret')}, realized_date FROM settled""", "settled"))
def str_settle(spark, d):
    """Outcomes arrive year by year and fill the open rows of the stored ledger."""
    ledger = ledger_history(spark, d)
    outcomes = L.outcomes(panel.official(spark, d))
    landed = _folder(spark, "outcomes")
    (outcomes.withColumn("year", F.year("realized_date")).repartition("year").write.partitionBy("year").parquet(landed))
    store = live.Deltas(spark, _folder(spark, "ledger"), ledger.schema, outcomes.schema)
    store.seed(ledger)
    schema = T.StructType([*outcomes.schema.fields, T.StructField("year", T.IntegerType())])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(landed)
    _drain(live.run_batches(stream, lambda batch, i: store.append(i, batch), _folder(spark, "ck"), live.AVAILABLE_NOW))
    return report(store.view(live.open_rows_filled(["series_id", "as_of", "horizon"])), "series_id", "as_of", "horizon",
                  "prediction", "realized", "realized_ret", "realized_date")


@query("str_late_revision", Q.query(f"""
SELECT coalesce(s.series_id, b.series_id) AS series_id, coalesce(s.date, b.date) AS date, coalesce(b.price, s.price) AS price,
  CASE WHEN b.series_id IS NOT NULL THEN 'cbr' ELSE s.source END AS source
FROM (SELECT series_id, date, price, 'erapi' AS source FROM official WHERE date <= date '2000-06-30') s
FULL JOIN (SELECT series_id, date, close AS price FROM market WHERE date >= date '2000-01-01') b
  ON s.series_id = b.series_id AND s.date = b.date""", "official", "market"))
def str_late_revision(spark, d):
    """Market rows arrive as official revisions in several files and overwrite the store."""
    stored = panel.official(spark, d).where(F.col("date") <= F.lit("2000-06-30").cast("date")).select(
        *KEYS, "price", F.lit("erapi").alias("source"))
    revisions = (panel.market(spark, d).where(F.col("date") >= F.lit("2000-01-01").cast("date"))
                 .select(*KEYS, F.col("close").alias("price"), F.lit("cbr").alias("source"),
                         F.lit(1).alias("seq")))
    landed = _folder(spark, "revisions")
    revisions.repartition(4, "series_id").write.parquet(landed)
    store = live.Deltas(spark, _folder(spark, "rates"), stored.schema, revisions.schema)
    store.seed(stored)
    stream = spark.readStream.schema(revisions.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    _drain(live.run_batches(stream, lambda batch, i: store.append(i, batch), _folder(spark, "ck"), live.AVAILABLE_NOW))
    return store.view(live.newest_values(list(KEYS)))


@query("str_freshness_pick", Q.query("""
SELECT o.series_id, CASE WHEN ok THEN live_price ELSE price END AS shown_price, CASE WHEN ok THEN 'live' ELSE 'official' END AS basis,
  CASE WHEN age <= 600 THEN prediction END AS prediction, coalesce(age > 600, true) AS is_stale
FROM (SELECT o.series_id, o.price, l.live_price, l.live_price > 0 AND l.live_price IS NOT NULL AND o.k <> 2 AS ok, o.k * 300 AS age, p.prediction
  FROM (SELECT series_id, max_by(price, date) AS price, ascii(series_id) - 48 AS k FROM official GROUP BY 1) o
  LEFT JOIN (SELECT series_id, max_by(close, date) AS live_price FROM market GROUP BY 1) l ON l.series_id = o.series_id
  LEFT JOIN (SELECT series_id, CASE WHEN rev > 0 THEN 1 ELSE 0 END AS prediction FROM lastls) p ON p.series_id = o.series_id) o""",
                                     "official", "market", "lastls"))
def str_freshness_pick(spark, d):
    # stamps spread over the series: forecasts 5 to 25 minutes old, one live stamp from the future
    k = F.ascii("series_id") - 48
    run = F.lit("2001-08-01 12:00:00").cast("timestamp")
    official = panel.official(spark, d).groupBy("series_id").agg(F.max_by("price", "date").alias("price"))
    quotes = (panel.market(spark, d).groupBy("series_id").agg(F.max_by("close", "date").alias("live_price"))
              .withColumn("fetched_ts", F.when(k == 2, run + F.make_dt_interval(mins=F.lit(5))).otherwise(run)))
    newest = S.reversion(J.aligned(panel.official(spark, d)))
    forecasts = (newest.groupBy("series_id").agg(F.max_by("rev", "t").alias("rev"))
                 .select("series_id", F.when(F.col("rev") > 0, 1).otherwise(0).alias("prediction"))
                 .withColumn("updated_ts", run - F.make_dt_interval(secs=(k * 300).cast("decimal(18,6)"))))
    return live.freshness_pick(official, quotes, forecasts, run, ["series_id"])
