"""Structured Streaming twins of the live paths.

Inputs are file sources; state is bounded by watermarks; results go to folders. Each job
takes its trigger, so the same code runs as a 60-second refresh or once over what is
available.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from walkloom import params as P
from walkloom.sources import sinks

REFRESH = {"processingTime": "60 seconds"}
AVAILABLE_NOW = {"availableNow": True}
EVENT_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                "value double, props string")


def file_stream(spark: SparkSession, folder: str, schema: str, name_filter: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def minute_bars(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One-minute candles per series, works on streams and on batches.

    The close is the value of the highest event id: ids grow with time and break ties.
    """
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", delay)
    bars = (stamped.groupBy(F.col("event_type").alias("series_id"), F.window("ts", "1 minute"))
            .agg(F.max("value").alias("high"), F.min("value").alias("low"),
                 F.count(F.lit(1)).alias("n"), F.min_by("value", "event_id").alias("open"),
                 F.max_by("value", "event_id").alias("close")))
    return bars.select("series_id", F.col("window.start").cast("timestamp_ntz").alias("minute"),
                       "open", "high", "low", "close", "n")


def last_bar(bars: DataFrame, run_ts: Column | None = None, within_days: int = 7) -> DataFrame:
    """Newest bar with a close per series, at most a week old.

    On a stream the running maximum per series is the state: one row per series.
    """
    rows = bars.where(F.col("close").isNotNull())
    if run_ts is not None:
        rows = rows.where((F.col("minute") > run_ts - F.make_dt_interval(days=F.lit(within_days)))
                          & (F.col("minute") <= run_ts))
    pick = F.max_by(F.struct("close"), "minute")
    return (rows.groupBy("series_id").agg(F.max("minute").alias("minute"), pick.alias("p"))
            .select("series_id", "minute", F.col("p.close").alias("price")))


def run_to_folder(stream: DataFrame, path: str, checkpoint: str, trigger: dict,
                  mode: str = "append") -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str,
                trigger: dict, mode: str = "append") -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).foreachBatch(each)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


class Deltas:
    """A keyed table as a published base and one delta per batch: what a batch costs depends on the batch,
    not on the history.

    A batch writes the folder of its own number; one that runs again after a failure writes the same
    folder again, so nothing is applied twice. Readers resolve keys over base and deltas;
    ``compact``, on a schedule of its own, folds the deltas into a new base and switches to it in one step.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, delta_schema: T.StructType | None = None):
        self.spark, self.root, self.schema = spark, root, schema
        self.delta_schema = delta_schema or schema

    def seed(self, df: DataFrame) -> None:
        sinks.publish(df, f"{self.root}/base", keep_previous_if_empty=False, tag="0")

    def base(self) -> DataFrame:
        return sinks.published(self.spark, f"{self.root}/base", schema=self.schema)

    def folded(self) -> int:
        """Batches below this number are in the base."""
        return int(sinks.current_version(self.spark, f"{self.root}/base")[1:].split("-")[0])

    def append(self, batch_id: int, df: DataFrame) -> None:
        df.select(*self.delta_schema.names).write.mode("overwrite").parquet(f"{self.root}/deltas/b={batch_id}")

    def pending(self) -> DataFrame:
        """Deltas that are not in the base, with their batch number ``b``."""
        schema = T.StructType([*self.delta_schema.fields, T.StructField("b", T.LongType())])
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/deltas")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/deltas").where(F.col("b") >= self.folded())

    def view(self, resolve: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        return resolve(self.base(), self.pending())

    def compact(self, resolve: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        pending = self.pending()
        last = pending.agg(F.max("b")).first()[0]
        if last is not None:
            sinks.publish(resolve(self.base(), pending.where(F.col("b") <= last)), f"{self.root}/base",
                          keep_previous_if_empty=False, tag=str(last + 1))


def newest_values(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Revisions overwrite stored rows column by column; the last non-null value wins by (b, seq)."""
    def resolve(base: DataFrame, deltas: DataFrame) -> DataFrame:
        values = [c for c in deltas.columns if c not in (*keys, "seq", "b")]
        newest = deltas.groupBy(*keys).agg(*[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("b", "seq"))).alias(c) for c in values])
        return sinks.upsert_coalesce(base, newest, keys)
    return resolve


def open_rows_filled(keys: list[str], cols=("realized", "realized_ret", "realized_date")):
    """The first outcome of a key fills an open row of the ledger; settled rows stay."""
    def resolve(base: DataFrame, deltas: DataFrame) -> DataFrame:
        first = deltas.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct("b", *cols)).alias("_o"))
        open_row = F.col("realized").isNull() & F.col("prediction").isNotNull()
        joined = base.join(first, keys, "left")
        return joined.select(*[F.when(open_row, F.col("_o")[c]).otherwise(F.col(c)).alias(c)
                               if c in cols else F.col(c) for c in base.columns])
    return resolve


def first_rows(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A stored row stays; of new rows with one key the first batch counts."""
    def resolve(base: DataFrame, deltas: DataFrame) -> DataFrame:
        rest = [c for c in base.columns if c not in keys]
        first = deltas.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("b", *rest)).alias("_f"))
        new = first.join(base.select(*keys), keys, "left_anti").select(
            *[F.col(c) if c in keys else F.col("_f")[c].alias(c) for c in base.columns])
        return base.unionByName(new)
    return resolve


def dedup(stream: DataFrame, keys: list[str], time_col: str, delay: str) -> DataFrame:
    """First row per key; keys are remembered for the watermark delay."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def freshness_pick(official: DataFrame, live: DataFrame, forecasts: DataFrame,
                   run_ts: Column, by: list[str]) -> DataFrame:
    """Shown price and forecast per series.

    The live price wins when it is positive and its stamp is at most 60 seconds ahead of the
    run; a forecast older than 600 seconds counts as missing. ``official`` (by, price, as_of),
    ``live`` (by, live_price, fetched_ts), ``forecasts`` (by, prediction, updated_ts).
    """
    secs = lambda ts: F.unix_timestamp(run_ts) - F.unix_timestamp(ts)
    live_ok = (F.col("live_price") > 0) & (secs("fetched_ts") >= -60)
    fresh = secs("updated_ts") <= P.FORECAST_STALE_SEC
    joined = official.join(live, by, "left").join(forecasts, by, "left")
    usable = F.when(live_ok, F.col("live_price"))
    return joined.select(*by, F.coalesce(usable, "price").alias("shown_price"),
                         F.when(usable.isNotNull(), "live").otherwise("official").alias("basis"),
                         F.when(fresh, F.col("prediction")).alias("prediction"),
                         F.coalesce(~fresh, F.lit(True)).alias("is_stale"))
