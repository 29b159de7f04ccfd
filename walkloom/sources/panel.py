"""Daily panels derived from the landed star-schema tables.

Every panel is aggregated to one row per (series_id, date) before anything else
happens to it. Aggregation combines map-side, so a series that holds a third of
the raw rows still arrives as at most one row per day and partition; from there on a
series is bounded by the calendar (36 525 rows per century), whatever the raw volume.
Means are integer sums of cents divided by a count, so they do not depend on the
order in which partial sums are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Gaps for the queries that are about them: a market and a rate that begin late, closed days.
GAPS = {"market": {"since": "1996-06-01"}, "oil": {"closed": (7, 14, 21, 28)}, "key_rate": {"since": "1996-01-01"}}
OFFICIAL_SCALE = 100000.0
KEY_RATE_SCALE = 1000000.0
# fixed values: the default lexicon for the test corpus
POSITIVE = ("the", "of", "and")
NEGATIVE = ("to", "a", "in")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


def mean_of_cents(total: Column, n: Column, scale: float) -> Column:
    return total.cast("double") / n / scale


def official(spark: SparkSession, sf_dir: str, series: str | None = "o_orderpriority") -> DataFrame:
    """(series_id, date, price, cross_price); ``series=None`` makes one series 'ALL'.

    The cross price is the all-series mean of the day and comes from the same
    aggregate, so the raw table is scanned once.
    """
    orders = table(spark, sf_dir, "orders")
    if series == "c_nationkey":
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        orders = orders.join(customers, orders.o_custkey == customers.c_custkey)
    name = F.lit("ALL") if series is None else F.col(series).cast("string")
    per_series = (orders.select(name.alias("series_id"),
                                F.to_date("o_orderdate").alias("date"),
                                cents(F.col("o_totalprice")).alias("cents"))
                  .groupBy("series_id", "date")
                  .agg(F.sum("cents").alias("total"), F.count(F.lit(1)).alias("n")))
    cross = (per_series.groupBy("date")
             .agg(F.sum("total").alias("cross_total"), F.sum("n").alias("cross_n")))
    return per_series.join(cross, "date").select(
        "series_id", "date",
        mean_of_cents(F.col("total"), F.col("n"), OFFICIAL_SCALE).alias("price"),
        mean_of_cents(F.col("cross_total"), F.col("cross_n"), OFFICIAL_SCALE).alias("cross_price"))


def market(spark: SparkSession, sf_dir: str, series: str | None = "o_orderpriority",
           since: str | None = None) -> DataFrame:
    """(series_id, date, close, high, low) of the traded market; ``since`` lets it start mid-history."""
    items = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") != "N")
    if since:
        items = items.where(F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz"))
    items = items.select("l_orderkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice")
    orders = table(spark, sf_dir, "orders")
    if series == "c_nationkey":
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        orders = orders.join(customers, orders.o_custkey == customers.c_custkey)
    name = F.lit("ALL") if series is None else F.col(series).cast("string")
    keys = orders.select("o_orderkey", name.alias("series_id"))
    return (items.join(keys, items.l_orderkey == keys.o_orderkey)
            .groupBy("series_id", "date")
            .agg(mean_of_cents(F.sum(cents(F.col("l_extendedprice"))), F.count(F.lit(1)),
                               OFFICIAL_SCALE).alias("close"),
                 (F.max("l_extendedprice") / 1000).alias("high"),
                 (F.min("l_extendedprice") / 1000).alias("low")))


def oil(spark: SparkSession, sf_dir: str, closed: tuple[int, ...] = ()) -> DataFrame:
    """(date, value): a macro series; on the days of the month in ``closed`` it has no value."""
    items = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "N")
    if closed:
        items = items.where(~F.dayofmonth("l_shipdate").isin(*closed))
    return (items.groupBy(F.to_date("l_shipdate").alias("date"))
            .agg(mean_of_cents(F.sum(cents(F.col("l_extendedprice"))), F.count(F.lit(1)),
                               OFFICIAL_SCALE).alias("value")))


def key_rate(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """(date, value): one decision per quarter, from ``since`` on."""
    orders = table(spark, sf_dir, "orders")
    if since:
        orders = orders.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz"))
    return (orders.groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
            .agg(F.min(F.to_date("o_orderdate")).alias("date"),
                 mean_of_cents(F.sum(cents(F.col("o_totalprice"))), F.count(F.lit(1)),
                               KEY_RATE_SCALE).alias("value"))
            .select("date", "value"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, text, title, source): scores use the whole text, the stored title is 200 chars."""
    day = F.date_add(F.lit("1995-01-01").cast("date"),
                     ((F.col("doc_id") * 7) % 2400).cast("int"))
    return table(spark, sf_dir, "documents").select(
        day.alias("date"), "text", F.substring("text", 1, 200).alias("title"), "source")

