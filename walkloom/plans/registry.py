"""Named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkloom.functions.frames import r6
from walkloom.operators import joins as J
from walkloom.sources import panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


# exact means of cents and their carried copies: reported as they are
EXACT = ("price", "cross_price", "close", "high", "low", "market_close", "oil", "rate",
         "old_price", "new_price")


def report(df: DataFrame, *cols, exact=EXACT) -> DataFrame:
    """Selected columns with derived doubles at report precision."""
    df = df.select(*cols) if cols else df
    rounds = lambda f: isinstance(f.dataType, T.DoubleType) and f.name not in exact
    return df.select(*[r6(F.col(f.name)).alias(f.name) if rounds(f) else F.col(f.name)
                       for f in df.schema.fields])


def sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Daily mean score of the news, from whole texts."""
    return (scored_news(spark, d).groupBy("date")
            .agg(F.avg("sentiment").alias("sentiment"), F.count(F.lit(1)).alias("n_articles")))


def scored_news(spark: SparkSession, d: str) -> DataFrame:
    from walkloom.functions.scalars import lexicon_score
    return panel.news(spark, d).select(
        "date", "title", "source",
        lexicon_score(F.col("text"), list(panel.POSITIVE), list(panel.NEGATIVE)).alias("sentiment"))


def full_base(spark: SparkSession, d: str, series: str | None = "o_orderpriority", gaps: dict | None = None) -> DataFrame:
    """Aligned table with market, oil, sentiment and key rate; ``gaps`` as in ``panel.GAPS``."""
    of = lambda name: (gaps or {}).get(name, {})
    return J.aligned(panel.official(spark, d, series), panel.market(spark, d, series, **of("market")),
                     panel.oil(spark, d, **of("oil")), sentiment(spark, d), panel.key_rate(spark, d, **of("key_rate")))


def price_base(spark: SparkSession, d: str, series: str | None = "o_orderpriority") -> DataFrame:
    """Official prices only, with row positions."""
    return J.aligned(panel.official(spark, d, series))


def market_base(spark: SparkSession, d: str, series: str | None = "o_orderpriority", gaps: dict | None = None) -> DataFrame:
    """Official prices with market and oil; ``gaps`` as in ``panel.GAPS``."""
    of = lambda name: (gaps or {}).get(name, {})
    return J.aligned(panel.official(spark, d, series), panel.market(spark, d, series, **of("market")),
                     panel.oil(spark, d, **of("oil")))
