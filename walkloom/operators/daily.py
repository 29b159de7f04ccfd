"""The daily job: the newest directions become a published forecast, then the ledger is kept.

The forecast is one row per series and horizon with its path, its direction and the anchors of the
shorter horizons, published as a new version behind a pointer. Only after that are the day's directions and
shadow rules recorded and due rows settled, in a ledger published the same way. A failure there is
reported and leaves both the forecast and the earlier ledger as they are. Running a day again changes nothing.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walkloom.functions.frames import SERIES
from walkloom.operators import ledger as L
from walkloom.operators import projection as PJ
from walkloom.session import materialise
from walkloom.sources import sinks

log = logging.getLogger(__name__)

FORECAST, LEDGER = "forecast", "ledger"


@dataclass
class Day:
    """What a run did. ``ledger_error`` is None if the ledger was kept."""

    published: bool
    ledger_error: str | None


def forecast(directions: DataFrame, bases: DataFrame, today: Column | None = None, by=SERIES) -> DataFrame:
    """One nested row per series and horizon.

    ``as_of`` never lies after ``today`` (a quote may carry the date of the next day). ``term_anchors`` holds the shorter
    horizons and the row's own, nothing for the shortest; ``forecast`` is empty where no chart can be drawn.
    """
    by = list(by)
    path = PJ.project(directions, bases, by).groupBy(*by, "horizon").agg(
        F.array_sort(F.collect_list(F.struct("k", "date", "rate", "low", "high"))).alias("forecast"))
    shorter = Window.partitionBy(*by).orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    anchors = F.collect_list(F.struct("horizon", "prediction", "confidence")).over(shorter)
    told = [c for c in directions.columns if c not in (*by, "as_of", "horizon")]
    cap = F.least(F.col("as_of"), today) if today is not None else F.col("as_of")
    rows = directions.select(*by, cap.alias("as_of"), "horizon", F.struct(*told).alias("direction"),
                             F.when(F.size(anchors) > 1, anchors).otherwise(F.array().cast(
                                 "array<struct<horizon:int,prediction:int,confidence:double>>")).alias("term_anchors"))
    nothing = F.array().cast(path.schema["forecast"].dataType)
    return (rows.join(bases.select(*by, F.round("base_rate", 4).alias("base_rate")), by)
            .join(path, [*by, "horizon"], "left").withColumn("forecast", F.coalesce("forecast", nothing)))


def keep_ledger(rows: DataFrame, official: DataFrame, folder: str) -> None:
    """Record rows whose key is new and settle what is due, as a new version of the ledger in ``folder``."""
    spark = rows.sparkSession
    known = sinks.is_published(spark, folder)
    earlier = sinks.published(spark, folder, schema=rows.schema) if known else spark.createDataFrame([], rows.schema)
    sinks.publish(L.settle(L.record(earlier, rows), official), folder)


def run(spark: SparkSession, folder: str, directions: DataFrame, bases: DataFrame, signals: DataFrame, official: DataFrame,
        created_ts: Column, today: Column | None = None) -> Day:
    """``directions`` and ``bases`` as in ``projection.project``, ``signals`` the newest signal rows for the shadow rules."""
    directions = materialise(directions, "daily-directions")
    published = sinks.publish(forecast(directions, bases, today), f"{folder}/{FORECAST}")
    try:
        rows = L.production_rows(directions, created_ts).unionByName(L.shadow_rows(signals, created_ts))
        keep_ledger(materialise(rows, "daily-rows"), official, f"{folder}/{LEDGER}")
    except Exception as e:  # the forecast stands, whatever happens to the ledger
        log.warning("the ledger was not kept: %s", e)
        return Day(published, f"{type(e).__name__}: {e}")
    return Day(published, None)
