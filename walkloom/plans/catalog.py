"""Everything registered, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from walkloom.operators import backtest as B
from walkloom.operators import signals as S
from walkloom.plans import (  # noqa: F401  (they register queries)
    landing,
    learning,
    reports,
    streams,
    windows,
)
from walkloom.plans.registry import ORACLES, QUERIES, price_base

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = S.long_signals(price_base(spark, sf_dir, series=None))
    return B.long_report(B.long_decisions(signals, {30: "pure_rev", 60: "pure_rev", 90: "pure_rev"}))
