"""Yearly expanding walk-forward of classifiers.

All series of the panel train one model together. Labels whose outcome falls on or after
the first day of the predicted year are left out of training (``embargo_rows`` later rows of the
same series must already be known); 0 disables that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom import params as P
from walkloom.functions import scalars as X
from walkloom.functions.frames import SERIES, series_window
from walkloom.operators import backtest as B
from walkloom.operators import experiments as E
from walkloom.operators import yearly
from walkloom.session import materialise

MODELS = tuple(yearly.MODELS)


def dataset(features_df: DataFrame, features: list[str], embargo_rows: int = P.LABEL_HORIZON,
            by=SERIES) -> DataFrame:
    """Labelled rows with ``known_on``: the date on which the label became known."""
    w = series_window(by)
    known = F.lead("date", embargo_rows).over(w) if embargo_rows else F.col("date")
    df = E.labels(features_df, P.LABEL_HORIZON, by).withColumn("known_on", known)
    return df.where(F.col("y2").isNotNull()).select(
        *by, "date", F.year("date").alias("year"), "known_on", F.col("y2").cast("double").alias("y"),
        "rev", *[F.col(c).cast("double").alias(c) for c in features if c != "rev"])


def walk_forward(data: DataFrame, features: list[str], model: str, skip_years: int = 2,
                 min_train: int = 100, by=SERIES, **settings) -> DataFrame:
    """(by, date, y, prob) predictions of every year after the first ``skip_years``."""
    return yearly.walk_forward(data, features, model, list(by), skip_years, min_train, **settings)


def report(data: DataFrame, features: list[str], models=MODELS,
           eras=P.DEFAULT_ERAS, by=SERIES) -> DataFrame:
    """n, hit, AUC and Brier per model, overall and per era, next to two baselines."""
    data = materialise(data, "learn-data")
    scored = [materialise(walk_forward(data, features, m, by=by), "learn-scores").withColumn("model", F.lit(m)) for m in models]
    rev = X.clip(F.col("rev"), -10.0, 10.0)
    scored.append(data.where(F.col("rev").isNotNull()).select(
        *by, "date", F.col("y").cast("int").alias("y"), (1 / (1 + F.exp(-rev))).alias("prob"),
        F.lit("baseline_rev_sign").alias("model")))
    table = reduce(DataFrame.unionByName, scored)
    spans = F.array_compact(F.array(F.lit("all"), B.era_of(F.col("date"), eras)))
    table = table.withColumn("era", F.explode(spans))
    metrics = E.class_metrics(table, ["model", "era"])
    ups = data.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("up"))
    none = F.lit(None).cast("double")
    majority = ups.select(F.lit("baseline_majority").alias("model"), F.lit("all").alias("era"), "n",
                          F.round(F.greatest("up", 1 - F.col("up")), 6).alias("hit"),
                          none.alias("brier"), none.alias("auc"))
    return metrics.unionByName(majority.select(*metrics.columns))
