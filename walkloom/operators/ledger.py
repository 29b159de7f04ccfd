"""Append-only prediction ledger: record, settle once outcomes arrive, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom import params as P
from walkloom.functions.frames import SERIES, series_window
from walkloom.sources import sinks

KEY = ["as_of", "horizon", "model_version"]
# fixed values: fields left out of the stored meta document
META_DROPPED = ("prob_up", "prob_down", "forecast")
COLUMNS = ["series_id", "as_of", "horizon", "model_version", "is_shadow", "prediction",
           "confidence", "meta", "created_ts", "realized", "realized_ret", "realized_date"]


def meta_document(df: DataFrame, exclude=()) -> Column:
    """All decision fields as JSON, without the probabilities and the path."""
    cols = [c for c in df.columns if c not in META_DROPPED and c not in exclude]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def production_rows(directions: DataFrame, created_ts: Column,
                    version: str = P.MODEL_VERSION) -> DataFrame:
    """Ledger rows of the published directions, abstentions (NULL) included."""
    return directions.select(
        "series_id", "as_of", "horizon", F.lit(version).alias("model_version"),
        F.lit(0).alias("is_shadow"), F.col("prediction").cast("int").alias("prediction"),
        F.col("confidence").cast("double").alias("confidence"),
        meta_document(directions, ("series_id", "as_of")).alias("meta"),
        created_ts.alias("created_ts"), *_unsettled())


def _unsettled():
    return [F.lit(None).cast("int").alias("realized"),
            F.lit(None).cast("double").alias("realized_ret"),
            F.lit(None).cast("date").alias("realized_date")]


def shadow_rows(signals: DataFrame, created_ts: Column) -> DataFrame:
    """Three observed-only rules on the given signal rows; silent rules make no row."""
    z, rev, ext = F.col("z60"), F.col("rev"), F.col("extreme")
    z_up, rev_up = F.when(z > 0, 1).otherwise(0), F.when(rev > 0, 1).otherwise(0)
    has_z, has_rev = z.isNotNull(), rev.isNotNull()
    gated = F.when(has_z & (F.col("gate") >= P.GATE_MIN_CONFIRMS), z_up)
    text = lambda **kv: F.to_json(F.struct(*[v.alias(k) for k, v in kv.items()]))
    rule = lambda version, n, pred, meta: F.struct(
        F.lit(version).alias("model_version"), F.lit(n).alias("horizon"),
        pred.cast("int").alias("prediction"), meta.alias("meta"))
    rules = F.array(
        rule(P.SHADOW_Z_NO_GATE, 30, F.when(has_z, z_up).when(has_rev, rev_up),
             F.when(has_z, text(z=F.round(z, 4))).otherwise(text(fallback=F.lit("rev")))),
        rule(P.SHADOW_EXTREME, 60, ext, text(extreme_dist=F.round(ext.cast("double"), 4))),
        rule(P.SHADOW_RESONANCE, 60,
             F.when(has_rev & (rev_up == gated) & (gated == ext), rev_up),
             text(rev_dir=rev_up, z_dir=gated, ed_dir=ext, gate=F.col("gate"))))
    rows = signals.select("series_id", F.col("date").alias("as_of"), F.explode(rules).alias("r"))
    return (rows.where(F.col("r.prediction").isNotNull())
            .select("series_id", "as_of", "r.horizon", "r.model_version",
                    F.lit(1).alias("is_shadow"), "r.prediction",
                    F.lit(None).cast("double").alias("confidence"), "r.meta",
                    created_ts.alias("created_ts"), *_unsettled()))


def record(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows whose key is new; running it again changes nothing."""
    return sinks.insert_ignore(ledger, rows, ["series_id", *KEY])


def outcomes(official: DataFrame, horizons=P.HORIZONS, by=SERIES) -> DataFrame:
    """(by, as_of, horizon, log return, date) of every day whose outcome is known."""
    w = series_window(by)
    price = F.col("price")
    rows = official.select(*by, F.col("date").alias("as_of"), price, F.array(*[
        F.struct(F.lit(n).alias("horizon"), F.lead("price", n).over(w).alias("later"),
                 F.lead("date", n).over(w).alias("realized_date")) for n in horizons]).alias("d"))
    rows = rows.select(*by, "as_of", "price", F.explode("d").alias("d")).select(
        *by, "as_of", "price", "d.*").where(F.col("later").isNotNull())
    return rows.select(*by, "as_of", "horizon",
                       (F.log("later") - F.log("price")).alias("realized_ret"),
                       F.when(F.col("later") > F.col("price"), 1).otherwise(0).alias("realized"),
                       "realized_date")


def settle(ledger: DataFrame, official: DataFrame, horizons=P.HORIZONS) -> DataFrame:
    """Fill outcomes of due rows. Abstentions, unknown dates and settled rows stay as they are."""
    keys = ["series_id", "as_of", "horizon"]
    cols = ["realized", "realized_ret", "realized_date"]
    new = outcomes(official, horizons).select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    joined = ledger.join(new, keys, "left")
    open_row = F.col("realized").isNull() & F.col("prediction").isNotNull()
    return joined.select(*[F.when(open_row, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
                           if c in cols else F.col(c) for c in ledger.columns])


def review(ledger: DataFrame, windows=P.REVIEW_WINDOWS, by=SERIES) -> DataFrame:
    """Hit rate of the last 20/50/100 and all settled rows per (horizon, version)."""
    keys = [*by, "horizon", "model_version"]
    settled = F.col("realized").isNotNull() & F.col("prediction").isNotNull()
    w = Window.partitionBy(*keys, "_settled").orderBy(F.col("as_of").desc())
    df = ledger.withColumn("_settled", settled).withColumn("_rn", F.row_number().over(w))
    hit = (F.col("prediction") == F.col("realized")).cast("double")
    aggs = []
    for k in [*windows, None]:
        inside = F.col("_settled") if k is None else F.col("_settled") & (F.col("_rn") <= k)
        label = "all" if k is None else str(k)
        aggs += [F.count_if(inside).alias(f"n_{label}"),
                 F.round(F.avg(F.when(inside, hit)), 4).alias(f"hit_{label}")]
    return df.groupBy(*keys).agg(
        F.max("is_shadow").alias("is_shadow"), *aggs,
        F.min("as_of").alias("first_as_of"), F.max("as_of").alias("last_as_of"),
        F.count_if(F.col("prediction").isNull()).alias("neutral_days"),
        F.count_if(F.col("realized").isNull() & F.col("prediction").isNotNull())
        .alias("pending_days"))


def history_rows(decisions: DataFrame, created_ts: Column,
                 version: str = P.MODEL_VERSION) -> DataFrame:
    """Walk-forward decisions in ledger form, to replay a ledger over past dates."""
    return decisions.select(
        "series_id", F.col("date").alias("as_of"), "horizon",
        F.lit(version).alias("model_version"), F.lit(0).alias("is_shadow"),
        F.col("pred").cast("int").alias("prediction"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("meta"),
        created_ts.alias("created_ts"), *_unsettled())


