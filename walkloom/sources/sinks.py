"""Keyed writes. Plain parquet has no MERGE, so each write builds the next snapshot from the
stored one and the batch; publishing writes a new version and switches a pointer to it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def upsert_coalesce(stored: DataFrame, batch: DataFrame, keys: list[str],
                    primary_source: str = "cbr") -> DataFrame:
    """Column-wise upsert: a non-null new value wins; the primary source wins the label."""
    values = [c for c in stored.columns if c not in keys and c != "source"]
    new = batch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in [*values, "source"]])
    both = stored.join(new, keys, "full")
    merged = [F.coalesce(f"_new_{c}", c).alias(c) for c in values]
    source = (F.when(F.col("_new_source") == primary_source, F.col("_new_source"))
              .otherwise(F.coalesce("source", "_new_source")).alias("source"))
    return both.select(*keys, *merged, source)


def upsert_last_wins(stored: DataFrame, batch: DataFrame, keys: list[str],
                     order: str | None = None) -> DataFrame:
    """Replace on key. Within the batch the row with the highest ``order`` wins; of rows of equal order, or
    without one, the greatest by its columns, so that a repeated write keeps the same row."""
    rank = F.col(order) if order else F.lit(0)
    cols = stored.columns
    both = (stored.withColumns({"_gen": F.lit(0), "_ord": F.lit(None).cast("bigint")})
            .unionByName(batch.withColumns({"_gen": F.lit(1), "_ord": rank.cast("bigint")})
                         .select(*cols, "_gen", "_ord")))
    # max_by keeps one row per key map-side, so repeated keys never pile up in a window
    rest = [c for c in cols if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("_gen", "_ord", *rest))
    return both.groupBy(*keys).agg(best.alias("_b")).select(
        *[F.col(c) if c in keys else F.col("_b")[c].alias(c) for c in cols])


def new_rows(stored: DataFrame, batch: DataFrame, keys: list[str],
             first_by: str | None = None) -> DataFrame:
    """Batch rows whose key is not stored yet, the first per key (first write wins)."""
    rest = [c for c in batch.columns if c not in keys]
    order = F.col(first_by) if first_by else F.struct(*[F.col(c) for c in rest])
    first = (batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_b"))
             .select(*keys, *[F.col("_b")[c].alias(c) for c in rest]))
    return first.select(*batch.columns).join(stored.select(*keys), keys, "left_anti")


def insert_ignore(stored: DataFrame, batch: DataFrame, keys: list[str],
                  first_by: str | None = None) -> DataFrame:
    return stored.unionByName(new_rows(stored, batch, keys, first_by).select(*stored.columns))


def update_by_key(stored: DataFrame, updates: DataFrame, keys: list[str],
                  cols: list[str]) -> DataFrame:
    """Fill ``cols`` from matching updates, keep the rest."""
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = stored.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c)
                           for c in stored.columns])


POINTER = "CURRENT"


def publish(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
            keep_previous_if_empty: bool = True, tag: str = "") -> bool:
    """Replace a published result in one step; read it with ``published``. ``tag`` goes into the
    version's name.

    The result is written to a new version folder and counted in the same job; then a pointer file
    is switched by one rename. A job that fails, or an empty result, leaves the previous version.
    """
    spark = df.sparkSession
    version = f"v{tag}-{uuid.uuid4().hex}"
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(f"{path}/{version}")
    rows = (seen.get or {}).get("rows", 0)  # a plan known to be empty reports nothing
    if keep_previous_if_empty and not rows:
        return False
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    fresh, current = hadoop.Path(f"{path}/{POINTER}.{version}"), hadoop.Path(f"{path}/{POINTER}")
    out = fresh.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(fresh.toUri(), conf).rename(fresh, current, options)
    return True


def is_published(spark: SparkSession, path: str) -> bool:
    """Whether there is a version to read."""
    pointer = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    return pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(pointer)


def current_version(spark: SparkSession, path: str) -> str:
    return spark.read.text(f"{path}/{POINTER}").first()[0]


def published(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """The version the pointer names."""
    version = current_version(spark, path)
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(f"{path}/{version}")


def latest_per_key(df: DataFrame, keys: list[str], order: str, n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
