"""Helpers the training-data operators share: tables, folds, text normal forms, hashes."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkloom.session import materialise, shared_dir

__all__ = ["cut", "extended", "fold", "fresh_dir", "lower_ascii", "md5_unit", "packed", "sample_ids", "skew_join", "slices", "table", "unpacked", "unused"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    return materialise(df, name)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name on the store every executor reaches."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5).cast("int")


def md5_unit(text: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of MD5; the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def sample_ids(labelled: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most ``n`` rows in hash order of the id: a reproducible bounded sample."""
    return labelled.orderBy(F.xxhash64(F.col(id_col), F.lit(17)), F.col(id_col)).limit(n)


def one_per_id(rows: DataFrame, id_col: str) -> DataFrame:
    """The least row of every id, by the other columns in their order: a sample bounded in ids is bounded in
    rows, however often an id is repeated. Repeats are reduced before the shuffle."""
    rest = [c for c in rows.columns if c != id_col]
    return (rows.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("_least"))
            .select(id_col, *[F.col("_least")[c].alias(c) for c in rest]))


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with columns appended (a copy: ``StructType.add`` changes its owner)."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return schema


def packed(df: DataFrame, *columns: str, row: str = "_row") -> DataFrame:
    """The named columns next to the whole row in one struct, so that an operator's own columns
    cannot clash with any other column of ``df``."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row), *columns)


def unpacked(df: DataFrame, columns: list[str], *new: str, row: str = "_row") -> DataFrame:
    """The packed columns again, and the new ones in the place of columns of the same name."""
    return df.select(*[F.col(row)[c].alias(c) for c in columns if c not in new], *new)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches, rows: int = 512):
    """Arrow batches cut into short ones, so that a task holds the work of a few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def skew_join(left: DataFrame, right: DataFrame, key: str, times: str, total: int, hot: int = 1_000, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, whose column ``times`` says how many of the ``total`` rows of ``left`` have the key: the at most
    ``hot`` keys with ``total / hot`` rows or more are broadcast, for the others no key is frequent."""
    often = F.col(times) * hot >= max(total, hot)
    many = F.broadcast(right.where(often))
    return left.join(many, key).unionByName(
        left.join(many.select(key).distinct(), key, "left_anti").join(right.where(~often), key, how))
