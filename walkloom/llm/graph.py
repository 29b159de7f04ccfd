"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(rep, comp) for every node of ``edges`` (u, v): comp is the smallest node reachable.

    Each round hangs the neighbours of a node on its smallest neighbour; rounds grow with the
    logarithm of the longest path. Only edges move, each round is written to the shared folder, and
    the driver sees two sums that tell whether anything changed.
    """
    now = cut(edges.where(F.col("u") != F.col("v"))
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        now = cut(_small(_large(now)), "edges")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    stars = now.select(F.col("u").alias("rep"), F.col("v").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("rep"), "comp").distinct())


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    flip = hung.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return flip.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
