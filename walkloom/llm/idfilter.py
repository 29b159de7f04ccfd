"""A filter on ids of bounded size: one bit per hashed id, at most ``MAX_BITS`` bits.

It lets every wanted id through and a few others, so a small table of ids can thin out a large one
before any shuffle. Beyond ``MAX_BITS / PER_ID`` ids it stays as large and lets more through; what
follows must therefore not rely on it, and doesn't.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.llm.common import slices, unused

PER_ID = 32
MAX_BITS = 1 << 27


@dataclass
class Filter:
    bits: int
    shared: object  # broadcast of the words, MAX_BITS / 8 bytes at most


def build(ids: DataFrame, column: str, max_bits: int = MAX_BITS) -> Filter | None:
    """None if there are no ids. Bits are set by an aggregation; the driver sees the bits only."""
    slots = ids.select(F.xxhash64(column).alias("h"))
    n = slots.agg(F.approx_count_distinct("h")).first()[0]
    if not n:
        return None
    bits = min(max_bits, max(1 << 12, 1 << int(n * PER_ID - 1).bit_length()))
    at = F.pmod("h", F.lit(bits))
    words = (slots.groupBy(F.shiftright(at, 5).cast("int").alias("w"))
             .agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(h, {bits}) & 31 as int)))").alias("b")).toArrow())
    out = np.zeros(bits // 32, np.uint32)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return Filter(bits, ids.sparkSession.sparkContext.broadcast(out.tobytes()))


def matching(df: DataFrame, column: str, wanted: Filter, keep: bool = True, then=None, schema=None) -> DataFrame:
    """The rows whose id may be wanted, or with ``keep=False`` those whose id is certainly not.
    A null id is not wanted. ``then`` turns the rows that pass, a few at a time, into ``schema``."""
    hashed = df.withColumn(unused(df, "_h"), F.when(F.col(column).isNotNull(),
                                        F.pmod(F.xxhash64(column), F.lit(wanted.bits))).otherwise(F.lit(-1)))
    shared, names = wanted.shared, df.columns

    def run(batches):
        import pyarrow as pa
        words = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            h = batch.column(len(names)).to_numpy(zero_copy_only=False)
            hit = (h >= 0) & ((words[h >> 5] >> (h & 31).astype(np.uint32)) & 1).astype(bool)
            if not keep:
                hit = ~hit
            if hit.any():
                passed = pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).filter(pa.array(hit))
                yield from map(then, slices([passed])) if then else [passed]

    return hashed.mapInArrow(run, schema or df.schema)
