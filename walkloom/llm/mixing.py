"""Mixing sources to target weights.

Every source gets a share of all tokens in proportion to its weight. A target stops at
``max_epochs`` times the tokens its source has; what is cut there is shared out again by weight.
A document is then emitted floor(rate) times, plus once more with probability equal to the
fraction of the rate, decided by a hash of its id, so that reruns agree.

The draws of a source depend on each other, so that no single long document decides what it yields. Documents are grouped by
the class of their size (its bit length) and one of ``BUCKETS`` hash buckets. From the largest class down, a class gives the buckets of lowest hash
until it has its share, the fraction of its tokens and what larger classes lacked; a hash-seeded draw decides the
bucket at the border, with the probability that makes its expected tokens right. What is lacking after the class of the
shortest documents is less than one bucket of theirs.

The token counts reach the shuffle as one partial sum per group and task, so a hot source costs
no more than any other; a source has at most 64 x ``BUCKETS`` groups. The table of targets has one row per source; it is broadcast only after
its rows were counted, and joined by a salted shuffle join beyond ``broadcast_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom.llm.common import cut, md5_unit, packed, unpacked, unused

#: Fixed: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"

BUCKETS = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """Weights repeat over the sources in code point order, null last. One row per source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    place = (F.row_number().over(order) - 1) % F.lit(len(weights))
    return sources.withColumn("weight", F.get(cycle, place).cast("long"))


def targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Water filling over ``(source, source_size, weight)``, one row per source.

    In the order of cap over weight, the sources before the first one whose share fits under its
    cap take their cap, the others share what is left by weight. Sources without tokens get 0.
    """
    cap = F.lit(max_epochs) * F.col("source_size")
    order = (cap / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    df = (sources.withColumn("_cap", cap)
          .withColumn("_left", F.sum("source_size").over(everything)
                      - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
          .withColumn("_weights", F.sum("weight").over(after)))
    fits = F.col("_left") * F.col("weight") <= F.col("_cap") * F.col("_weights")
    level = F.struct(F.col("_cap") / F.col("weight"), F.col("source").isNull(), "source", "_left", "_weights")
    df = df.withColumn("_at", F.min(F.when(fits, level)).over(everything))
    shared = F.col("_at._left") * F.col("weight") / F.col("_at._weights")
    return df.select("source", "source_size", "weight",
                     F.least(F.col("_cap").cast("double"), shared).alias("target"))


def size_class(size: Column) -> Column:
    return F.length(F.bin(size))


def bucket(doc_id: Column) -> Column:
    text = F.concat(F.lit("mix-"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.floor(md5_unit(text) * F.lit(BUCKETS)).cast("int")


def borders(groups: DataFrame, planned: DataFrame) -> DataFrame:
    """``planned`` with ``lasts``: per size class the last bucket that is taken once more.

    A source's classes are walked in one row: at most 64 classes of ``BUCKETS`` sums.
    """
    inside = Window.partitionBy("source", "k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    draw = md5_unit(F.concat(F.lit("mix-"), F.col("k").cast("string"), F.lit("-"), F.coalesce("source", F.lit(""))))
    classes = (groups.withColumn("before", F.coalesce(F.sum("s").over(inside), F.lit(0)))
               .groupBy("source", "k").agg(F.sum("s").alias("total"), F.array_sort(F.collect_list(F.struct("b", "before", "s"))).alias("parts"))
               .groupBy("source").agg(F.array_sort(F.collect_list(F.struct(
                   (-F.col("k")).alias("down"), "k", "total", draw.alias("draw"), "parts"))).alias("classes"))
               .withColumnRenamed("source", "_s"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    def step(state, c):
        want = F.col("fraction") * c["total"] + state["lack"]
        taken = F.filter(c["parts"], lambda p: p["before"] + c["draw"] * p["s"] < want)
        last = F.try_element_at(taken, F.lit(-1))
        return F.struct((want - F.coalesce(last["before"] + last["s"], F.lit(0))).alias("lack"),
                        F.concat(state["lasts"], F.array(F.struct(c["k"].alias("key"), F.coalesce(last["b"], F.lit(-1)).alias("value")))).alias("lasts"))

    start = F.struct(F.lit(0.0).alias("lack"), F.array().cast("array<struct<key:int,value:int>>").alias("lasts"))
    return (planned.join(classes, F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", rate)
            .withColumn("fraction", F.col("rate") - F.floor("rate"))
            .withColumn("lasts", F.map_from_entries(F.aggregate("classes", start, step)["lasts"]))
            .drop("_s", "classes", "fraction"))


def mix(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3,
        broadcast_rows: int = 50_000, salts: int = 64) -> DataFrame:
    """All columns of ``docs`` plus size, source_size, target, copies and taken.

    A null or empty text has size 0 and is emitted by the same rule; a null source is a source of
    its own. Rows with equal ids are in the same bucket. ``weights`` is a cycle of whole numbers, or
    a table (source, weight) with one row per source. A source whose weight is missing, null or 0 has target 0
    and no copies; its tokens are not shared out. Repeated sources and weights below 0 are errors.
    """
    size = n_words(F.col("text"))
    groups = cut(docs.select("source", "doc_id", size.alias("_n"))
                 .groupBy("source", size_class(F.col("_n")).alias("k"), bucket(F.col("doc_id")).alias("b")).agg(F.sum("_n").alias("s")),
                 "mix-groups")
    sizes = cut(groups.groupBy("source").agg(F.sum("s").alias("source_size")), "mix-sizes")
    if isinstance(weights, DataFrame):
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("long").alias("weight"))
        wrong = w.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("w")).where("n > 1 OR w < 0").first()
        if wrong is not None:
            raise ValueError(f"weights: {wrong['n']} rows of source {wrong['_s']!r}, the smallest weight is {wrong['w']}")
        weighted = sizes.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        some = F.coalesce(F.col("weight") > 0, F.lit(False))
        planned = targets(weighted.where(some), max_epochs).unionByName(weighted.where(~some).withColumn("target", F.lit(0.0)))
    else:
        planned = targets(cyclic_weights(sizes, weights), max_epochs)
    plan = cut(borders(groups, cut(planned, "mix-targets")), "mix-borders").select(
        F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        F.col("rate").alias("_rate"), F.col("lasts").alias("_lasts"))
    rows = packed(docs, "doc_id", "text", "source", row="_all")
    if plan.count() <= broadcast_rows:
        joined = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source")))
    else:
        salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)).cast("int")
        joined = rows.withColumn("_salt", drawn).join(
            salted.withColumnRenamed("_salt", "_salt2"),
            F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_salt2")))
    once_more = bucket(F.col("doc_id")) <= F.coalesce(F.try_element_at(F.col("_lasts"), size_class(F.col("size"))), F.lit(-1))
    copies = F.floor("_rate") + once_more.cast("long")
    return (joined.withColumn("size", size)
            .withColumn("source_size", F.col("_source_size"))
            .withColumn("target", F.col("_target"))
            .withColumn("copies", copies.cast("long"))
            .withColumn("taken", F.col("size") * F.col("copies"))
            .transform(unpacked, docs.columns, "size", "source_size", "target", "copies", "taken", row="_all"))


def emit(docs: DataFrame, copy: str = "copy", **knobs) -> DataFrame:
    """The columns of ``docs``, one row per copy the mix takes, and the number of the copy from 1 in a
    column ``copy`` (lengthened by underscores if ``docs`` has that name)."""
    mixed = mix(packed(docs, "doc_id", "text", "source"), **knobs).where(F.col("copies") > 0)
    number = unused(docs, copy)
    taken = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("_row.*", F.col("_copy").alias(number))
