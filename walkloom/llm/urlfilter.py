"""URL filters as a temporal list join.

A list is a history of dated entries: on a day a key (a host, a domain with everything below it, or
a path prefix of a host) is added to a category or removed from it. The history becomes
validity intervals [from, until); an as-of join then evaluates every capture against the entries
active on the day it was fetched.

Intervals are cut at calendar buckets of ``BUCKET_DAYS``, so that a capture meets only what can be
active near its day, however long the history of its key. Capture keys are spread over tasks by key and
bucket; a host with very many captures is split by adaptive execution, which such joins allow.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 64
#: From the weakest to the most specific.
KINDS = ("domain", "host", "prefix")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """array<struct<kind, key>>: the host, every domain it lies in (two labels at least), and the host
    with every prefix of the path that ends with a segment. Empty without a host."""
    host = F.coalesce(host_of(url), F.lit(""))
    labels = F.split(host, r"\.")
    named = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    n = F.size(labels)
    domains = F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: i <= n - 1),
                          lambda i: named("domain", F.array_join(F.slice(labels, i, n), ".")))
    parts = F.filter(F.split(F.coalesce(path_of(url), F.lit("")), "/"), lambda p: p != "")
    m = F.size(parts)
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), m), lambda i: i >= 1),
                           lambda i: named("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    none = F.filter(F.array(named("host", host)), lambda k: F.lit(False))
    return F.when(host == "", none).otherwise(F.concat(F.array(named("host", host)), domains, prefixes))


def validity(entries: DataFrame) -> DataFrame:
    """(kind, key, category, since, until) from entries (kind, key, category, action, day).

    Repeated entries count once, entries with a null in any column not at all; of an addition and a removal on one day
    the removal counts; until is null while the last word is an addition. A key's history has at most
    one row per day after the first aggregation.
    """
    days = (entries.where(F.col("action").isin("add", "remove"))
            .dropna(subset=["kind", "key", "category", "action", "day"])
            .groupBy("kind", "key", "category", "day").agg(F.max(F.col("action") == "remove").alias("gone")))
    order = Window.partitionBy("kind", "key", "category").orderBy("day")
    turns = (days.withColumn("_before", F.coalesce(F.lag("gone").over(order), F.lit(True)))
             .where(F.col("gone") != F.col("_before")))
    return (turns.withColumn("until", F.lead("day").over(order)).where(~F.col("gone"))
            .select("kind", "key", "category", F.col("day").alias("since"), "until"))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """One row per distinct (id, url, day) of ``captures`` (id, url, day): n_active, categories, rule, blocked.

    n_active counts active (kind, key, category); categories are sorted and joined by commas; rule is the
    most specific active key, the longest of them. A capture with a null day or without a host
    has no active entry.
    """
    spans = validity(entries)
    bucket = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / bucket_days)
    last = captures.agg(F.max("day")).first()[0]
    until = F.coalesce("until", F.date_add(F.lit(last), 1)) if last is not None else F.col("until")
    spans = (spans.withColumn("_end", until).where(F.col("_end") > F.col("since"))
             .withColumn("bucket", F.explode(F.sequence(bucket(F.col("since")), bucket(F.date_sub("_end", 1)))))
             .select("kind", "key", "category", "since", F.col("_end").alias("until"), "bucket"))
    rows = captures.select(F.col(id_col), "url", "day").distinct()
    asked = rows.select(id_col, "url", "day", F.explode(keys_of(F.col("url"))).alias("k")).select(
        id_col, "url", "day", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"), bucket(F.col("day")).alias("bucket"))
    active = (asked.join(spans, ["kind", "key", "bucket"])
              .where((F.col("day") >= F.col("since")) & (F.col("day") < F.col("until"))))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    verdict = active.select(id_col, "url", "day", F.lit(1).alias("n"), "category",
                            F.struct(rank.alias("r"), F.length("key").alias("l"), F.col("key").alias("k")).alias("rule"))
    none = verdict.schema["rule"].dataType
    bare = rows.select(id_col, "url", "day", F.lit(0).alias("n"), F.lit(None).cast("string").alias("category"),
                       F.lit(None).cast(none).alias("rule"))
    return (verdict.unionByName(bare).groupBy(id_col, "url", "day")
            .agg(F.sum("n").alias("n_active"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"),
                 F.max("rule").alias("_r"))
            .select(id_col, "url", "day", F.col("n_active").cast("long").alias("n_active"), "categories",
                    F.col("_r.k").alias("rule"), (F.col("n_active") > 0).alias("blocked")))
