"""Readers for landed files: rate XML, candle JSON, CSV, parallel arrays, HTML, RSS, quotes.

Downloading is not part of the library; files are expected in a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkloom.functions import scalars as X
from walkloom.session import materialise

RATE_SCHEMA = "_Date string, _Id string, Nominal string, Value string"
ITEM_SCHEMA = "title string, pubDate string"
CANDLE_SCHEMA = "series_id string, candles struct<columns array<string>, data array<array<string>>>"
ARRAYS_SCHEMA = "timestamp array<bigint>, close array<double>"
SPOT_SCHEMA = "series_id string, rates struct<RUB double>, time_last_update_utc string"
# fixed value: date and number cells of the published HTML table
HTML_CELLS = r"(\d{2}\.\d{2}\.\d{4})\s*</td>\s*<td[^>]*>\s*([\d,\.]+)"


def per_unit(value: Column, nominal: Column) -> Column:
    """Quote for one unit; a unit size that is missing or not positive gives NULL."""
    return F.when(nominal > 0, F.try_divide(value, nominal))


def rate_records(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """Raw rate records: (id, date, nominal, value); decimal commas allowed."""
    raw = (spark.read.format("xml").option("rowTag", "Record").option("charset", charset)
           .schema(RATE_SCHEMA).load(path))
    return raw.select(F.col("_Id").alias("series_id"),
                      F.to_date("_Date", "dd.MM.yyyy").alias("date"),
                      X.decimal_comma(F.col("Nominal")).alias("nominal"),
                      X.decimal_comma(F.col("Value")).alias("value"))


def split_rates(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable per-unit rates, quarantined records with a bad unit size or value)."""
    rated = records.withColumn("price", per_unit(F.col("value"), F.col("nominal")))
    good = F.col("price").isNotNull()
    return rated.where(good).select("series_id", "date", "price"), rated.where(~good)


def strict_rates(records: DataFrame) -> DataFrame:
    """Per-unit rates; the job fails on a unit size that is not positive."""
    bad = F.raise_error(F.concat(F.lit("bad unit size on "), F.col("date").cast("string")))
    price = F.when(F.col("nominal") > 0, F.try_divide("value", "nominal")).otherwise(
        bad.cast("double"))
    return records.select("series_id", "date", price.alias("price"))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, doc, broken) of JSON documents: one to a line, or one to a file with line breaks inside.

    Files are read by lines. A line is a document if it can be read and has a field of the schema; a file
    with such a line holds one document per line, and only what its other lines hold is lost. The lines of
    a file without one are put together again, as a single document. ``doc`` is NULL and ``broken`` holds
    the source text where it cannot be read: keep those rows as a quarantine, or fail on them with
    ``strict_documents``.

    The files are read and parsed once, when this is called: the parsed lines are written to the shared
    folder, without the text of good lines, and every further step reads the columns it needs from there.
    A file put together from its lines is one value of one row, so such a document has to fit in a task; files
    of one document per line have no such bound. In a file that spreads one document over lines, no line
    may be a document by itself.
    """
    full = T.StructType.fromDDL(f"{schema}, _broken string")
    parse = lambda text: F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    readable = F.col("doc").isNotNull() & F.col("doc._broken").isNull()
    filled = F.greatest(*[F.col("doc")[f.name].isNotNull() for f in full.fields if f.name != "_broken"], F.lit(False))
    parsed = lambda df: (df.withColumn("doc", parse(F.col("text"))).withColumn("_fine", readable)
                         .withColumn("doc", F.when(F.col("_fine"), F.col("doc"))))
    shaped = lambda df: df.select("file", "doc", F.when(~F.col("_fine"), F.col("text")).alias("broken"))
    lines = (spark.read.text(path).where(F.trim("value") != "")
             .select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("_start"),
                     F.monotonically_increasing_id().alias("_at"), F.col("value").alias("text"))
             .transform(parsed).withColumn("_good", F.col("_fine") & F.coalesce(filled, F.lit(False)))
             .withColumn("text", F.when(~F.col("_good"), F.col("text"))))
    lines = materialise(lines, "json-lines")
    by_line = lines.groupBy("file").agg(F.max("_good").alias("_by_line"))
    rest = lines.where(~F.col("_good")).join(by_line, "file")
    whole = (rest.where(~F.col("_by_line")).groupBy("file")
             .agg(F.array_sort(F.collect_list(F.struct("_start", "_at", "text"))).alias("_lines"))
             .select("file", F.array_join(F.col("_lines.text"), "\n").alias("text")).transform(parsed))
    return shaped(lines.where("_good")).unionByName(shaped(rest.where("_by_line"))).unionByName(shaped(whole))


def strict_documents(docs: DataFrame) -> DataFrame:
    """The documents; the job fails on one that cannot be read."""
    fail = F.raise_error(F.concat(F.lit("unreadable document in "), F.col("file")))
    return docs.select("file", F.when(F.col("broken").isNull(), F.col("doc")).otherwise(
        fail.cast(docs.schema["doc"].dataType)).alias("doc"))


def json_candles(spark: SparkSession, path: str, series: Column | None = None) -> DataFrame:
    """Pages of columnar candles: column names once, then rows of values by position.

    Pages may carry line breaks. A page without a series_id takes ``series``, which may use the
    column ``file``. Unreadable pages are left out here; ``documents`` shows them.
    """
    pages = documents(spark, path, CANDLE_SCHEMA).where(F.col("doc").isNotNull()).select("file", "doc.*")
    if series is not None:
        pages = pages.withColumn("series_id", F.coalesce("series_id", series))
    rows = pages.select("series_id", F.col("candles.columns").alias("names"),
                        F.explode("candles.data").alias("row"))
    cell = lambda name: F.get("row", F.array_position("names", name).cast("int") - 1)
    return (rows.select("series_id", F.substring(cell("begin"), 1, 10).try_cast("date").alias("date"),
                        *[cell(c).try_cast("double").alias(c) for c in ("close", "high", "low")])
            .where(F.col("close").isNotNull()))


def csv_series(spark: SparkSession, path: str, after: Column | None = None) -> DataFrame:
    """CSV with Date,Price; unparsable numbers are skipped; only days after ``after``."""
    raw = spark.read.option("header", "true").schema("Date string, Price string").csv(path)
    out = raw.select(F.col("Date").try_cast("date").alias("date"),
                     F.col("Price").try_cast("double").alias("value"))
    out = out.where(F.col("date").isNotNull() & F.col("value").isNotNull())
    return out if after is None else out.where(F.col("date") > after)


def json_parallel_arrays(spark: SparkSession, path: str) -> DataFrame:
    """timestamp[] and close[] side by side; rows without a close are dropped."""
    raw = documents(spark, path, ARRAYS_SCHEMA).where(F.col("doc").isNotNull()).select("doc.*")
    cells = raw.select(F.explode(F.arrays_zip("timestamp", "close")).alias("c"))
    return (cells.where(F.col("c.close").isNotNull())
            .select(F.to_date(F.timestamp_seconds("c.timestamp")).alias("date"),
                    F.col("c.close").alias("value")))


def html_table(spark: SparkSession, path: str) -> DataFrame:
    """(date, value) cell pairs of whole HTML pages; cells that do not parse are skipped."""
    pages = spark.read.text(path, wholetext=True)
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(HTML_CELLS), F.lit(1)).alias("d"),
                         F.regexp_extract_all("value", F.lit(HTML_CELLS), F.lit(2)).alias("v"))
    cells = pages.select(F.explode(pairs).alias("c"))
    return (cells.select(F.to_date(F.try_to_timestamp("c.d", F.lit("dd.MM.yyyy"))).alias("date"),
                         X.decimal_comma(F.col("c.v")).alias("value"))
            .where(F.col("date").isNotNull() & F.col("value").isNotNull()))


def rss_items(spark: SparkSession, path: str, run_date: Column) -> DataFrame:
    """Feed items: date (run date when unreadable), full text, title cut at 200."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(ITEM_SCHEMA).load(path)
    full = raw.where(F.length("title") > 0).where(F.length("pubDate") > 0)
    return full.select(X.parse_feed_date(F.col("pubDate"), run_date).alias("date"),
                       F.col("title").alias("text"),
                       F.substring("title", 1, 200).alias("title"))


def json_spot(spark: SparkSession, path: str) -> DataFrame:
    """Quote objects, one per line or one per file: (series_id, date, price); the stamp reads
    'Fri, 01 Jan 2021 00:00:01 +0000'."""
    raw = documents(spark, path, SPOT_SCHEMA).where(F.col("doc").isNotNull()).select("doc.*")
    day = F.substring("time_last_update_utc", 6, 11)
    return raw.select("series_id",
                      F.to_date(F.try_to_timestamp(day, F.lit("dd MMM yyyy"))).alias("date"),
                      F.col("rates.RUB").alias("price"))


def newest_per(df: DataFrame, by=("series_id",)) -> DataFrame:
    return df.groupBy(*by).agg(F.max("date").alias("last_date"))


def fallback_when_stale(primary: DataFrame, backup: DataFrame, run_date: Column, max_lag_days: int,
                        by=("series_id",)) -> DataFrame:
    """Append backup rows newer than the primary's newest date, but only for series whose
    primary is more than ``max_lag_days`` behind the run date."""
    newest = newest_per(primary, by).withColumnRenamed("last_date", "_last")
    stale = newest.where(F.datediff(run_date, "_last") > max_lag_days)
    extra = backup.join(stale, list(by)).where(F.col("date") > F.col("_last")).drop("_last")
    return primary.unionByName(extra.select(*primary.columns))


def static_asof(rows: DataFrame, run_date: Column) -> DataFrame:
    """Entries of a built-in step table that are already in force."""
    return rows.where(F.col("date") <= run_date)


def primary_or_static(primary: DataFrame, static: DataFrame, run_date: Column) -> DataFrame:
    """The primary table, or the static one (up to the run date) when it is empty."""
    empty = primary.select(F.count(F.lit(1)).alias("n")).scalar() == 0
    return primary.unionByName(static_asof(static, run_date).where(empty))


def incremental(source: DataFrame, stored: DataFrame, run_date: Column, ahead_days: int = 7,
                by=("series_id",)) -> DataFrame:
    """Source rows after each series' newest stored date, up to a week past the run date
    (rows dated in the near future are legal)."""
    newest = newest_per(stored, by).withColumnRenamed("last_date", "_last")
    upper = F.date_add(run_date, ahead_days)
    joined = source.where(F.col("date") <= upper).join(newest, list(by), "left")
    return joined.where(F.col("_last").isNull() | (F.col("date") > F.col("_last"))).drop("_last")


