"""Registered source and sink queries.

Reader queries first land files: the given tables are written in the published file format
into the shared folder, then read back with the library's reader.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from walkloom.oracle import ctes as Q
from walkloom.oracle.ctes import r
from walkloom.plans.registry import query, report, scored_news
from walkloom.plans.windows import _flip, flipped
from walkloom.session import shared_dir
from walkloom.sources import panel, readers, sinks

KEYS = ("series_id", "date")
RUN_DATE = "2001-08-01"
CUT = "1999-01-01"


def run_date(day: str = RUN_DATE):
    return F.lit(day).cast("date")


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _land_text(df, column, spark, name: str) -> str:
    path = _folder(spark, name)
    df.select(column.alias("value")).write.text(path)
    return path


def _comma(x):
    return F.regexp_replace(x.cast("string"), r"\.", ",")


_nominal = "(CASE WHEN month(date) IN (2, 7) THEN 10 ELSE 1 END)"


@query("src_xml_rates", Q.query(f"SELECT series_id, date, {_flip} / {_nominal} AS price FROM official", "official"))
def src_xml_rates(spark, d):
    df = flipped(panel.official(spark, d))
    path = _folder(spark, "rates-xml")
    (df.select(F.date_format("date", "dd.MM.yyyy").alias("_Date"), F.col("series_id").alias("_Id"),
               F.col("nominal").cast("string").alias("Nominal"), _comma(F.col("price")).alias("Value"))
     .write.format("xml").option("rootTag", "ValCurs").option("rowTag", "Record").save(path))
    good, _ = readers.split_rates(readers.rate_records(spark, path))
    return good.select(*KEYS, "price")


@query("src_unit_normalize", Q.query(
    f"SELECT series_id, date, {_nominal} AS nominal, {_flip} AS value, {_flip} / {_nominal} AS price FROM official",
    "official"))
def src_unit_normalize(spark, d):
    df = flipped(panel.official(spark, d)).withColumnRenamed("price", "value")
    price = readers.per_unit(F.col("value"), F.col("nominal"))
    return df.select(*KEYS, "nominal", "value", price.alias("price"))


@query("src_json_candles", Q.query("SELECT series_id, date, close, high, low FROM market", "market"))
def src_json_candles(spark, d):
    # one page per series and month, 31 candles at most
    row = F.array(F.date_format("date", "yyyy-MM-dd 00:00:00"), F.col("close").cast("string"),
                  F.col("high").cast("string"), F.col("low").cast("string"))
    pages = (panel.market(spark, d).groupBy("series_id", F.trunc("date", "month").alias("month"))
             .agg(F.collect_list(row).alias("data")))
    names = F.array(*[F.lit(c) for c in ("begin", "close", "high", "low")])
    doc = F.to_json(F.struct("series_id", F.struct(names.alias("columns"), "data").alias("candles")))
    return readers.json_candles(spark, _land_text(pages, doc, spark, "candles"))


@query("src_csv_series", Q.query(f"SELECT date, value FROM oil WHERE date > date '{CUT}' AND day(date) <> 13", "oil"))
def src_csv_series(spark, d):
    oil = panel.oil(spark, d)
    price = F.when(F.dayofmonth("date") == 13, ".").otherwise(F.col("value").cast("string"))
    path = _folder(spark, "oil-csv")
    oil.select(F.col("date").cast("string").alias("Date"), price.alias("Price")).write.csv(path, header=True)
    return readers.csv_series(spark, path, after=run_date(CUT))


@query("src_json_parallel_arrays", Q.query("SELECT date, value FROM oil WHERE day(date) <> 13", "oil"))
def src_json_parallel_arrays(spark, d):
    cell = F.struct(F.unix_seconds(F.col("date").cast("timestamp")).alias("ts"),
                    F.when(F.dayofmonth("date") != 13, F.col("value")).alias("close"))
    months = (panel.oil(spark, d).groupBy(F.trunc("date", "month").alias("month"))
              .agg(F.collect_list(cell).alias("c")))
    doc = F.to_json(F.struct(F.col("c.ts").alias("timestamp"), F.col("c.close").alias("close")))
    return readers.json_parallel_arrays(spark, _land_text(months, doc, spark, "arrays"))


@query("src_html_table_regex", Q.query("SELECT date, value FROM oil", "oil"))
def src_html_table_regex(spark, d):
    # one page per month; each line is a table row
    row = F.concat(F.lit("<tr><td>"), F.date_format("date", "dd.MM.yyyy"),
                   F.lit("</td> <td class='n'>"), _comma(F.col("value")), F.lit("</td></tr>"))
    pages = (panel.oil(spark, d).groupBy(F.trunc("date", "month").alias("month"))
             .agg(F.array_join(F.collect_list(row), "").alias("html")))
    return readers.html_table(spark, _land_text(pages, F.col("html"), spark, "html"))


_title = "trim('doc ' || doc_id || ' ' || regexp_replace(text, '[^a-z]+', ' ', 'g'))"


@query("src_rss_items", Q.query(f"""
SELECT CASE WHEN doc_id % 4 = 3 THEN date '{RUN_DATE}' ELSE cast(date '1995-01-01' + cast((doc_id*7)%2400 AS int) AS date) END AS date,
  substring({_title}, 1, 200) AS title, length({_title})::int AS n_chars FROM documents"""))
def src_rss_items(spark, d):
    docs = panel.table(spark, d, "documents")
    day = F.date_add(F.lit("1995-01-01").cast("date"), ((F.col("doc_id") * 7) % 2400).cast("int"))
    title = F.trim(F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" "),
                            F.regexp_replace("text", "[^a-z]+", " ")))
    kind = F.col("doc_id") % 4
    stamp = (F.when(kind == 0, F.date_format(day, "EEE, dd MMM yyyy 10:11:12 'GMT'"))
             .when(kind == 1, F.date_format(day, "yyyy-MM-dd'T'10:11:12"))
             .when(kind == 2, F.date_format(day, "yyyy-MM-dd")).otherwise("no date"))
    path = _folder(spark, "rss")
    (docs.select(title.alias("title"), stamp.alias("pubDate"))
     .write.format("xml").option("rootTag", "rss").option("rowTag", "item").save(path))
    items = readers.rss_items(spark, path, run_date())
    return items.select("date", "title", F.length("text").alias("n_chars"))


@query("src_json_spot", Q.query("SELECT series_id, max(date) AS date, max_by(price, date) AS price FROM official GROUP BY 1", "official"))
def src_json_spot(spark, d):
    last = panel.official(spark, d).groupBy("series_id").agg(
        F.max("date").alias("date"), F.max_by("price", "date").alias("price"))
    doc = F.to_json(F.struct("series_id", F.struct(F.col("price").alias("RUB")).alias("rates"),
                             F.date_format("date", "EEE, dd MMM yyyy 00:00:01 +0000")
                             .alias("time_last_update_utc")))
    return readers.json_spot(spark, _land_text(last, doc, spark, "spot"))


_stale_primary = ("(SELECT series_id, date, price FROM official WHERE series_id > '3' "
                  f"OR date <= date '{CUT}')")


def _split_primary(spark, d):
    """Two series stop early, three are complete; the market is the backup."""
    official = panel.official(spark, d).select(*KEYS, "price")
    primary = official.where((F.col("series_id") > "3") | (F.col("date") <= run_date(CUT)))
    backup = panel.market(spark, d).select(*KEYS, F.col("close").alias("price"))
    return primary, backup


@query("src_fallback_when_stale", Q.query(f"""
SELECT * FROM {_stale_primary} UNION ALL SELECT m.series_id, m.date, m.close FROM market m
JOIN (SELECT series_id, max(date) AS last FROM {_stale_primary} GROUP BY 1) p ON p.series_id = m.series_id
WHERE date_diff('day', p.last, date '{RUN_DATE}') > 2 AND m.date > p.last""", "official", "market"))
def src_fallback_when_stale(spark, d):
    primary, backup = _split_primary(spark, d)
    return readers.fallback_when_stale(primary, backup, run_date(), 2)


@query("src_static_table_asof", Q.query(f"SELECT date, value FROM key_rate WHERE date <= date '{CUT}'", "key_rate"))
def src_static_table_asof(spark, d):
    table = panel.key_rate(spark, d)
    return readers.primary_or_static(table.where(F.lit(False)), table, run_date(CUT))


@query("src_incremental", Q.query(f"""
SELECT m.series_id, m.date, m.close FROM market m
LEFT JOIN (SELECT series_id, max(date) AS last FROM market WHERE date <= date '{CUT}' GROUP BY 1) p ON p.series_id = m.series_id
WHERE m.date <= date '2001-06-08' AND (p.last IS NULL OR m.date > p.last)""", "market"))
def src_incremental(spark, d):
    market = panel.market(spark, d)
    stored = market.where(F.col("date") <= run_date(CUT))
    return readers.incremental(market, stored, run_date("2001-06-01")).select(*KEYS, "close")


@query("src_typed_scan", Q.query("SELECT series_id, date, price, cross_price FROM official", "official"))
def src_typed_scan(spark, d):
    return panel.official(spark, d).select(*KEYS, "price", "cross_price")


# ---------------------------------------------------------------------- sinks

def _revision(spark, d):
    """A batch that revises the newest month and adds days the store lacks."""
    official = panel.official(spark, d)
    stored = official.where(F.col("date") <= run_date("2001-01-01")).select(
        *KEYS, "price", "cross_price",
        F.when(F.col("series_id") < "3", "cbr").otherwise("erapi").alias("source"))
    batch = official.where(F.col("date") >= run_date("2000-12-01")).select(
        *KEYS, F.when(F.dayofmonth("date") % 2 == 0, F.col("price") + 1).alias("price"),
        F.when(F.dayofmonth("date") % 3 == 0, F.col("cross_price") + 1).alias("cross_price"),
        F.when(F.dayofmonth("date") % 5 == 0, "cbr").otherwise("erapi").alias("source"))
    return stored, batch


_stored = ("(SELECT series_id, date, price, cross_price, CASE WHEN series_id < '3' THEN 'cbr' ELSE 'erapi' END AS source "
           "FROM official WHERE date <= date '2001-01-01')")
_batch = ("(SELECT series_id, date, CASE WHEN day(date) % 2 = 0 THEN price + 1 END AS price, "
          "CASE WHEN day(date) % 3 = 0 THEN cross_price + 1 END AS cross_price, "
          "CASE WHEN day(date) % 5 = 0 THEN 'cbr' ELSE 'erapi' END AS source FROM official WHERE date >= date '2000-12-01')")


@query("snk_upsert_coalesce", Q.query(f"""
SELECT coalesce(s.series_id, b.series_id) AS series_id, coalesce(s.date, b.date) AS date, coalesce(b.price, s.price) AS price,
  coalesce(b.cross_price, s.cross_price) AS cross_price,
  CASE WHEN b.source = 'cbr' THEN 'cbr' ELSE coalesce(s.source, b.source) END AS source
FROM {_stored} s FULL JOIN {_batch} b ON s.series_id = b.series_id AND s.date = b.date""", "official"))
def snk_upsert_coalesce(spark, d):
    stored, batch = _revision(spark, d)
    return sinks.upsert_coalesce(stored, batch, list(KEYS))


@query("snk_upsert_last_wins", Q.query("""
SELECT coalesce(b.date, o.date) AS date, coalesce(b.value, o.value) AS value FROM
  (SELECT * FROM oil WHERE date <= date '2000-06-30') o
  FULL JOIN (SELECT date, max_by(value + q, q) AS value FROM (SELECT date, value, unnest([1, 2]) AS q FROM oil
    WHERE date >= date '2000-06-01') GROUP BY 1) b ON b.date = o.date""", "oil"))
def snk_upsert_last_wins(spark, d):
    oil = panel.oil(spark, d)
    stored = oil.where(F.col("date") <= run_date("2000-06-30"))
    batch = oil.where(F.col("date") >= run_date("2000-06-01")).withColumn(
        "seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("value", F.col("value") + F.col("seq"))
    return sinks.upsert_last_wins(stored, batch, ["date"], "seq").select("date", "value")


@query("snk_insert_ignore", Q.query(f"""
SELECT date, title, source, {r('sentiment=min(sentiment)')}, 1 AS n FROM scored GROUP BY 1, 2, 3""", "scored"))
def snk_insert_ignore(spark, d):
    """Half of the news is stored; loading all of it twice adds only what is new, once."""
    news = scored_news(spark, d)
    # 'first' is the lowest score, a rule both engines can reproduce
    stored = sinks.new_rows(news.where(F.lit(False)), news.where(F.col("date") < run_date("1998-01-01")),
                            ["date", "title", "source"], "sentiment")
    once = sinks.insert_ignore(stored, news, ["date", "title", "source"], "sentiment")
    twice = sinks.insert_ignore(once, news, ["date", "title", "source"], "sentiment")
    return report(twice.groupBy("date", "title", "source").agg(
        F.min("sentiment").alias("sentiment"), F.count(F.lit(1)).cast("int").alias("n")))


@query("snk_update_by_key", Q.query(f"""
SELECT o.series_id, o.date, o.price, m.close AS realized FROM official o
LEFT JOIN market m ON m.series_id = o.series_id AND m.date = o.date""", "official", "market"))
def snk_update_by_key(spark, d):
    stored = panel.official(spark, d).select(*KEYS, "price", F.lit(None).cast("double").alias("realized"))
    updates = panel.market(spark, d).select(*KEYS, F.col("close").alias("realized"))
    return sinks.update_by_key(stored, updates, list(KEYS), ["realized"])


@query("snk_publish_artifact", Q.query("SELECT series_id, date, price FROM official", "official"))
def snk_publish_artifact(spark, d):
    """Publish, then publish an empty result: the first one stays."""
    path = _folder(spark, "artifact")
    df = panel.official(spark, d).select(*KEYS, "price")
    sinks.publish(df, path)
    sinks.publish(df.where(F.lit(False)), path)
    return sinks.published(spark, path, schema=df.schema)


@query("flt_shadow_meta", Q.query("""
SELECT series_id, as_of, horizon, '{"horizon":' || horizon || ',"prediction":' || coalesce(prediction::varchar, 'null') || '}' AS meta
FROM (SELECT series_id, date AS as_of, horizon, pred AS prediction FROM ld)""", "ld"))
def flt_shadow_meta(spark, d):
    from walkloom.operators.ledger import meta_document
    from walkloom.plans.reports import long_rows
    rows_ = long_rows(spark, d).select(
        "series_id", F.col("date").alias("as_of"), "horizon", F.col("pred").alias("prediction"),
        F.lit(0.5).alias("prob_up"), F.lit(0.5).alias("prob_down"))
    return rows_.select("series_id", "as_of", "horizon",
                        meta_document(rows_, ("series_id", "as_of")).alias("meta"))


