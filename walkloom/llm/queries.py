"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from walkloom.llm import (
    ann,
    crosstok,
    decontam,
    langid,
    license,
    license_rules,
    minhash,
    mixing,
    mtree,
    quality,
    toxicity,
    urlfilter,
    warc,
    whitening,
)
from walkloom.llm.common import cut, fold, fresh_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


@_register("op2_language_id")
def op2(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")


_OP5 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        CAST(FLOOR(CAST(CAST('0x' || substr(md5('mix-' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE)
          / 4503599627370496.0 * 1024) AS INTEGER) AS b FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (ROW_NUMBER() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 AS weight,
      ROW_NUMBER() OVER () AS sid, 3 * source_size AS cap FROM s),
f AS (SELECT *, SUM(source_size) OVER () - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, source IS NULL, source
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
      SUM(weight) OVER (ORDER BY cap / weight, source IS NULL, source
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w),
l AS (SELECT lft, ws FROM f WHERE lft * weight <= cap * ws ORDER BY cap / weight, source IS NULL, source LIMIT 1),
t AS (SELECT sid, source, source_size, LEAST(CAST(cap AS DOUBLE),
        CAST((SELECT lft FROM l) * weight AS DOUBLE) / CAST((SELECT ws FROM l) AS DOUBLE)) AS target FROM w),
r AS (SELECT doc_id, size, length(bin(size)) AS k, b, t.*, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT sid, k, b, CAST(SUM(size) AS BIGINT) AS s FROM r GROUP BY ALL),
p AS (SELECT *, COALESCE(SUM(s) OVER (PARTITION BY sid, k ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM g),
c AS (SELECT sid, k, SUM(s)::BIGINT AS total, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY k DESC) AS n FROM g GROUP BY sid, k),
q AS (SELECT c.*, (SELECT any_value(rate - FLOOR(rate)) FROM r WHERE r.sid = c.sid) AS fraction,
        CAST(CAST('0x' || substr(md5('mix-' || c.k || '-' || COALESCE(t.source, '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
      FROM c JOIN t USING (sid)),
z AS (SELECT sid, 0::BIGINT AS n, 0::BIGINT AS k, 0.0::DOUBLE AS lack, -1 AS last FROM t
  UNION ALL
  SELECT z.sid, q.n, any_value(q.k)::BIGINT, any_value(q.fraction * q.total + z.lack)
      - COALESCE(MAX(p.before + p.s) FILTER (p.before + q.draw * p.s < q.fraction * q.total + z.lack), 0),
    COALESCE(MAX(p.b) FILTER (p.before + q.draw * p.s < q.fraction * q.total + z.lack), -1)
  FROM z JOIN q ON q.sid = z.sid AND q.n = z.n + 1 JOIN p ON p.sid = q.sid AND p.k = q.k GROUP BY z.sid, q.n)
SELECT doc_id, size, source_size, target,
  CAST(size * (FLOOR(rate) + CASE WHEN r.b <= z.last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN z ON z.sid = r.sid AND z.k = r.k AND z.n > 0
"""


@_register("op5_mix_sources", _OP5)
def op5(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@_register("op7_quality_classifier")
def op7(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, d, "labels"))
    return quality.score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"),
                                             "score", "predicted")


@_register("op10_toxicity")
def op10(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, d, "labels"))
    return toxicity.score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"),
                                              "score", "predicted")


_WORDS = r"regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op1_sql() -> str:
    values = ", ".join("({}, '{}', {}, '{}', '{}')".format(n, label, level, word, f"^({pattern})(?: |$)".replace("'", "''"))
                       for n, (label, level, pattern) in enumerate(license.rule_table())
                       for word in license_rules.keywords(pattern))
    conf = " ".join(f"WHEN {k} THEN CAST({c} AS DOUBLE)" for k, c in license.CONFIDENCE.items())
    return f"""
WITH r(rule, label, level, word, x) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT rid, i - 1 AS start, rule, label, level,
        regexp_extract(array_to_string(w[i:i + {license_rules.REACH - 1}], ' '), x, 1) AS m
      FROM p JOIN r ON r.word = w[i]),
f AS (SELECT rid, start, start + len(string_split(m, ' ')) AS stop, rule, label, level FROM m WHERE m <> ''),
k AS (SELECT a.* FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.rid = a.rid AND b.start <= a.start AND b.stop >= a.stop
        AND b.level >= a.level AND (b.start < a.start OR b.stop > a.stop OR b.level > a.level OR b.rule < a.rule))),
b AS (SELECT rid, COUNT(*) AS n_base, MIN(start) AS first_word, MAX(start) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f WHERE rule < {len(license.BASE)} GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
        SELECT rid, label FROM k UNION SELECT rid, label FROM f WHERE rule < {len(license.BASE)}) GROUP BY rid),
s AS (SELECT rid, MAX(level) AS top FROM k GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels,
  CASE top {conf} ELSE CAST(0 AS DOUBLE) END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN s USING (rid)
"""


@_register("op1_license_scan", _op1_sql())
def op1(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return license.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word",
                                     "base_labels", "labels", "score")


_OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(1, GREATEST(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.m),
c AS (SELECT doc_id, MIN(m) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


@_register("op6_minhash_dedup", _OP6)
def op6(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents").select("doc_id", "text"))


_OP9 = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, L, array_to_string(w[i:i + L - 1], ' ') AS g FROM (
        SELECT item_id, w, LEAST(10, len(w)) AS L, unnest(range(1, GREATEST(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
ng AS (SELECT rid, i, L, array_to_string(w[i:i + L - 1], ' ') AS g FROM (
        SELECT rid, w, L, unnest(range(1, len(w) - L + 2)) AS i
        FROM d JOIN (SELECT DISTINCT L FROM iw) q ON len(w) >= L)),
h AS (SELECT DISTINCT rid, i, ng.L AS L, item_id FROM ng JOIN iw ON iw.L = ng.L AND iw.g = ng.g),
k AS (SELECT rid, COUNT(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(i, i + L)) AS x FROM h) GROUP BY rid),
t AS (SELECT rid, COUNT(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
      FROM h WHERE item_id IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (rid) LEFT JOIN t USING (rid)
"""


@_register("op9_decontaminate", _OP9)
def op9(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, table(spark, d, "benchmark")).drop("_h")


def _crc(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def url_lists(pages: DataFrame) -> DataFrame:
    """A dated list history over the hosts, domains and paths that ``pages`` has: hash rules decide
    what is listed, when, in which category, and whether it is removed and added again."""
    keys = (pages.select(F.explode(urlfilter.keys_of(F.col("url"))).alias("k")).select("k.kind", "k.key").distinct()
            .withColumn("x", _crc(F.concat_ws(":", "kind", "key")))
            .where(F.col("x") % F.when(F.col("kind") == "host", 3).when(F.col("kind") == "domain", 5).otherwise(7) == 0))
    first = F.lit("2024-01-01").cast("date")
    n = lambda c: c.cast("int")
    x = F.col("x")
    dated = keys.select("kind", "key", F.get(F.array(F.lit("ads"), F.lit("malware"), F.lit("adult")), n(F.floor(x / 11) % 3)).alias("category"),
                        F.date_add(first, n(F.floor(x / 64) % 365)).alias("d1"), x)
    dated = dated.withColumn("d2", F.date_add("d1", n(30 + F.floor(x / 32) % 200))).withColumn("d3", F.date_add("d2", 20))
    row = lambda action, day: F.struct(F.lit(action).alias("action"), F.col(day).alias("day"))
    history = F.when(x % 2 == 1, F.array(row("add", "d1"))).when(x % 5 > 1, F.array(row("add", "d1"), row("remove", "d2"))).otherwise(
        F.array(row("add", "d1"), row("remove", "d2"), row("add", "d3")))
    return dated.select("kind", "key", "category", F.explode(history).alias("e")).select(
        "kind", "key", "category", "e.action", "e.day")


_OP3 = r"""
WITH c AS (SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST(CAST('0x' || substr(md5('fetch-' || COALESCE(CAST(page_id AS VARCHAR), '')), 1, 8) AS BIGINT) % 540 AS INTEGER) AS day,
        lower(regexp_extract(COALESCE(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
        list_filter(string_split(regexp_extract(COALESCE(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
k AS (SELECT page_id, url, day, 'host' AS kind, host AS key FROM c WHERE host <> ''
  UNION SELECT page_id, url, day, 'domain', array_to_string(l[i:], '.') FROM (SELECT *, unnest(range(1, len(l))) AS i FROM (SELECT *, string_split(host, '.') AS l FROM c WHERE host <> ''))
  UNION SELECT page_id, url, day, 'prefix', host || '/' || array_to_string(parts[1:i], '/') FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM c WHERE host <> '')),
x AS (SELECT DISTINCT kind, key, CAST('0x' || substr(md5(kind || ':' || key), 1, 8) AS BIGINT) AS x FROM k),
y AS (SELECT *, CASE (x // 11) % 3 WHEN 0 THEN 'ads' WHEN 1 THEN 'malware' ELSE 'adult' END AS category,
        DATE '2024-01-01' + CAST((x // 64) % 365 AS INTEGER) AS d1 FROM x
      WHERE x % CASE kind WHEN 'host' THEN 3 WHEN 'domain' THEN 5 ELSE 7 END = 0),
z AS (SELECT *, d1 + CAST(30 + (x // 32) % 200 AS INTEGER) AS d2 FROM y),
e AS (SELECT kind, key, category, 'add' AS action, d1 AS day FROM z
  UNION ALL SELECT kind, key, category, 'remove', d2 FROM z WHERE x % 2 = 0
  UNION ALL SELECT kind, key, category, 'add', d2 + 20 FROM z WHERE x % 2 = 0 AND x % 5 <= 1),
a AS (SELECT k.page_id, k.url, k.day, k.kind, k.key, category, arg_max(action, e.day) AS state
      FROM k JOIN e ON e.kind = k.kind AND e.key = k.key AND e.day <= k.day GROUP BY ALL),
v AS (SELECT page_id, url, day, COUNT(*) AS n_active, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
        arg_max(key, (CASE kind WHEN 'domain' THEN 1 WHEN 'host' THEN 2 ELSE 3 END, length(key), key)) AS rule
      FROM a WHERE state = 'add' GROUP BY ALL)
SELECT c.page_id, c.url, c.day, CAST(COALESCE(n_active, 0) AS BIGINT) AS n_active, COALESCE(categories, '') AS categories, rule,
  COALESCE(n_active, 0) > 0 AS blocked
FROM c LEFT JOIN v ON v.page_id IS NOT DISTINCT FROM c.page_id AND v.url IS NOT DISTINCT FROM c.url AND v.day = c.day
"""


@_register("op3_url_filter", _OP3)
def op3(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (_crc(F.concat(
        F.lit("fetch-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))) % 540).cast("int"))
    return urlfilter.evaluate(pages.withColumn("day", fetched), url_lists(pages))


@_register("op4_nearest_neighbours")
def op4(spark: SparkSession, d: str) -> DataFrame:
    return ann.search(table(spark, d, "embeddings").select("vec_id", "embedding"))


_OP8 = """
WITH p AS (SELECT page_id, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS n, sha1(COALESCE(html, '')) AS h FROM pages),
m AS (SELECT h, MAX(page_id) AS last FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN m ON m.h = p.h
"""


@_register("op8_warc", _OP8)
def op8(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    warc.archive(table(spark, d, "pages").select("page_id", "url", "html"), path)
    return warc.captures(spark, path)


_OP11 = """
WITH x AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, COALESCE(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])), 0)::BIGINT AS score, q.x AS qx
      FROM x q JOIN x c ON len(q.x) = len(c.x) AND (q.vec_id <> c.vec_id OR q.x <> c.x) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, qx ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


@_register("op11_exact_topk", _OP11)
def op11(spark: SparkSession, d: str) -> DataFrame:
    return mtree.search(table(spark, d, "embeddings").select("vec_id", "embedding"))


@_register("op12_cross_tokenizer")
def op12(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    aligned = crosstok.align_texts(crosstok.distinct_texts(docs), *crosstok.tokenizer_files())
    digests = aligned.withColumn("groups_sha256", F.sha2(F.col("groups"), 256)).drop("groups")
    found = crosstok.align(docs, cut(digests, "crosstok-aligned"), extra=("groups_sha256",))
    return found.withColumn("groups_sha256", F.coalesce("groups_sha256", F.lit("")))


@_register("op13_embedding_whitening")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings").select("vec_id", "embedding"))
