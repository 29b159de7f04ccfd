"""Benchmark decontamination with a distributed positional inverted index.

Items are cut into windows of ``WINDOW`` consecutive words (a shorter item is one window). An index
of training token postings (term, document, position) is stored for the terms asked for. A window
is found by intersecting the posting lists of its terms, each list shifted by the term's offset in
the window, beginning with the terms that are rarest in the training corpus:

1. corpus counts of all benchmark terms; a window with a term the corpus lacks cannot occur;
2. postings of every window's ``anchors`` rarest terms are stored and intersected;
3. for the documents that are left, postings of all their benchmark terms are stored, and the
   remaining lists are intersected, which makes the matches exact.

Token rows never meet a table of unknown size in one task: benchmark tables are broadcast after
their rows were counted (``broadcast_rows``) and joined by shuffle beyond that, where adaptive
execution splits frequent terms. Matches are joined by document and position, so a frequent term or
passage is spread over all tasks. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom.llm.common import cut, packed
from walkloom.llm.words import count_of, spaced, words_of

WINDOW = 10
ANCHORS = 3
BROADCAST_ROWS = 300_000
KEY = ("_d", "_h")


def _small(df: DataFrame, limit: int) -> DataFrame:
    """A broadcast hint if the table was counted and found small enough."""
    return F.broadcast(df) if df.count() <= limit else df


def keyed(docs: DataFrame) -> DataFrame:
    """(_d, _h, text): a row is known by its id and a hash of its text, so repeated ids with other
    texts stay apart. A null id is a key of its own."""
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_d"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), "text")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, wid, words) of all windows; items without words have none."""
    w = items.select("item_id", words_of(spaced(F.col("text"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    cut_out = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return cut_out.select("item_id", F.md5(F.concat_ws(" ", "words")).alias("wid"), "words")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, _d, _h, pos) of the tokens of ``docs`` (from ``keyed``) that are in ``terms`` (term). A
    text without words yields an empty token, which no term equals."""
    tokens = docs.select(*KEY, F.posexplode(F.split(spaced(F.col("text")), " ")).alias("pos", "term"))
    return tokens.join(terms, "term").select("term", *KEY, "pos")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often the corpus has each of ``terms``; absent terms are absent."""
    tokens = docs.select(F.explode(F.split(spaced(F.col("text")), " ")).alias("term"))
    return tokens.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def ranked_terms(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """(wid, size, terms): terms as (n, off, term), rarest first, of the windows whose every term
    the corpus has. A window has at most ``WINDOW`` terms."""
    parts = wins.select("wid", F.size("words").alias("size"), F.posexplode("words").alias("off", "term"))
    return (parts.join(counts, "term")
            .groupBy("wid", "size").agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("terms"))
            .where(F.size("terms") == F.col("size")))


def intersect(found: DataFrame, posts: DataFrame, term: Column, off: Column, slack: int = 0) -> DataFrame:
    """Rows of ``found`` (key, start, ...) for which ``posts`` has ``term`` at start + off, or
    within ``slack`` words of it. A null term leaves a row in."""
    at = F.explode(F.sequence(F.lit(-slack), F.lit(slack))) if slack else F.lit(0)
    want = found.withColumn("term", term).withColumn("_at", at).withColumn("pos", F.col("start") + off + F.col("_at"))
    hit = want.where(F.col("term").isNotNull()).join(posts, ["term", *KEY, "pos"], "left_semi")
    rest = want.where(F.col("term").isNull())
    out = hit.unionByName(rest).drop("term", "pos", "_at")
    return out.distinct() if slack else out


def candidates(posts: DataFrame, ranked: DataFrame, anchors: int = ANCHORS, slack: int = 0,
               limit: int = BROADCAST_ROWS) -> DataFrame:
    """(key, wid, size, start): places where the ``anchors`` rarest terms of a window stand at their
    offsets; with ``slack``, near them (a proximity match)."""
    pick = [F.get("terms", F.lit(i)) for i in range(anchors)]
    first = ranked.select("wid", "size", pick[0]["term"].alias("term"), pick[0]["off"].alias("off"),
                          *[x for i in range(1, anchors) for x in (pick[i]["term"].alias(f"t{i}"), pick[i]["off"].alias(f"o{i}"))])
    found = (posts.join(_small(first, limit), "term").withColumn("start", F.col("pos") - F.col("off"))
             .where(F.col("start") >= 0).drop("term", "off", "pos"))
    for i in range(1, anchors):
        found = intersect(found, posts, F.col(f"t{i}"), F.col(f"o{i}"), slack).drop(f"t{i}", f"o{i}")
    return found.select(*KEY, "wid", "size", "start").distinct()


def proximity(docs: DataFrame, items: DataFrame, size: int = WINDOW, anchors: int = ANCHORS, slack: int = 3,
              limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc, wid, start) where a window's rarest terms stand within ``slack`` words of their places."""
    posts, ranked, *_ = _prepared(docs, items, size, anchors, limit)
    return candidates(posts, ranked, anchors, slack, limit).select(F.col("_d").alias("doc"), "wid", "start")


def _prepared(docs: DataFrame, items: DataFrame, size: int, anchors: int, limit: int):
    corpus = keyed(docs)
    every = cut(windows(items, size), "decontam-windows")
    wins = every.select("wid", "words").dropDuplicates(["wid"])
    vocabulary = cut(wins.select(F.explode("words").alias("term")).distinct(), "decontam-terms")
    counts = cut(term_counts(corpus, _small(vocabulary, limit)), "decontam-counts")
    ranked = cut(ranked_terms(wins, counts), "decontam-ranked")
    rare = ranked.select(F.explode(F.slice("terms", 1, anchors)).alias("t")).select("t.term").distinct()
    posts = cut(postings(corpus, _small(rare, limit)), "decontam-index")
    return posts, ranked, every, corpus


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, anchors: int = ANCHORS,
                   limit: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Exact occurrences (_d, _h, wid, size, start), and the (item_id, wid) table."""
    posts, ranked, every, corpus = _prepared(docs, items, size, anchors, limit)
    likely = cut(candidates(posts, ranked, anchors, 0, limit), "decontam-candidates")
    left = likely.select(*KEY).distinct()
    terms = likely.select("wid").distinct().join(ranked, "wid").select("wid", F.explode("terms").alias("t")).select(
        "wid", F.col("t.term").alias("term"), F.col("t.off").alias("off"))
    terms = cut(terms, "decontam-left-terms")
    texts = corpus.join(_small(left, limit), list(KEY), "left_semi")
    full = cut(postings(texts, _small(terms.select("term").distinct(), limit)).distinct(), "decontam-index2")
    wanted = (likely.join(_small(terms, limit), "wid")
              .select(*KEY, "wid", "size", "start", "term", (F.col("start") + F.col("off")).alias("pos")))
    exact = (wanted.join(full, ["term", *KEY, "pos"], "left_semi")
             .groupBy(*KEY, "wid", "size", "start").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") == F.col("size")).drop("n"))
    return exact, every.select("item_id", "wid").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, anchors: int = ANCHORS,
                  limit: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, _h.

    Null and empty texts have no words and no hits. Items with a null id hit words but are not
    listed. Repeated rows get equal results.
    """
    exact, of = phrase_matches(docs, items, size, anchors, limit)
    exact = cut(exact, "decontam-matches")
    # words covered: what every match adds beyond the matches before it
    order = Window.partitionBy(*KEY).orderBy("start", F.desc("size"), "wid")
    end = F.col("start") + F.col("size")
    before = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = (exact.withColumn("_new", F.greatest(end - F.greatest(F.col("start"), before), F.lit(0)))
               .groupBy(*KEY).agg(F.sum("_new").alias("n_hit")))
    # windows that the same items have are alike; one stands for all
    alike = (of.where(F.col("item_id").isNotNull()).groupBy("wid")
             .agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("item_id")).alias("x"),
                  F.bit_xor(F.xxhash64("item_id", F.lit(1))).alias("y")))
    leads = alike.groupBy("c", "x", "y").agg(F.min("wid").alias("lead"))
    alike = alike.join(leads, ["c", "x", "y"]).select("wid", "lead")
    listed = (exact.select(*KEY, "wid").join(alike, "wid").select(*KEY, F.col("lead").alias("wid")).distinct()
              .join(of, "wid").select(*KEY, F.col("item_id").cast("string").alias("item")).distinct()
              .groupBy(*KEY).agg(F.sort_array(F.collect_list("item")).alias("items")))
    found = covered.join(listed, list(KEY), "left")
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_d"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"), spaced(text).alias("_s"))
    rows = rows.select("doc_id", *KEY, count_of(F.col("_s")).alias("n_words"))
    items_of = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.join(found, list(KEY), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "_h")


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, anchors: int = ANCHORS,
          limit: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows that contain a window of an item."""
    exact, _ = phrase_matches(docs, items, size, anchors, limit)
    hit = cut(exact.select(*KEY).distinct(), "decontam-hit")
    rows = packed(docs, "doc_id", "text").select(
        "_row", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_d"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    return rows.join(_small(hit, limit), list(KEY), "left_anti").select("_row.*")
