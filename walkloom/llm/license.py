"""License scan: ordered signature rules with keyword gating, priorities and interval containment.

The text is brought to words between single blanks once. A gate looks for any keyword; in the
texts that pass, only the rules of a keyword are tried, anchored at each place where it stands.
Detections are intervals of words. A detection inside the interval of a stronger one, or of an
equally strong longer one, is suppressed; of equal detections the earlier rule stays.

Everything happens inside the row with built-in functions, so nothing is shuffled and neither hot
sources nor repeated rows matter. A detection list is bounded by its own text, and the time of a
text grows with its words and its detections, however dense they are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkloom.llm.common import packed, unpacked
from walkloom.llm.license_rules import BASE, REACH, keywords, rules
from walkloom.llm.words import count_of, spaced, words_of

#: How sure a detection of each level is.
CONFIDENCE = {1: 0.4, 2: 0.7, 3: 0.9, 4: 0.97}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_keyword(table: list[tuple[str, int, str]]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for number, (_, _, pattern) in enumerate(table):
        for word in keywords(pattern):
            out.setdefault(word, []).append(number)
    return out


def rule_table(extra: list[tuple[str, int, str]] | None = None) -> list[tuple[str, int, str]]:
    """Base phrases first, then the ordered rules; base phrases have level 1."""
    return [(label, 1, phrase) for label, phrase in BASE] + (rules() if extra is None else extra)


def detections(text_words: Column, table: list[tuple[str, int, str]]) -> Column:
    """array<array<struct<start, minus_stop, minus_level, rule, label>>>: one entry per place of a
    keyword with a detection, in the order of the text; inside a place longest, strongest, rule.

    Each place of a keyword yields the rules of that keyword that match there. They are tried
    together by one pattern per keyword, a literal of the plan that a task compiles once: a lookahead
    for every rule, whose group holds what the rule matched. Patterns may have no groups of their own.
    """
    if any(re.compile(x).groups for _, _, x in table):
        raise ValueError("a rule may not have capturing groups")
    by = _by_keyword(table)
    every = F.expr("array(" + ", ".join(
        f"named_struct('rule', {n}, 'label', {_quoted(label)}, 'level', {level})" for n, (label, level, _) in enumerate(table)) + ")")
    known = F.expr("map(" + ", ".join(f"{_quoted(w)}, array({', '.join(map(str, n))})" for w, n in by.items()) + ")")
    # what stands near a place is a field of its own: it is joined once, not once for every pattern
    places = F.transform(
        F.filter(F.transform(text_words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda p: p["w"].isin(*by)),
        lambda p: F.struct(p["w"].alias("w"), p["i"].alias("start"),
                           F.array_join(F.slice(text_words, p["i"] + 1, REACH), " ").alias("near")))

    def matched(p):
        out = F
        for word, numbers in by.items():
            groups = "".join(f"(?:(?=({table[n][2]})(?: |\\z))|)" for n in numbers)
            texts = "|".join(f"${j}" for j in range(1, len(numbers) + 1))
            out = out.when(p["w"] == word, F.regexp_replace(p["near"], F.lit(f"(?s)^{groups}.*\\z"), F.lit(texts)))
        return F.transform(F.split(out, "[|]"), lambda m, j: F.struct(m.alias("m"), j.alias("j")))

    def at(p):
        hits = F.transform(F.filter(matched(p), lambda t: t["m"] != ""), lambda t: F.struct(
            t["m"].alias("m"), F.get(every, F.get(F.element_at(known, p["w"]), t["j"])).alias("r")))
        return F.array_sort(F.transform(hits, lambda t: F.struct(
            p["start"].alias("start"),
            (-(p["start"] + F.length(t["m"]) - F.length(F.replace(t["m"], F.lit(" "), F.lit(""))) + 1)).alias("minus_stop"),
            (-t["r"]["level"]).alias("minus_level"), t["r"]["rule"].alias("rule"), t["r"]["label"].alias("label"))))

    return F.filter(F.transform(places, at), lambda d: F.size(d) > 0)


def kept(places: Column) -> Column:
    """The detections no other one suppresses. Of one place, an earlier detection reaches at least as
    far. Another place's can only contain one if it starts before it, by less than ``REACH`` words, so
    the places just before are looked at, ``REACH`` - 1 at most, whatever the length of the text."""
    def at(here, q):
        before = F.slice(places, F.greatest(q - (REACH - 2), F.lit(1)), F.least(q, F.lit(REACH - 1)))
        hides = lambda e, d: (e["minus_level"] <= d["minus_level"]) & (e["minus_stop"] <= d["minus_stop"])
        return F.filter(here, lambda d, r: ~(
            F.exists(F.slice(here, F.lit(1), r), lambda e: hides(e, d))
            | F.exists(before, lambda other: F.exists(other, lambda e: hides(e, d)))))

    return F.flatten(F.transform(places, at))


def scan(docs: DataFrame, table: list[tuple[str, int, str]] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and the
    detections ``found`` (array of start, stop, level, label) appended; columns of those names are
    replaced. Null and empty texts have no words and no detections."""
    table = table or rule_table()
    n_base_rules = len(BASE)
    gate = "(?:^| )(?:" + "|".join(sorted(_by_keyword(table))) + ")(?: |$)"
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found")
    df = packed(docs, "text").withColumn("_t", spaced(F.col("text")))
    df = df.withColumn("_w", F.when(F.rlike("_t", F.lit(gate)), words_of(F.col("_t"))))
    df = df.withColumn("_at", F.when(F.col("_w").isNotNull(), detections(F.col("_w"), table)))
    base = F.filter(F.flatten("_at"), lambda d: d["rule"] < n_base_rules)
    df = df.withColumn("_base", base).withColumn("_kept", kept(F.col("_at")))
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.transform("_base", lambda d: d["label"]), none)
    labels = F.array_union(base_labels, F.coalesce(F.transform("_kept", lambda d: d["label"]), none))
    text_of = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    sure = F.element_at(F.create_map(*[F.lit(x) for k, c in CONFIDENCE.items() for x in (k, c)]),
                        -F.array_min(F.transform("_kept", lambda d: d["minus_level"])))
    starts = F.transform("_base", lambda d: d["start"].cast("long"))
    out = F.transform("_kept", lambda d: F.struct(d["start"].alias("start"), (-d["minus_stop"]).alias("stop"),
                                                  (-d["minus_level"]).alias("level"), d["label"].alias("label")))
    return (df.withColumn("n_words", count_of(F.col("_t")))
            .withColumn("n_base", F.coalesce(F.size("_base"), F.lit(0)).cast("long"))
            .withColumn("n_base", F.greatest("n_base", F.lit(0)))
            .withColumn("first_word", F.array_min(starts)).withColumn("last_word", F.array_max(starts))
            .withColumn("base_labels", text_of(base_labels)).withColumn("labels", text_of(labels))
            .withColumn("score", F.coalesce(sure, F.lit(0.0))).withColumn("found", out)
            .transform(unpacked, docs.columns, *new))
