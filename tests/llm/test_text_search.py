"""License scan and decontamination against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, empty_documents, odd_documents, words
from walkloom.llm import decontam, license, license_rules

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def scan(text):
    """Every rule at every word, then suppression by comparing all detections."""
    w, found = split(text), []
    for i in range(len(w)):
        near = " ".join(w[i:i + license_rules.REACH])
        for n, (label, level, pattern) in enumerate(license.rule_table()):
            m = re.match(f"({pattern})(?: |\\Z)", near)
            if m:
                found.append((i, i + len(m[1].split(" ")), level, n, label))
    hides = lambda e, d: (e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]
                          and (e[0] < d[0] or e[1] > d[1] or e[2] > d[2] or e[3] < d[3]))
    kept = [d for d in found if not any(hides(e, d) for e in found)]
    base = [d for d in found if d[3] < len(license.BASE)]
    names = lambda ds: ",".join(sorted({d[4] for d in ds}))
    starts = [d[0] for d in base]
    return (len(w), len(base), min(starts, default=None), max(starts, default=None), names(base), names(base + kept),
            license.CONFIDENCE[max(d[2] for d in kept)] if kept else 0.0)


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file",
    "This work is licensed under the GNU General Public License, version 3. CC BY, cc-by CC BY 4.0. All rights reserved",
    "SPDX-License-Identifier: MIT\nPermission is hereby granted, free of charge, to any person obtaining a copy of",
    "all rights reserved all rights reserved. general public license general public",
    "mit mit mit License released under the MIT License gplv2 GPL v2 gpl 2 agplv3",
    "© 2020 Someone. Copyright 2021 by them; some rights. Creative Commons Attribution-ShareAlike 4.0",
    "Neither the name of the copyright holder nor the names of its contributors may be",
    "RELEASED INTO THE PUBLIC DOMAIN. redistribution and use in source and binary forms, with or without modification, are permitted",
]


def test_scan_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = sorted({w for t in TEXTS for w in split(t)}) + ["a", "b"]
    texts = TEXTS + [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(40)]
    texts += [f"{rng.choice(TEXTS)} {rng.choice(TEXTS)[:40]}" for _ in range(20)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    for r in license.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == scan(r.text), r.text


def test_rules_fit_their_reach_and_start_with_their_keyword():
    table = license.rule_table()
    assert 200 < len(table) < 600
    for _, level, pattern in table:
        re.compile(pattern)
        assert level in license.CONFIDENCE and license_rules.keywords(pattern)
        assert all(re.fullmatch("[a-z0-9©]+", k) for k in license_rules.keywords(pattern))
        assert level != 4 or pattern.count(" ") < license_rules.REACH


def test_scan_of_odd_rows(spark):
    df, clash = odd_documents(spark)
    rows = license.scan(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.n_words == len(split(r.text)) and r["_t"] == "mine-_t" and r.labels == "" and r.score == 0
    assert license.scan(empty_documents(spark)).collect() == []
    many = spark.createDataFrame([(1, "all rights reserved " * 4000, None, None, 0)], SCHEMA)
    r = license.scan(many).first()
    assert (r.n_base, r.first_word, r.last_word, len(r.found)) == (4000, 0, 11997, 4000)


def test_dense_texts_and_odd_ends(spark):
    texts = [" ".join(["released under the mit license and the gnu general public license version 2 cc by"] * 30),
             "mit license all rights reserved\u0085 all rights reserved\u2028 cc by", "all rights reserved\u0085", "cc by\u2029x cc by"]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    for r in license.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == scan(r.text), r.text
    dense = spark.createDataFrame([(1, "mit license or " * 8000, None, None, 0)], SCHEMA)
    r = license.scan(dense).first()
    assert len(r.found) == 8000 and r.labels == "mit"


def test_capturing_groups_are_refused(spark):
    with pytest.raises(ValueError):
        license.scan(spark.createDataFrame([(1, "a", None, None, 0)], SCHEMA), [("x", 1, "some (thing)")])


def check(docs, items, size=10):
    """Hit words and items of every document by trying every window at every place."""
    out = []
    for _, text in docs:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            b = split(t)
            n = min(size, len(b))
            for j in range(len(b) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == b[j:j + n]:
                        hit |= set(range(i, i + n))
                        found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [300_000, 0])
def test_decontamination_equals_brute_force(spark, rng, limit):
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([25, 10, 12, 3, 1, 40])]
    items += [(6, items[0][1]), (7, None), (8, ""), (9, "..."), (None, " ".join(words(rng, 15))), (10, " ".join(["w1"] * 14)),
              (11, items[0][1]), (11, items[0][1] + " w2")]
    docs = []
    for k in range(40):
        parts = [words(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            b = split(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(b) - 5))
            parts += [b[a:a + rng.choice([9, 10, 11, 30])], words(rng, rng.randint(0, 3))]
        docs.append((k, rng.choice([" ", "-", ". "]).join(w for p in parts for w in p).upper()))
    docs += [(90, " ".join(["w1"] * 30)), (91, None), (92, ""), (None, items[0][1]), (93, items[0][1]), (93, items[0][1]), (93, "w1"), (94, items[10][1])]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                 for r in decontam.decontaminate(df, bench, limit=limit).collect())
    want = sorted((str(i), *c) for (i, _), c in zip(docs, check(docs, items)))
    assert got == want
    clean = decontam.clean(df, bench, limit=limit)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(w[0] for w in want if not w[-1])


def test_decontamination_of_odd_rows(spark):
    df, clash = odd_documents(spark)
    items = spark.createDataFrame([(1, "same row"), (None, None)], "item_id long, text string")
    rows = decontam.decontaminate(df, items).collect()
    assert len(rows) == df.count() and sum(r.contaminated for r in rows) == 2
    out = decontam.clean(df, items)
    assert out.columns == df.columns and out.count() == df.count() - 2 and out.where("_h <> 'mine-_h'").count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(df, none).where("contaminated").count() == 0
    assert decontam.clean(df, none).count() == df.count()
    assert decontam.decontaminate(empty_documents(spark), items).collect() == []


def test_proximity_finds_a_changed_phrase(spark, rng):
    item = words(rng, 10, 10**6)
    changed = [*item[:4], "inserted", *item[4:]]
    far = [*item[:4], *["far"] * 9, *item[4:]]
    df = spark.createDataFrame([(1, " ".join(item), None, None, 0), (2, " ".join(changed), None, None, 0), (3, " ".join(far), None, None, 0)], SCHEMA)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    near = {r.doc for r in decontam.proximity(df, bench, anchors=10, slack=1).collect()}
    assert near == {"1", "2"}
    assert decontam.decontaminate(df, bench).where("contaminated").select("doc_id").collect()[0][0] == 1
