"""Cross-tokenizer alignment against one text at a time, encoded whole by the general tokenizers."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import pytest

from tests.llm.conftest import SF, empty_documents, odd_documents, odd_texts
from walkloom.llm import crosstok, queries

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def aligner():
    return crosstok.Aligner(*crosstok.tokenizer_files())


def slow(aligner, text):
    """(groups, links) by walking over the bytes, or None."""
    if not text:
        return None
    a = aligner.general().encode(" " + text, add_special_tokens=False).ids
    b = aligner.pieces.encode(text, num_threads=1)
    sides = [(a, aligner.bytes_a), (b, aligner.bytes_b)]
    if any(b"".join(table[i] for i in ids) != (" " + text).encode() for ids, table in sides):
        return None
    ends = [list(zip(itertools.accumulate(len(table[i]) for i in ids), ids)) for ids, table in sides]
    shared = {at for at, _ in ends[0]} & {at for at, _ in ends[1]}
    spelled, last = [], []
    for side in ends:
        groups, group = [], []
        for at, i in side:
            group.append(i)
            if at in shared:
                groups.append(group)
                group = []
        spelled.append([",".join(map(str, g)) for g in groups])
        last.append([g[-1] for g in groups])
    groups, links = ["|".join(g) for g in zip(*spelled)], list(zip(*last))
    return len(a), len(b), ";".join(groups), links


def brute(aligner, rows):
    found = {t: slow(aligner, t) for t in {t for _, t in rows}}
    counts = Counter(p for _, t in rows if found[t] for p in found[t][3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, t in rows:
        if not found[t]:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = found[t]
        out.append((i, a, b, groups.count(";") + 1, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(groups.encode()).hexdigest()))
    return out


def measured(docs, **limits):
    aligned = crosstok.align_texts(crosstok.distinct_texts(docs), *crosstok.tokenizer_files())
    from pyspark.sql import functions as F
    digests = crosstok.cut(aligned.withColumn("groups_sha256", F.sha2("groups", 256)).drop("groups"), "test-aligned")
    return [tuple("" if v is None and c == "groups_sha256" else v for c, v in r.asDict().items())
            for r in crosstok.align(docs, digests, extra=("groups_sha256",), **limits).collect()]


def key(row):
    return tuple((v is None, v) if v is not None else (True, 0) for v in row)


def test_given_documents_match_brute_force(spark, aligner):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = [tuple(r) for r in queries.QUERIES["op12_cross_tokenizer"](spark, SF).collect()]
    assert sorted(got, key=key) == sorted(brute(aligner, rows), key=key)


@pytest.mark.parametrize("limits", [{}, {"heavy": 3, "hot": 2}])
def test_odd_texts_and_copies(spark, aligner, limits):
    texts = ["<s> </s> <unk> <0x41> <|endoftext|>", "a▁b", "tail ▁", "　 wide ᠎ x", "it's 'quoted' 3rd\tx  y\n\nz ", " lead", "🙂 emoji é",
             "ab" * 3000, " " * 500 + "x", "same words same words same words"]
    docs, _ = odd_documents(spark, extra=[(100 + i, t, None, None, None) for i, t in enumerate(texts * 2)])
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(measured(docs, **limits), key=key) == sorted(brute(aligner, rows), key=key)


def test_empty_table(spark):
    assert measured(empty_documents(spark)) == []


def test_words_by_themselves_are_the_whole_text(aligner):
    """Cutting a text at single spaces changes no token, whatever stands around."""
    rng = random.Random(4)
    pick = lambda: chr(rng.choice([rng.randrange(0x250), rng.randrange(0x80), 32, 32, 10, 39, 115, 0x2581, 0x180E, 0x3000, 0x4E2D, 0x1F600]))
    texts = ["".join(pick() for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + [t for t in odd_texts() if t]
    for t, found in zip(texts, aligner.align([t.encode() for t in texts])):
        want = slow(aligner, t)
        assert (found is None) == (want is None), t
        if found:
            assert found[3] == want[2] and Counter({(int(a), int(b)): int(n) for a, b, n in zip(*found[4:])}) == Counter(want[3]), t


def test_bytes_that_are_no_text(aligner):
    assert aligner.align([b"\xff\xfe", b"fine", b""])[0] is None and aligner.align([b"\xff\xfe", b"fine"])[1] is not None


def test_a_full_memory_of_words_changes_nothing(aligner, monkeypatch):
    monkeypatch.setattr(crosstok, "KNOWN", 5)
    texts = [f"word{i % 7} other{i % 5} tail{i}".encode() for i in range(60)]
    known = crosstok.Aligner(*crosstok.tokenizer_files())
    assert [known.align([t])[0][3] for t in texts] == [x[3] for x in aligner.align(texts)]
