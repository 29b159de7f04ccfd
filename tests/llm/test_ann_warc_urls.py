"""Nearest neighbours, WARC files and URL lists against brute force."""

import datetime as dt
import fractions
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from walkloom.llm import ann, urlfilter, warc

VECTORS = "vec_id long, embedding array<float>, label int"


def nearest(rows, every, k=10):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max({len(v) for _, v in fine}, key=lambda d: sum(len(v) == d for _, v in fine))
    fine = [(i, v) for i, v in fine if len(v) == dim]
    out = {}
    for q, x in fine:
        if q % every == 0:
            near = sorted({(float(np.sqrt(((v - x)**2).sum())), i) for i, v in fine if i != q})[:k]
            out[q] = near
    return out


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.4, 32)).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    want = nearest(rows, 50)
    for block in (4096, 64):
        got = {}
        for r in ann.search(df, every=50, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
            assert r.rank == len(got[r.query_id])
        assert set(got) == set(want)
        hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
        assert hits >= 0.9 * 10 * len(want)
        vec = dict(rows)
        for q, near in got.items():
            assert near == sorted(near)
            assert all(abs(d - np.sqrt(((np.array(vec[i]) - np.array(vec[q]))**2).sum())) < 1e-9 for d, i in near)


def test_small_odd_tables_are_exact(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (1, v), (2, [0.0, 0.0, 0.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]),
            (7, [float("inf"), 1.0, 1.0]), (8, [5.0, 5.0]), (None, v), (9, [1.0, 2.0, 4.0]), (9, [1.0, 2.0, 4.0]), (10, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, x, None) for i, x in rows], VECTORS).withColumn("rank", F.lit("mine"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, every=10).orderBy("query_id", "rank").collect()]
    want = [(q, n + 1, i, d) for q, near in sorted(nearest(rows, 10).items()) for n, (d, i) in enumerate(near)]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert ann.search(df.limit(0)).collect() == []
    assert ann.search(df.where("vec_id = 0")).collect() == []


def test_extreme_components_lose_nobody(spark):
    """Squares of 1e200 overflow and those of 1e-200 vanish; every query still gets all others, in their order."""
    rows = [(0, [1e200, 0.0]), (100, [3e200, 1e200]), (1, [-2e200, 5e199]), (2, [1e-200, 2e-200]), (3, [3e-200, 1e-200]), (4, [1.0, 2.0]),
            (200, [2e-200, 2e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vec = {i: [fractions.Fraction(c) for c in v] for i, v in rows}
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in (0, 100, 200):
        want = sorted((sum((a - b)**2 for a, b in zip(vec[q], vec[i])), i) for i in vec if i != q)
        assert {i for i, _ in got[q]} == {i for _, i in want}
        for i, d in got[q]:
            exact = sum((a - b)**2 for a, b in zip(vec[q], vec[i]))
            assert abs(fractions.Fraction(d)**2 - exact) <= exact / 10**12
        assert [d for _, d in got[q]] == sorted(d for _, d in got[q])


def test_recall_on_the_given_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    e = spark.read.parquet(path).select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in e]), np.array([r.embedding for r in e], float)
    got = {}
    for r in ann.search(spark.read.parquet(path)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q])**2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits / (10 * len(got)) >= 0.95 and len(got) == (ids % 100 == 0).sum()


def test_every_length_gets_neighbours(spark):
    rng = np.random.default_rng(6)
    dims = {0: 3, 1: 5, 2: 3, 3: 8}
    rows = [(i, rng.normal(size=dims[i % 4]).astype(np.float32).tolist()) for i in range(120)]
    rows += [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(200, 212)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = {}
    for r in ann.search(df, every=5, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    vec = dict(rows)
    assert set(got) == {i for i, _ in rows if i % 5 == 0}
    for q, ids in got.items():
        assert len(ids) == 3 and all(len(vec[i]) == len(vec[q]) for i in ids)
        alike = [(i, v) for i, v in rows if len(v) == len(vec[q])]
        if len(alike) <= 12:
            assert ids == [i for _, i in nearest(alike, 5, 3)[q]]


def test_a_hot_vector_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0] * 16 if i % 3 else rng.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    want = nearest(rows, 100)
    for r in ann.search(df, block=128).where("query_id % 3 <> 0").collect():
        assert (r.score, r.vec_id) == want[r.query_id][r.rank - 1]


def test_abandoning_keeps_the_nearest():
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=(20, 64))
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    out_q, out_v, out_d = ann.scan_block(np.arange(4000), x, -np.arange(1, 21), q, rotation)
    for n in range(20):
        d = np.sqrt(((x - q[n])**2).sum(1))
        mine = [v for a, v in zip(out_q, out_v) if a == -(n + 1)]
        assert len(set(mine) & set(np.argsort(d)[:10])) >= 9


PAGES = "page_id long, url string, html string"


def pages(spark):
    big = "<p>" + "xé" * 600
    rows = [(1, "http://a.example/1", big), (2, "http://a.example/2", big), (9, None, big), (3, "u\r\nInjected: yes", "short"),
            (4, "http://b", "short"), (5, "http://c", None), (6, "http://d", ""), (7, "http://e", "WARC/1.1\r\n\r\n\r\n\r\n" * 80),
            (8, "http://f", "a" * 999), (10, "http://g", "a" * 999), (11, "http://h", "b" * 1000), (12, "http://h", "b" * 1000),
            (13, "http://i", "z" * 3_000_000)]
    return rows, spark.createDataFrame(rows, PAGES)


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, tmp_path, compress):
    rows, df = pages(spark)
    path = f"file://{tmp_path}/archive"
    warc.archive(df.repartition(3), path, compress=compress)
    body = {i: (h or "").encode() for i, _, h in rows}
    last = {}
    for i, b in body.items():
        if len(b) >= 1000:
            last[b] = max(last.get(b, 0), i)
    want = {(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if last.get(b, i) != i else "response", last[b] if last.get(b, i) != i else None)
            for i, b in body.items()}
    assert {tuple(r) for r in warc.captures(spark, path).collect()} == want
    back = warc.read(spark, path)
    got = {r.record_id: r for r in back.collect()}
    assert bytes(got["<urn:page:13>"].payload) == body[13] and got["<urn:page:9>"].target_uri is None
    assert got["<urn:page:3>"].target_uri == "u%0D%0AInjected: yes"


def test_append_keeps_and_overwrite_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    one = lambda i: spark.createDataFrame([(i, f"u{i}", "x" * i)], "page_id long, url string, html string")
    ids = lambda: sorted(r.page_id for r in warc.captures(spark, path).collect())
    warc.archive(one(1), path)
    warc.archive(one(2), path)
    assert ids() == [1, 2]
    with pytest.raises(Exception):
        warc.archive(one(3).withColumn("url", F.raise_error(F.lit("stop"))), path)
    assert ids() == [1, 2]
    warc.archive(one(4), path, mode="overwrite")
    assert ids() == [4]
    warc.archive(one(5), path)
    assert ids() == [4, 5]
    warc.archive(one(5).limit(0), path, mode="overwrite")
    assert ids() == []


def test_archives_from_elsewhere(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>body</p>"
    head = lambda kind, n, extra=b"": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:uuid:1>\r\n" + extra + b"Content-Length: %d\r\n\r\n" % n
    plain = head(b"warcinfo", 4, b"WARC-Target-URI: a\r\n\tb\r\n  c\r\n") + b"info\r\n\r\n"
    response = head(b"response", len(http), b"Content-Type: application/http; msgtype=response\r\n") + http + b"\r\n\r\n"
    odd = head(b"resource", 3, b"Content-Type: application/http\r\n") + b"abc\r\n\r\n"
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.warc").write_bytes(plain + response)
    (tmp_path / "deep" / "b.warc.gz").write_bytes(gzip.compress(response) + gzip.compress(odd))
    (tmp_path / "notes.txt").write_text("no archive")
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted((r.record_type, bytes(r.payload)) for r in rows) == [
        ("resource", b"abc"), ("response", b"<p>body</p>"), ("response", b"<p>body</p>"), ("warcinfo", b"info")]
    assert {r.target_uri for r in rows if r.record_type == "warcinfo"} == {"a b c"}
    assert {r.content_length for r in rows if r.record_type == "response"} == {len(http)}


def test_payloads_of_single_digests_stay(spark):
    """Only pages of shared digests pass the filter to the join."""
    df = spark.createDataFrame([(i, b"%d" % (i % 97 if i < 200 else i) * 600) for i in range(2000)], "page_id long, payload binary")
    got = warc.with_revisits(df)
    last = {}
    for i in range(2000):
        key = i % 97 if i < 200 else i
        last[key] = max(last.get(key, 0), i)
    want = {(i, last[k] if last[k] != i else None) for i in range(2000) for k in [i % 97 if i < 200 else i] if len(b"%d" % k) * 600 >= 1000}
    assert {(r.page_id, r.refers_to) for r in got.where("payload_length >= 1000").collect()} == want


def test_files_become_partitions(tmp_path):
    import json
    listed = [{"name": f"part-{i}.warc", "records": 1, "size": s} for i, s in enumerate([5, 5, 30, 1, 1])]
    (tmp_path / "manifest-1.json").write_text(json.dumps({"files": listed, "replaces": []}))
    parts = lambda n: [p.names for p in warc.WarcReader({"path": str(tmp_path), "partition_bytes": n}).partitions()]
    assert len(parts(1)) == 5 and parts(10**6) == [tuple(e["name"] for e in listed)]
    assert parts(10) == [("part-0.warc", "part-1.warc"), ("part-2.warc",), ("part-3.warc", "part-4.warc")]


def test_header_predicates_skip_payloads(spark, tmp_path):
    rows, df = pages(spark)
    path = str(tmp_path / "archive")
    warc.archive(df, path)
    some = warc.read(spark, path).where((F.col("record_type") == "revisit") & F.col("refers_to").isin("<urn:page:9>"))
    assert sorted(r.record_id for r in some.collect()) == ["<urn:page:1>", "<urn:page:2>"]
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 5)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    taken = []
    exactly = warc._Bytes.exactly
    warc._Bytes.exactly = lambda self, n: taken.append(n) or exactly(self, n)
    try:
        n = sum(batch.num_rows for part in reader.partitions() for batch in reader.read(part))
    finally:
        warc._Bytes.exactly = exactly
    assert n == 3 and set(taken) == {0}


def test_only_committed_files_are_read(spark, tmp_path):
    rows, df = pages(spark)
    path = str(tmp_path / "archive")
    warc.archive(df, path)
    (tmp_path / "archive" / "part-lost.warc").write_bytes(b"half a record")
    assert warc.read(spark, path).count() == len(rows)
    empty = str(tmp_path / "empty")
    warc.archive(df.limit(0), empty)
    assert warc.captures(spark, empty).collect() == []


def test_odd_pages(spark, tmp_path):
    df = spark.createDataFrame([(None, None, None), (1, None, "x" * 2000), (1, None, "x" * 2000), (None, "u", "x" * 2000)], PAGES)
    warc.archive(df.withColumn("payload", F.lit(3)), str(tmp_path / "a"))
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.captures(spark, str(tmp_path / "a")).collect())
    assert got == [("1", 2000, "response", None), ("1", 2000, "response", None), ("None", 0, "response", None), ("None", 2000, "revisit", 1)]


ENTRIES = "kind string, key string, category string, action string, day date"


def suffixes(url):
    import re
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)[^/?#]*([^?#]*)", url or "")
    if not m or not m[1]:
        return set()
    host = m[1].lower()
    labels, parts = host.split("."), [p for p in m[2].split("/") if p]
    return ({("host", host)} | {("domain", ".".join(labels[i:])) for i in range(len(labels) - 1)}
            | {("prefix", host + "/" + "/".join(parts[:i + 1])) for i in range(len(parts))})


def judged(entries, url, day):
    active = {}
    for kind, key, category, action, d in sorted((e for e in entries if None not in e), key=lambda e: (e[4], e[3] == "remove")):
        if day is not None and d <= day and (kind, key) in suffixes(url):
            active[kind, key, category] = action == "add"
    on = [k for k, v in active.items() if v]
    rule = max(on, key=lambda k: (urlfilter.KINDS.index(k[0]), len(k[1]), k[1]), default=(None, None))[1]
    return len(on), ",".join(sorted({k[2] for k in on})), rule, bool(on)


@pytest.mark.parametrize("seed", range(2))
def test_lists_equal_a_day_by_day_replay(spark, seed):
    rng = random.Random(seed)
    start = dt.date(2024, 1, 1)
    hosts = ["a.b.example.com", "b.example.com", "x.org", "localhost"]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in ("", "/", "/en/one?x=/no", "/en//two#f", ":80/en")] + ["http://u:p@X.org/en", "no url", "", None]
    keys = sorted({k for u in urls for k in suffixes(u)})
    entries = [(*rng.choice(keys), rng.choice(["ads", "bad"]), rng.choice(["add", "add", "remove", "noise"]), start + dt.timedelta(rng.randrange(400))) for _ in range(80)]
    entries += [entries[0], (None, "x.org", "ads", "add", start), ("host", "x.org", "ads", "add", None)]
    entries = [e for e in entries if e[3] != "noise"] + [("host", "x.org", "ads", "noise", start)]
    captures = [(i, rng.choice(urls), rng.choice([None, start + dt.timedelta(rng.randrange(-5, 420))])) for i in range(150)] + [(None, "http://x.org", start)]
    got = urlfilter.evaluate(spark.createDataFrame(captures, "page_id long, url string, day date").withColumn("rule", F.lit("mine")),
                             spark.createDataFrame(entries, ENTRIES))
    valid = [e for e in entries if e[3] in ("add", "remove")]
    want = {(i, u, d, *judged(valid, u, d)) for i, u, d in captures}
    assert {(r.page_id, r.url, r.day, r.n_active, r.categories, r.rule, r.blocked) for r in got.collect()} == want


def test_empty_lists_and_captures(spark):
    none = spark.createDataFrame([], ENTRIES)
    some = spark.createDataFrame([(1, "http://x.org", dt.date(2024, 1, 1))], "page_id long, url string, day date")
    assert [(r.n_active, r.rule, r.blocked) for r in urlfilter.evaluate(some, none).collect()] == [(0, None, False)]
    assert urlfilter.evaluate(some.limit(0), none).collect() == []
