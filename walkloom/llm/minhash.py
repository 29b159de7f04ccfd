"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Every distinct shingle set gets a signature of ``K`` coordinates and is posted under each
(coordinate, value). Two sets are candidates if they collide in at least ``MATCHES`` coordinates;
at a similarity of 0.75 a true pair falls short of that with a probability of about 5e-6, above
it far more rarely.

*Prefix and skip merging*: all lists are ordered by length. Two sets that share ``MATCHES`` of
``K`` lists must meet in the first ``K - MATCHES + 1`` lists of both in that order, so each set is
posted there only, its longest ``MATCHES - 1`` lists are skipped, and a set with fewer shared
lists than ``MATCHES`` is not posted at all. A passage that half the corpus contains makes long
lists, yet leaves no candidates, because documents that share little else are never posted.

*No all-pairs*: only the components are wanted. Each round lets every posting list name two
pivots; a member outside a pivot's component is compared with its best pivots, confirmed on
full shingle sets, and components grow. What is left, members of different components in one list,
is compared too, unless a bound on their common shingles shows that they cannot be similar enough (see
``remaining``). So no link between different texts is lost, and a group of G near copies costs about G
comparisons per round, not G squared. Exact copies are one set from the start.

Rows that share a doc_id count as one document; a null doc_id takes part in nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom.llm.common import cut, slices, unused
from walkloom.llm.graph import components
from walkloom.llm.idfilter import build, matching

WORDS = 5
K = 48
MATCHES = 22
PERCENT = 75
ROUNDS = 2
#: Lists up to this many members are paired without the bound on shared shingles.
SMALL = 32
#: A shingle that so many sets have at most is rare.
RARE = 4
_P = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 64, K, dtype=np.uint64) | np.uint64(1)
_C = _RNG.integers(0, 1 << 64, K, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text. A text of fewer words
    has one shingle, its whole sequence; one without words has none."""
    if not text:
        return np.zeros(0, np.uint64)
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    raw = np.empty(len(tokens), object)
    raw[:] = tokens
    h = pd.util.hash_array(raw, categorize=False)
    n = min(words, len(h))
    m = len(h) - n + 1
    code = np.full(m, n, np.uint64)
    for i in range(n):
        code = code * _P + h[i:i + m]
    return np.unique(_mix(code))


def signature(sh: np.ndarray, k: int = K) -> np.ndarray:
    out = np.full(k, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(sh), 4096):
        block = sh[a:a + 4096, None] * _A[None, :k] + _C[None, :k]
        out = np.minimum(out, block.min(axis=0) >> np.uint64(32))
    return out.astype(np.uint32).view(np.int32)


def _lists(arrays, kind):
    """Arrow lists out of numpy arrays."""
    import pyarrow as pa
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if len(arrays) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind, copy=False)))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig): k1 and k2 name the shingle set. A few texts at a time."""
    def run(batches):
        import hashlib

        import pyarrow as pa
        for batch in slices(batches):
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            keys = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                 pa.array([k[1] for k in keys], pa.int64()), _lists([signature(s) for s in sets], np.int32)],
                names=["doc_id", "n_shingles", "k1", "k2", "sig"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, k1 long, k2 long, sig array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, wanted, words: int = WORDS) -> DataFrame:
    """(id, set) of the documents an id filter lets through."""
    def made(batch):
        import pyarrow as pa
        sets = [shingles(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), _lists(sets, np.int64)], names=["id", "set"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return matching(docs.select("doc_id", "text"), "doc_id", wanted, then=made, schema=f"id {kind}, set array<long>")


def collisions(a: Column, b: Column) -> Column:
    """In how many coordinates two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def posted(reps: DataFrame, matches: int = MATCHES, k: int = K) -> DataFrame:
    """(rep, list) after prefix and skip merging; lists of one member are gone."""
    at, value = "pos", "col"
    posts = reps.select("rep", F.posexplode("sig")).select(
        "rep", F.shiftleft(F.col(at).cast("long"), 32).bitwiseOR(
            F.col(value).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("list"))
    lengths = posts.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mine = (posts.join(lengths, "list").groupBy("rep")
            .agg(F.sort_array(F.collect_list(F.struct("n", "list"))).alias("ls"))  # at most k entries
            .where(F.size("ls") >= matches))
    return mine.select("rep", F.explode(F.slice("ls", F.lit(1), F.size("ls") - (matches - 1))).alias("l")).select(
        "rep", F.col("l.list").alias("list"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that are similar enough on their full shingle sets."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .withColumn("_both", both)
            .where(100 * F.col("_both") >= percent * (F.size("sa") + F.size("sb") - F.col("_both")))
            .select("a", "b"))


def _plausible(pairs: DataFrame, members: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs that collide often enough and whose sizes allow the similarity, with the count."""
    left = members.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("ga"))
    right = members.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("gb"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            .withColumn("hits", collisions(F.col("ga"), F.col("gb")))
            .where(F.col("hits") >= matches).select("a", "b", "hits"))


def link_components(docs: DataFrame, reps: DataFrame, words: int = WORDS, percent: int = PERCENT,
                    matches: int = MATCHES, rounds: int = ROUNDS, best: int = 2) -> DataFrame:
    """(rep, comp) for the representatives that are linked with others; the rest stand alone.

    ``reps`` has one row (rep, n, sig) per distinct shingle set.
    """
    posts = cut(posted(reps, matches), "minhash-posts")
    wanted = build(posts.select("rep"), "rep")
    if wanted is None:
        return reps.select("rep", F.col("rep").alias("comp")).limit(0)
    sets = cut(shingle_sets(docs, wanted, words), "minhash-sets")
    members = cut(matching(reps, "rep", wanted), "minhash-members")
    comps = None
    for turn in range(rounds):
        if comps is None:
            here = posts.withColumn("comp", F.col("rep"))
        else:
            here = posts.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        pivots = (here.groupBy("list").agg(F.min(F.struct("comp", "rep")).alias("lo"),
                                           F.max(F.struct("comp", "rep")).alias("hi"))
                  .where(F.col("lo.comp") != F.col("hi.comp")))
        offered = here.join(pivots, "list").select("rep", "comp", F.explode(F.array("lo", "hi")).alias("p"))
        pairs = (offered.where(F.col("comp") != F.col("p.comp"))
                 .select(F.col("rep").alias("a"), F.col("p.rep").alias("b")).distinct())
        order = Window.partitionBy("a").orderBy(F.desc("hits"), "b")  # a set has at most 2 pivots per list
        tried = (_plausible(pairs, members, matches, percent).withColumn("_r", F.row_number().over(order))
                 .where(F.col("_r") <= best).select("a", "b"))
        links = cut(confirmed(tried, sets, percent), "minhash-links")
        comps = _grown(comps, links)
    rest = cut(remaining(posts, comps, members, sets, matches, percent), "minhash-pairs")
    if rest.isEmpty():
        return comps
    return _grown(comps, cut(confirmed(rest, sets, percent), "minhash-rest"))


def remaining(posts: DataFrame, comps: DataFrame, members: DataFrame, sets: DataFrame, matches: int = MATCHES,
              percent: int = PERCENT, small: int = SMALL, rare: int = RARE) -> DataFrame:
    """The pairs (a, b) of different components that share a list and may still be linked.

    A pair comes once, from the first list both are posted in; the members of a list's largest
    component are not paired with one another. In lists of more than ``small`` members a pair must
    also pass a bound on its overlap. A shingle is rare if at most ``rare`` sets of all these lists
    have it; the other shingles of a set number c. Two sets of n and m shingles without a common rare
    one overlap in at most the smaller c, and a similarity of p percent takes p (n + m) / (100 + p). Pairs
    with a common rare shingle are found by joining those, at most ``rare`` to a shingle. So in a large group of
    near copies, the many that are too far from all others leave hardly a pair.
    """
    here = cut(posts.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "minhash-here")
    per = here.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("n"))
    lists = (per.groupBy("list").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("size"),
                                     F.count(F.lit(1)).alias("kinds"))
             .where("kinds > 1").select("list", F.col("m.comp").alias("main"), (F.col("size") <= small).alias("few")))
    mixed = cut(here.join(lists, "list"), "minhash-mixed")
    known = members.join(mixed.groupBy("rep").agg(F.sort_array(F.collect_list("list")).alias("lists")), "rep")  # k at most
    crowd = mixed.where(~F.col("few")).select(F.col("rep").alias("id"), "comp").distinct()
    own = sets.join(crowd, "id").select("id", "comp", F.explode("set").alias("s"))
    common = own.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = cut(own.join(common, "s"), "minhash-shared")
    core = seen.where(F.col("n") > rare).groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    scarce = seen.where(F.col("n") <= rare)
    by_rare = (scarce.select("s", F.col("id").alias("a"), F.col("comp").alias("ca"))
               .join(scarce.select("s", F.col("id").alias("b"), F.col("comp").alias("cb")), "s")
               .where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct())
    known = cut(known.join(core.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("c", F.lit(0))),
                "minhash-known")
    rows = mixed.join(known, "rep")
    side = lambda tag: [F.col(x).alias(x + tag) for x in ("rep", "comp", "n", "sig", "lists", "c")]
    need = (100 + percent) * F.least("c1", "c2") >= percent * (F.col("n1") + F.col("n2"))
    pairs = (rows.where(F.col("comp") != F.col("main")).select("list", "few", *side("1"))
             .join(rows.select("list", "main", *side("2")), "list")
             .where((F.col("comp1") != F.col("comp2"))
                    & ((F.col("comp2") == F.col("main")) | (F.col("rep1") < F.col("rep2")))
                    & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
                    & (F.col("few") | need)
                    & (F.col("list") == F.array_min(F.array_intersect("lists1", "lists2")))
                    & (collisions(F.col("sig1"), F.col("sig2")) >= matches))
             .select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")))
    more = _plausible(by_rare, members, matches, percent).select("a", "b")
    return pairs.unionByName(more).distinct()


def _grown(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: the links are contracted to the components they join."""
    if comps is None:
        return components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = comps.select(F.col("rep"), F.col("comp"))
    edges = (links.join(named.select(F.col("rep").alias("a"), F.col("comp").alias("u")), "a", "left")
             .join(named.select(F.col("rep").alias("b"), F.col("comp").alias("v")), "b", "left")
             .select(F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v")))
    if edges.isEmpty():
        return comps
    joined = components(edges).select(F.col("rep").alias("_old"), F.col("comp").alias("_new"))
    moved = comps.join(joined, F.col("comp") == F.col("_old"), "left").select(
        "rep", F.coalesce("_new", "comp").alias("comp"))
    fresh = joined.select(F.col("_old").alias("rep"), F.col("_new").alias("comp"))
    return cut(moved.unionByName(fresh).groupBy("rep").agg(F.min("comp").alias("comp")), "minhash-comps")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, matches: int = MATCHES,
                    rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document without words stands alone. A null doc_id has no component and is kept. Rows with
    the same doc_id share a component.
    """
    prints = cut(fingerprints(docs, words), "minhash-prints")
    some = prints.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    reps = cut(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"),
                                            F.max("sig").alias("sig")), "minhash-reps")
    comps = link_components(docs, reps.select("rep", "n", "sig"), words, percent, matches, rounds)
    named = (reps.select("k1", "k2", "rep").join(comps, "rep", "left")
             .select("k1", "k2", F.coalesce("comp", "rep").alias("comp")))
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    found = (prints.where(~alone).drop("sig").join(named, ["k1", "k2"], "left")
             .select("doc_id", "n_shingles", F.col("comp").alias("component_id")))
    rest = prints.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(rest).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def deduplicate(docs: DataFrame, **knobs) -> DataFrame:
    """``docs`` without the documents that are not kept. Only documents a filter on the dropped ids
    lets through are shuffled; all others pass where they are."""
    result = cut(near_duplicates(docs, **knobs), "minhash-result")
    gone = unused(docs, "_gone")
    dropped = result.where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    wanted = build(dropped, gone)
    if wanted is None:
        return docs
    maybe = matching(docs, "doc_id", wanted)
    return matching(docs, "doc_id", wanted, keep=False).unionByName(
        maybe.join(dropped, F.col("doc_id") == F.col(gone), "left_anti"))
