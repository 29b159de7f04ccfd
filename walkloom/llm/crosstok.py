"""Cross-tokenizer alignment over exact distinct texts.

Texts are brought together by their full text, so that copies are tokenised once. A task encodes each distinct
text with a byte-level BPE (A) and a sentence-piece BPE (B), lays both token rows over the bytes of
``" " + text`` and cuts them where a token of A and a token of B end together. Tokens that end together are
linked; a pair of ids counts once per link and copy of the text. Measures go back to documents by a digest.

Nothing grows in one place: pairs are counted by map-side aggregates; the best count per id of B has at
most one row per id; counts at or above ``total / HEAVY`` belong to at most ``HEAVY`` pairs, which are broadcast, all rarer
pairs are joined by a shuffle in which no key is frequent; texts with at least ``documents / HOT`` copies are at
most ``HOT`` and their measures are broadcast, so no text is a hot key on the way back.

A text is encoded whole, by one task. Null and empty texts, texts that are not UTF-8, and texts one tokenizer
normalises (the joined bytes of its tokens differ from ``" " + text``) have no tokens: all measures are 0 and the
groups empty. Repeated rows stay rows of their own, null ids stay null. Other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.llm.common import cut, skew_join

HEAVY = 200_000
HOT = 1_000
KNOWN = 200_000
SLICE = 1 << 20

MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
ALIGNED = ("key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, "
           "links array<struct<a:int,b:int,n:int>>")

#: What a byte-level pre-tokenizer splits by; fixed, as the vocabulary file only names the kind of the splitter.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A single space between two characters that no engine takes for white space.
BETWEEN = re.compile(r"(?<=[^\s\u180e\u200b\ufeff▁]) (?=[^\s\u180e\u200b\ufeff▁])")

#: Words below U+0250 that neither begin nor end with white space.
PLAIN = re.compile(r"(?!\s)[\x00-\u024f]*(?<!\s)")


def tokenizer_files() -> tuple[str, str]:
    """The installed vocabulary files of A and B."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves,
    the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers with the bytes of their ids; made once per task.

    Where the splitter of A is the standard one and no piece of B has a space after another character, no token
    reaches across a single space between two words: a text is the row of its words, ``" " + word`` each, and both
    tokenizers put a cut between them. Repeated words are then encoded and aligned once and looked up after that.
    """

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece

        self.byte_file = byte_file
        with open(byte_file, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        special = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = special[i].encode() if i in special else bytes(alphabet[c] for c in piece)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.pieces.id_to_piece, range(self.pieces.get_piece_size())))]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        a, b = range(len(self.bytes_a)), range(len(self.bytes_b))
        self.spelled = [f"{i}," for i in a] + [f"{i}|" for i in a] + [f"{i}," for i in b] + [f"{i};" for i in b] + [f"{i}\n" for i in b]
        self._general = None
        self._ranked = self._by_rank(spec, special)
        self._apart = not any(re.search("[^▁]▁", self.pieces.id_to_piece(i)) for i in b)
        self._known = _Words()

    def _by_rank(self, spec: dict, special: dict):
        """The same BPE as ranks, several times faster; None unless ids are in the order of the merges."""
        import tiktoken

        model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in pairs]
        single = [i for t, i in model["vocab"].items() if len(t) == 1]
        plain = (spec.get("normalizer") is None and splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space")
                 and splitter.get("use_regex", True))
        if not plain or made != sorted(set(made)) or len(single) != 256 or max(single) > made[0]:
            return None
        ranks = {x: i for i, x in enumerate(self.bytes_a) if i not in special}
        return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def general(self):
        if self._general is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            self._general = Tokenizer.from_file(self.byte_file)
            self._general.encode_special_tokens = True
        return self._general

    def encode_a(self, text: str) -> list[int]:
        """Ranks for texts below U+0250, whose classes no version of Unicode disputes; else the general way."""
        if self._ranked is not None and (text.isascii() or max(text) < "ɐ"):
            try:
                return self._ranked.encode_ordinary(text)
            except ValueError:
                pass  # its splitter gives up on extreme runs
        return self.general().encode(text, add_special_tokens=False).ids

    def words(self, text: str) -> list[str]:
        """The text cut at single spaces, without them, where no token of either kind can reach across; else whole."""
        return BETWEEN.split(text) if self._ranked is not None and self._apart else [text]

    def align(self, raw: list[bytes]) -> list[tuple]:
        """(n_a, n_b, n_groups, groups, a, b, n) per text, or None for texts without tokens."""
        if len(self._known.rows) > KNOWN:
            self._known = _Words()
        known, out, at, size = self._known, [None] * len(raw), [], []
        for i, x in enumerate(raw):
            try:
                words = self.words(x.decode("utf-8")) if x else []
            except UnicodeDecodeError:
                words = []
            at.append(words)
        self._learn({w for words in at for w in words if w not in known.rows})
        fine = [i for i, words in enumerate(at) if words]
        rows = [list(map(known.rows.__getitem__, at[i])) for i in fine]
        if not rows:
            return out
        size = np.array([len(r) for r in rows])
        row = np.concatenate([np.array(r, np.int64) for r in rows])
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        n_a, n_b, n_groups = (c[row] for c in (known.n_a, known.n_b, known.n_groups))
        whole = np.minimum.reduceat(n_a, first) >= 0
        sums = [np.add.reduceat(c, first).tolist() for c in (n_a, n_b, n_groups)]
        # the distinct words of each text with their number, then the pairs of those words
        span = max(1, len(known.rows))
        word, times = np.unique(np.repeat(np.arange(len(rows)), size) * span + row, return_counts=True)
        links = known.n_groups[word % span]
        start = known.start[word % span]
        inner = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        ids = len(self.bytes_a) * len(self.bytes_b)
        key = np.repeat(word // span, links) * ids + known.pairs[np.repeat(start, links) + inner]
        pairs, place = np.unique(key, return_inverse=True)
        number = np.bincount(place, np.repeat(times, links), len(pairs)).astype(np.int64)
        edge = np.searchsorted(pairs, np.arange(len(rows) + 1) * ids)
        pair_a, pair_b = pairs % ids // len(self.bytes_b), pairs % len(self.bytes_b)
        for t, i in enumerate(fine):
            if whole[t]:
                one = slice(edge[t], edge[t + 1])
                out[i] = (sums[0][t], sums[1][t], sums[2][t], ";".join(map(known.groups.__getitem__, rows[t])),
                          pair_a[one], pair_b[one], number[one])
        return out

    def _learn(self, unseen: set[str]) -> None:
        """Encode and align words, all of them as one row of tokens."""
        if not unseen:
            return
        plain = sorted(w for w in unseen if PLAIN.fullmatch(w)) if self._ranked is not None else []
        words = plain + sorted(unseen.difference(plain))
        whole = [(" " + w).encode() for w in words]
        length = np.array([len(x) for x in whole])
        a, n_a = self._rows_a(plain, words[len(plain):], length)
        rows_b = self.pieces.encode(words, num_threads=1)
        b, n_b = _flat(rows_b)
        fine = np.ones(len(words), bool)
        target = b"".join(whole)
        for ids, n, table, size in ((a, n_a, self.bytes_a, self.len_a), (b, n_b, self.bytes_b, self.len_b)):
            if b"".join(map(table.__getitem__, ids.tolist())) != target or (_per_word(size[ids], n) != length).any():
                ends = np.cumsum(n).tolist()
                fine &= [b"".join(map(table.__getitem__, ids[e - k:e].tolist())) == x for e, k, x in zip(ends, n.tolist(), whole)]
        known = self._known
        if not fine.all():
            a, b = a[np.repeat(fine, n_a)], b[np.repeat(fine, n_b)]
            n_a, n_b = n_a[fine], n_b[fine]
            known.add([w for w, f in zip(words, fine) if not f], np.full((~fine).sum(), -1), *[np.zeros((~fine).sum(), int)] * 2,
                      [""] * int((~fine).sum()), np.zeros(0, int))
            words = [w for w, f in zip(words, fine) if f]
        if words:
            known.add(words, n_a, n_b, *self._cut(a, b, n_a, n_b))

    def _rows_a(self, plain: list[str], others: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A of all words, and their number per word. Plain words are encoded as one text, in which they stay apart."""
        rows = [self.encode_a(" " + w) for w in others]
        if not plain:
            return _flat(rows)
        ids = np.array(self._ranked.encode_ordinary(" " + " ".join(plain)), np.int64)
        n = np.diff(np.searchsorted(np.cumsum(self.len_a[ids]), np.cumsum(length[:len(plain)])), prepend=-1)
        a, m = _flat(rows)
        return np.concatenate([ids, a]), np.concatenate([n, m])

    def _cut(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Groups per word, groups spelled, and linked pairs, of words laid end to end: both sides of a word have the
        same bytes, so ends agree at the end of every word."""
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        at = np.searchsorted(end_b, end_a)
        last_a = end_b[at] == end_a
        la = np.flatnonzero(last_a)
        lb = at[la]
        last_b = np.zeros(len(b), np.int64)
        last_b[lb] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        last_b[np.cumsum(n_b) - 1] = 2
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.concatenate([[0], lb + 1])[group_a]] = a + len(self.bytes_a) * last_a
        code[np.arange(len(b)) + (la + 1)[group_b]] = b + 2 * len(self.bytes_a) + len(self.bytes_b) * last_b
        groups = "".join(map(self.spelled.__getitem__, code.tolist())).split("\n")[:-1]
        n_groups = np.diff(np.searchsorted(la, np.cumsum(n_a)), prepend=0)
        return n_groups, groups, a[la] * len(self.bytes_b) + b[lb]


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for row in rows for i in row], np.int64), np.array([len(row) for row in rows], np.int64)


def _per_word(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


class _Words:
    """Aligned words by row; n_a is -1 where a word has no tokens. A task keeps about ``KNOWN`` of them at most, and those
    of one slice."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.n_groups = (np.zeros(0, np.int64) for _ in range(3))
        self.start, self.pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: list[str], n_a, n_b, n_groups, groups: list[str], pairs) -> None:
        self.rows.update(zip(words, range(len(self.groups), len(self.groups) + len(words))))
        self.groups += groups
        self.start = np.concatenate([self.start, len(self.pairs) + np.cumsum(n_groups) - n_groups])
        self.n_a, self.n_b, self.n_groups = (np.concatenate(x) for x in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups)))
        self.pairs = np.concatenate([self.pairs, pairs])


def _short(batch: pa.RecordBatch, size: int):
    """Slices of a batch with about ``size`` bytes of text, one row at least."""
    start, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(batch.column("raw")).to_pylist()):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def align_texts(texts: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """(key, copies, n_a, n_b, n_groups, n_links, groups, links) for distinct texts (key, copies, raw binary);
    ``groups`` spells the groups as ``a1,a2|b1;a3|b2,b3``, ``links`` holds distinct id pairs with their number in
    the text. Texts without tokens get no row. As tokens are never empty, a group has exactly one link: its last
    tokens."""
    def run(batches):
        aligner = None
        for batch in batches:
            aligner = aligner or Aligner(byte_file, piece_file)
            for part in _short(batch, SLICE):
                rows = [(k, c, *x) for k, c, x in zip(part.column("key").to_pylist(), part.column("copies").to_pylist(),
                                                      aligner.align(part.column("raw").to_pylist())) if x]
                if not rows:
                    continue
                key, copies, n_a, n_b, n_groups, groups, a, b, n = zip(*rows)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in n])]).astype(np.int32)
                ints = lambda parts: pa.array(np.concatenate(parts).astype(np.int32))
                links = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([ints(a), ints(b), ints(n)], ["a", "b", "n"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.binary()), pa.array(copies, pa.int64()), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                     pa.array(n_groups, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(groups, pa.string()), links],
                    ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return texts.mapInArrow(run, ALIGNED)


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, copies, raw): one row per text that is neither null nor empty."""
    text = F.col("_t")
    return (docs.select(F.col(f"`{text_col}`").alias("_t")).where(F.length(text.cast("binary")) > 0).groupBy("_t")
            .agg(F.count(F.lit(1)).alias("copies"))
            .select(_digest(text).alias("key"), "copies", text.cast("binary").alias("raw")))


def _digest(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): links of a pair in all documents; best: no other pair of this b has more."""
    counts = (aligned.select("copies", F.inline("links")).groupBy("a", "b")
              .agg(F.sum(F.col("copies") * F.col("n")).alias("count")))
    counts = cut(counts, "crosstok-counts")
    top = counts.groupBy("b").agg(F.max("count").alias("most"))  # at most a row per id of B
    return counts.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _sums(aligned: DataFrame, pairs: DataFrame, heavy: int) -> DataFrame:
    """(key, n_best, count_sum) of every aligned text."""
    total = pairs.agg(F.sum("count")).first()[0] or 0
    floor = max(1, -(-total // heavy))
    links = aligned.select("key", F.inline("links"))
    measures = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"),
                F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    often = F.broadcast(pairs.where(F.col("count") >= floor))
    rare = pairs.where(F.col("count") < floor)
    parts = (links.join(often, ["a", "b"]).groupBy("key").agg(*measures)
             .unionByName(links.join(often.select("a", "b"), ["a", "b"], "left_anti").join(rare.hint("shuffle_merge"), ["a", "b"])
                          .groupBy("key").agg(*measures)))
    return parts.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, aligned: DataFrame, extra: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text",
          heavy: int = HEAVY, hot: int = HOT) -> DataFrame:
    """Measures of every document: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, and the columns
    ``extra`` of ``aligned`` (what :func:`align_texts` gives, written as a table), null where a text has no tokens."""
    pairs = cut(pair_counts(aligned), "crosstok-pairs")
    measured = cut(aligned.select("key", "copies", *MEASURES, *extra).join(_sums(aligned, pairs, heavy), "key"), "crosstok-measures")
    text = F.col(f"`{text_col}`")
    ids = cut(docs.select(F.col(f"`{id_col}`").alias("_id"), F.when(F.length(text.cast("binary")) > 0, _digest(text)).alias("key")),
              "crosstok-ids")
    found = (skew_join(ids.where("key IS NOT NULL"), measured, "key", "copies", ids.count(), hot, "left")
             .unionByName(ids.where("key IS NULL"), allowMissingColumns=True))
    counted = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in [*MEASURES, "n_best", "count_sum"]]
    return found.select(F.col("_id").alias(id_col), *counted, *extra)
