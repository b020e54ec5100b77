"""Alignment of the tokens of two tokenizers by pointer jumping.

Both cut the same bytes. Every token points to the token that reaches farthest right of all it overlaps; where a token of
either tokenizer ends at the same byte, the first tokenizer's one points to itself. Following the pointers leads every token to
the terminal token of its group, the smallest stretch at whose ends both tokenizers cut. All pointers of many texts are one
array, and replacing it by its own successor again and again takes as many rounds as the longest chain has binary digits.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hostsift.llm.common import byte_of_sign, result_key
from hostsift.llm.frequent import at_most, joined_sums
from hostsift.session import staged

#: Bytes of texts whose tokens are aligned at once.
CHUNK = 1 << 20
#: A group of more links is counted by its distinct ids.
WIDE = 4096
#: Pairs whose counts every worker holds, 17 bytes each.
HELD_PAIRS = 1_000_000
#: The faster encoder can't take runs of white space that are much longer.
_LONG_SPACE = re.compile(r"\s{500}")


class TokenizerPair:
    """A byte-level BPE, which reads a space before the text, and a BPE of pieces, which puts one there itself."""

    def __init__(self, byte_bpe: str, pieces: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        self.whole = Tokenizer.from_file(byte_bpe)
        self.whole.encode_special_tokens = True
        with open(byte_bpe, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        added = {i: t.content for i, t in self.whole.get_added_tokens_decoder().items()}
        sign = byte_of_sign()
        self.a = [b""] * self.whole.get_vocab_size()
        for token, i in vocabulary.items():
            self.a[i] = added[i].encode() if i in added else bytes(map(sign.__getitem__, token))
        for i, content in added.items():
            self.a[i] = content.encode()
        # The same vocabulary and splitting in a faster library: ids of a byte-level BPE are its merges in order.
        self.fast = tiktoken.Encoding(
            "pair", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(self.a) if i not in added}, special_tokens={}
        )
        probe = " It's <|endoftext|> 12  34\n\n tab\t日本 é_x...  "
        if self.fast.encode_ordinary(probe) != self.whole.encode(probe, add_special_tokens=False).ids:
            raise ValueError("the pattern doesn't split texts as the byte-level tokenizer does")
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.b = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.model.id_to_piece(i)) for i in range(self.model.vocab_size()))
        ]
        self.sizes = [np.array(list(map(len, table)), np.int64) for table in (self.a, self.b)]
        # What stands for an id in a text's groups: A's with "," or "|" behind, then B's with ",", ";" or nothing.
        self.words = [b"%d%s" % (i, end) for i in range(len(self.a)) for end in (b",", b"|")]
        self.words += [b"%d%s" % (i, end) for i in range(len(self.b)) for end in (b",", b";", b"")]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for every text; none where the tokens' bytes aren't the text's."""
        ours = [
            self.whole.encode(f" {t}", add_special_tokens=False).ids if _LONG_SPACE.search(t) else self.fast.encode_ordinary(f" {t}")
            for t in texts
        ]
        found = []
        for text, x, y in zip(texts, ours, self.model.encode(texts, num_threads=1)):
            raw = b" " + text.encode()
            same = text and b"".join(map(self.a.__getitem__, x)) == raw == b"".join(map(self.b.__getitem__, y))
            found.append((x, y) if same else ([], []))
        return found


@lru_cache(maxsize=2)
def tokenizer_pair(byte_bpe: str, pieces: str, pattern: str) -> TokenizerPair:
    """Read once in each worker."""
    return TokenizerPair(byte_bpe, pieces, pattern)


def terminal_tokens(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the number of the A token that ends its group; ends ascend, and the last ones are equal."""
    a_starts, b_starts = (np.concatenate(([0], ends[:-1])) if len(ends) else ends for ends in (a_ends, b_ends))
    n = len(a_ends)
    right_of_a = np.searchsorted(b_starts, a_ends) - 1  # the last token that begins before the end reaches farthest
    right_of_b = np.searchsorted(a_starts, b_ends) - 1
    successor = np.concatenate((np.where(b_ends[right_of_a] > a_ends, n + right_of_a, np.arange(n)), right_of_b))
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor[:n], successor[n:]
        successor = further


def _sums(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def linked_pairs(a: np.ndarray, b: np.ndarray, doc: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, width: int):
    """Distinct (document, ``a * width + b``) of all links and how often each occurs, in order; ids stand group by group.

    ``n_a`` and ``n_b`` are the groups' tokens, ``doc`` their documents. A wide group is counted by its distinct ids, so that
    memory grows with the different pairs of a document and not with the square of a group.
    """
    from_a, from_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    wide = n_a * n_b > WIDE
    each = np.where(np.repeat(wide, n_a), 0, np.repeat(n_b, n_a))  # links of each A token
    group = np.repeat(np.arange(len(n_a)), n_a)
    x = np.repeat(np.arange(len(a)), each)
    y = from_b[group[x]] + np.arange(len(x)) - np.repeat(np.cumsum(each) - each, each)
    space = width * (int(a.max(initial=0)) + 1)
    keys, times = [doc[group[x]] * space + a[x] * width + b[y]], [np.ones(len(x), np.int64)]
    for g in np.flatnonzero(wide):
        p, times_p = np.unique(a[from_a[g] : from_a[g] + n_a[g]], return_counts=True)
        q, times_q = np.unique(b[from_b[g] : from_b[g] + n_b[g]], return_counts=True)
        keys.append((doc[g] * space + p[:, None] * width + q).ravel())
        times.append((times_p[:, None] * times_q).ravel())
    keys, times = _sums(np.concatenate(keys), np.concatenate(times))
    return keys // space, keys % space, times


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_FACTS = [*_NUMBERS, "groups_sha256", "pairs", "times"]


def _aligned(texts: list[str], pair: TokenizerPair) -> list[pa.Array]:
    found = pair.encode(texts)
    sizes = [np.array([len(x[side]) for x in found], np.int64) for side in (0, 1)]
    a, b = (np.fromiter((i for x in found for i in x[side]), np.int64, sizes[side].sum()) for side in (0, 1))
    docs = [np.repeat(np.arange(len(found)), n) for n in sizes]
    # All texts stand on one line of bytes; both tokenizers end at every text's end, so no group goes over it.
    group_a, group_b = terminal_tokens(np.cumsum(pair.sizes[0][a]), np.cumsum(pair.sizes[1][b]))
    ends_group = group_a == np.arange(len(a))
    number = np.cumsum(ends_group) - ends_group  # of the group that a terminal token ends
    group_a, group_b = number[group_a], number[group_b]
    doc = docs[0][ends_group]
    n_a, n_b = np.bincount(group_a, minlength=len(doc)), np.bincount(group_b, minlength=len(doc))
    n_groups = np.bincount(doc, minlength=len(found))
    n_links = np.bincount(doc, n_a * n_b, len(found)).astype(np.int64) if len(doc) else n_groups
    # Ids in the order of the groups, A's before B's, each with the sign that comes behind it.
    spelled = np.zeros(len(a) + len(b), np.int64)
    spelled[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = 2 * a + ends_group
    ends_b = np.concatenate((group_b[1:] != group_b[:-1], [True])) if len(b) else np.zeros(0, bool)
    ends_doc = np.concatenate((docs[1][1:] != docs[1][:-1], [True])) if len(b) else ends_b
    spelled[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = 2 * len(pair.a) + 3 * b + ends_b + ends_doc
    cuts = [0, *np.cumsum(sizes[0] + sizes[1]).tolist()]
    word = pair.words.__getitem__
    digests = [
        hashlib.sha256(b"".join(map(word, spelled[p:q].tolist()))).hexdigest() if p < q else "" for p, q in zip(cuts, cuts[1:])
    ]
    of, pairs, times = linked_pairs(a, b, doc, n_a, n_b, len(pair.b))
    offsets = pa.array(np.searchsorted(of, np.arange(len(found) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (pairs, times)]
    numbers = [pa.array(x, pa.int64()) for x in (*sizes, n_groups, n_links)]
    return [*numbers, pa.array(digests, pa.string()), *lists]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches and their texts, of ``CHUNK`` characters or one text more."""
    for batch in batches:
        first, at = 0, 0
        while at < batch.num_rows:
            texts, size = [], 0
            while at < batch.num_rows and size < CHUNK:
                texts.append(batch["text"][at].as_py() or "")
                size += len(texts[-1])
                at += 1
            yield batch.slice(first, at - first), texts
            first = at


def aligned(docs: DataFrame, byte_bpe: str, pieces: str, pattern: str) -> DataFrame:
    """Of every ``text``, beside its ``key``: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, and the distinct
    ``pairs`` and the ``times`` of each."""

    def align(batches):
        pair = tokenizer_pair(byte_bpe, pieces, pattern)
        for batch, texts in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch["key"], *_aligned(texts, pair)], ["key", *_FACTS])

    numbers = ", ".join(f"{c} bigint" for c in _NUMBERS)
    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(align, f"key {kind}, {numbers}, groups_sha256 string, pairs array<bigint>, times array<bigint>")


def pair_counts(facts: DataFrame, width: int, pairs: str = "pairs") -> DataFrame:
    """``pair``, ``n``, the documents that hold it linked, and ``best``, whether no pair of its A id has more."""
    counts = staged(facts.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    # There are at most as many rows of an A id as B has ids, so a window by it is bounded; the counts are joined all the same.
    a = F.floor(F.col("pair") / width).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokenizers(
    docs: DataFrame, byte_bpe: str, pieces: str, pattern: str, key: str = "doc_id", text: str = "text", held_pairs: int = HELD_PAIRS
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``,
    ``groups_sha256``.

    Tokens of either tokenizer that end at the same byte end a group, and all A-B pairs of a group's tokens are links. The count
    of a pair of ids is the number of documents (rows) that hold it linked; ``n_best`` are the links whose count no other B id
    of their A id exceeds, ``count_sum`` is the sum over all links. A text that is null or empty, or whose tokens' bytes aren't a
    space and the text, has no tokens: zeros, and '' for the digest. Repeated rows are documents each, null keys are kept, an
    empty table gives none, and other columns are not read.

    ``byte_bpe`` and ``pieces`` are files that every executor has, ``pattern`` splits texts for the first. The counts of at most
    ``held_pairs`` pairs, the most frequent, are sent to the workers; the others are joined.
    """
    spark = docs.sparkSession
    result_key(key, [*_FACTS[:5], "n_best", "count_sum"])
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    facts = aligned(texts, byte_bpe, pieces, pattern).withColumn("row_no", F.monotonically_increasing_id())
    facts = staged(facts, "aligned")
    table = staged(pair_counts(facts, tokenizer_pair(byte_bpe, pieces, pattern).model.vocab_size()), "pairs")
    held = at_most(table, "n", held_pairs).toArrow().sort_by("pair")  # at most `held_pairs` rows
    shared = spark.sparkContext.broadcast([
        held["pair"].to_numpy(), held["n"].to_numpy(), held["best"].to_numpy().astype(bool)
    ])

    @F.arrow_udf("struct<count_sum: bigint, n_best: bigint, rest: array<struct<pair: bigint, times: bigint>>>")
    def look_up(pairs: pa.Array, times: pa.Array) -> pa.Array:
        known, counts, best = shared.value
        asked, each = (x.flatten().to_numpy() for x in (pairs, times))
        ends = np.concatenate(([0], np.cumsum(pairs.value_lengths().to_numpy()))) if len(pairs) else np.zeros(1, np.int64)
        of = np.repeat(np.arange(len(pairs)), np.diff(ends))
        at = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
        there = known[at] == asked if len(known) else np.zeros(len(asked), bool)
        sums = [np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)]
        np.add.at(sums[0], of[there], each[there] * counts[at[there]])
        np.add.at(sums[1], of[there], each[there] * best[at[there]])
        left = pa.StructArray.from_arrays([pa.array(x[~there], pa.int64()) for x in (asked, each)], ["pair", "times"])
        offsets = np.searchsorted(of[~there], np.arange(len(pairs) + 1))
        rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), left)
        return pa.StructArray.from_arrays([*[pa.array(x, pa.int64()) for x in sums], rest], ["count_sum", "n_best", "rest"])

    summed = facts.withColumn("found", look_up("pairs", "times")).select("key", "row_no", *_NUMBERS, "groups_sha256", "found.*")
    sums = {"more_sum": F.col("times") * F.col("n"), "more_best": F.col("times") * F.col("best").cast("bigint")}
    whole = joined_sums(staged(summed, "looked-up"), "row_no", "rest", table, "pair", sums)
    return whole.select(
        F.col("key").alias(key), *_NUMBERS, (F.col("n_best") + F.col("more_best")).alias("n_best"),
        (F.col("count_sum") + F.col("more_sum")).alias("count_sum"), "groups_sha256",
    )
