"""Quality rules: what share of a text's characters stands in repeated n-grams and lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostsift.llm.common import utf8, with_fields

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class QualityRules:
    """Limits on shares of a text's word characters.

    ``dup_ngram``: in the second and later copies of an n-gram, by n. ``top_ngram``: in copies of the most frequent n-gram,
    by n. ``dup_line``: in lines equal to an earlier one. ``symbols``: symbol characters per word.
    """

    min_words: int = 50
    base_repeat_percent: int = 50
    dup_line: float = 0.30
    dup_ngram: tuple[tuple[int, float], ...] = ((5, 0.30), (6, 0.29), (7, 0.28), (8, 0.27), (9, 0.26), (10, 0.25))
    top_ngram: tuple[tuple[int, float], ...] = ((2, 0.35), (3, 0.30), (4, 0.25))
    symbols: float = 0.10


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_share",
          "dup_ngram_shares", "top_ngram_shares"]
_ARROW = pa.struct(
    [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
     ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_line_share", pa.float64()),
     ("dup_ngram_shares", pa.list_(pa.float64())), ("top_ngram_shares", pa.list_(pa.float64()))]
)
_TYPE = (
    "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, "
    "base_failed: boolean, kept: boolean, dup_line_share: double, dup_ngram_shares: array<double>, "
    "top_ngram_shares: array<double>>"
)


def _chars(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    b = np.frombuffer(data, np.uint8)
    return int(np.count_nonzero((b & 0xC0) != 0x80))


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Word numbers spread over 64 bits."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(mixed: np.ndarray, lengths: list[int]):
    """For each n-gram length, ascending: the length and the hash of every window, each rolled on from the one before."""
    h, done = mixed.copy(), 1
    for n in lengths:
        while done < n and len(h) > 1:
            h = h[:-1] * _BASE + mixed[done:]
            done += 1
        yield n, h if done == n else h[:0]


def covered(marks: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the marked windows of ``n`` words."""
    step = np.zeros(size + 1, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(text: str | None, rules: QualityRules) -> tuple:
    data = utf8(text)
    words = data.split()
    size = len(words)
    n_symbols = int(np.count_nonzero(_SYMBOL[np.frombuffer(data, np.uint8)]))
    seen: set[bytes] = set()
    n_dup_lines = dup_line_chars = 0
    for line in data.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += _chars(b"".join(line.split()))
        elif line and not line.isspace():
            seen.add(line)
    ids, _ = pd.factorize(np.array(words, dtype=object))
    sizes = np.fromiter(map(len, words), np.int64, size)
    joined = np.frombuffer(b"".join(words), np.uint8)
    if size and len(joined):
        heads = (joined & 0xC0) != 0x80
        sizes = np.add.reduceat(heads, np.cumsum(sizes) - sizes, dtype=np.int64)
    word_chars = int(sizes.sum())
    upto = np.concatenate(([0], np.cumsum(sizes)))
    dup_limits, top_limits = dict(rules.dup_ngram), dict(rules.top_ngram)
    n_repeat_words, dup_shares, top_shares, fine = 0, [], [], True
    for n, h in rolled(_mixed(ids), sorted({3, *dup_limits, *top_limits})):
        if not len(h):
            dup_shares += [0.0] * (n in dup_limits)
            top_shares += [0.0] * (n in top_limits)
            continue
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        counts = np.diff(np.append(starts, len(h)))
        if n == 3:
            twice = np.zeros(len(h), bool)
            twice[order] = np.repeat(counts > 1, counts)
            n_repeat_words = int(covered(twice, n, size).sum())
        if n in dup_limits:
            later = np.ones(len(h), bool)
            later[order[starts]] = False  # the order is stable: a group's first entry is its first place
            share = float(sizes[covered(later, n, size)].sum()) / word_chars
            dup_shares.append(share)
            fine &= share <= dup_limits[n]
        if n in top_limits:
            first = order[starts]
            weights = np.where(counts > 1, counts * (upto[first + n] - upto[first]), 0)
            share = min(1.0, float(weights.max()) / word_chars)
            top_shares.append(share)
            fine &= share <= top_limits[n]
    line_share = dup_line_chars / word_chars if word_chars else 0.0
    fine = bool(fine and line_share <= rules.dup_line and n_symbols <= rules.symbols * size)
    failed = size < rules.min_words or 100 * n_repeat_words > rules.base_repeat_percent * size
    return (
        size, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, fine and not failed, line_share, dup_shares,
        top_shares,
    )


def quality(text: Column, rules: QualityRules) -> Column:
    @F.arrow_udf(_TYPE)
    def judge(texts: pa.Array) -> pa.Array:
        columns = list(zip(*(measure(x.as_py(), rules) for x in texts))) or [()] * len(FIELDS)
        return pa.StructArray.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], fields=list(_ARROW)
        )

    return judge(text)


def quality_rules(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """Measures of repetition of every whole text, and a verdict ``kept``.

    Words are what ASCII white space separates. Adds ``n_words``; ``word_chars``; ``n_symbols``; ``n_dup_lines``;
    ``n_repeat_words`` (words in three-word windows that occur twice or more); ``base_failed`` (under ``min_words`` words,
    or more than ``base_repeat_percent`` of them repeated); ``dup_line_share``, ``dup_ngram_shares`` and
    ``top_ngram_shares``, in the order of the rules; and ``kept``, false if the base rules or a limit fails.

    A null text has no words and fails, as an empty one does. An n-gram that occurs once has no part in a share; of equally
    frequent n-grams the one of most characters counts. Rows are handled one by one: repeated rows get equal results, an
    empty table stays empty, other columns stay, and a column named as a result is replaced.
    """
    return with_fields(docs, quality(F.col(f"`{text}`").cast("string"), rules), FIELDS)
