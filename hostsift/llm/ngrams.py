"""Language-model scores from a log-frequency Bloom filter.

The filter holds how often each n-gram occurs in the training texts, on a logarithmic scale: an n-gram of level q has the q
events (n-gram, 1) to (n-gram, q) in the filter, and is asked for by one membership probe after the other until one fails.
Frequent n-grams cost a few more bits than rare ones, and no n-gram is stored itself. A count comes out as the mean of its
level's range, too high only where a probe hits by chance.

The filter is dealt into many small ones by the n-gram's hash, each as large as its events ask for, so it grows with the corpus
and is built by all tasks. What is sent to the workers at once is bounded: a larger filter is sent in shards, and the texts
carry the levels found so far from one shard to the next.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsift.llm.common import result_key, utf8
from hostsift.llm.frequent import at_most, joined_sums
from hostsift.session import staged

#: The n-gram's top bits name its part of the filter.
DEAL_BITS = 16
#: Neither is a word: words have no white space.
START, END = b" ", b"\n"
#: Bytes of text handled at once, n-grams counted before they are passed on, and words that a worker remembers.
CHUNK, COUNTED, REMEMBERED = 2 << 20, 4_000_000, 300_000
#: Words whose exact counts every worker holds, and the longest of them.
HELD_WORDS, HELD_CHARS = 200_000, 64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at ASCII white space."""
    return utf8(text).lower().split()


class _Words(dict):
    """Word -> number of its own, given when first asked for."""

    def __init__(self):
        super().__init__()
        self.names: list[bytes] = []
        self.made: dict[str, np.ndarray] = {}

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        return n

    def by_number(self, what: str, make: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
        """``make`` of all words, computed once for each."""
        have = self.made.get(what)
        have = make([]) if have is None else have
        if len(have) < len(self.names):
            have = self.made[what] = np.concatenate((have, make(self.names[len(have) :])))
        return have

    @property
    def hashes(self) -> np.ndarray:
        return self.by_number("hashes", lambda names: np.array([xxhash.xxh64_intdigest(w, 42) for w in names], np.uint64))


@dataclass
class Tokens:
    """Texts one after the other, each with a start before and an end behind it; ``start`` has where they begin and end."""

    words: _Words
    ids: np.ndarray
    start: np.ndarray

    def keys(self, order: int) -> list[np.ndarray]:
        """For each length up to ``order`` the key of the n-gram that ends at each place; without meaning where none does."""
        h = self.words.hashes[self.ids]
        made = [_mix(h)]
        for _ in range(order - 1):
            before = np.concatenate((made[-1][:1], made[-1][:-1]))
            made.append(_mix(before * _ODD[0] + h))
        return made

    @property
    def place(self) -> np.ndarray:
        """From 0 within the text: at place p the longest n-gram has p + 1 words."""
        return np.arange(len(self.ids)) - np.repeat(self.start[:-1], np.diff(self.start))


def _numbered(texts: pa.Array, known: _Words) -> Tokens:
    """Texts as numbers of words: Arrow splits them as ``words`` does, and each distinct word is looked up once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    found = lists.flatten().dictionary_encode()
    names = found.dictionary.cast(pa.large_binary()).to_pylist()
    ids = np.fromiter(map(known.__getitem__, names), np.int32, len(names))[found.indices.to_numpy(zero_copy_only=False)]
    held = ids != known.get(b"", -1)  # white space at either end of a text leaves an empty string there
    offsets = lists.offsets.to_numpy()
    ends = np.concatenate(([0], np.cumsum(held)))[offsets - offsets[0]]
    start = ends + 2 * np.arange(len(ends))
    flat = np.empty(start[-1], np.int32)
    flat[start[:-1]], flat[start[1:] - 1] = known[START], known[END]
    flat[np.arange(ends[-1]) + 2 * np.repeat(np.arange(len(ends) - 1), np.diff(ends)) + 1] = ids[held]
    return Tokens(known, flat, start)


def _tokens(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Slices of the batches and the tokens of their texts."""
    known = _Words()
    for batch in batches:
        at, lengths = 0, pc.utf8_length(batch[column]).fill_null(0).to_pylist()
        while at < batch.num_rows:
            if len(known) > REMEMBERED:
                known = _Words()
            size, first = 0, at
            while at < batch.num_rows and size < CHUNK:
                size += lengths[at]
                at += 1
            yield batch.slice(first, at - first), _numbered(batch[column].slice(first, at - first), known)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _sums(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def _counts(texts: DataFrame, order: int) -> DataFrame:
    """``key``, ``word`` (null for a start and longer n-grams) and ``n`` of n-grams, by the part of the filter they belong to.

    An n-gram can have several rows, one from each task that met it, but all are in one partition.
    """

    def count(batches):
        longer, by_word, held = [], {}, 0

        def passed_on():
            names, times = list(by_word), np.array(list(by_word.values()), np.int64)
            keys = _mix(np.array([xxhash.xxh64_intdigest(w, 42) for w in names], np.uint64))
            spelled = pa.array([None if w == START else w.decode("utf-8", "surrogatepass") for w in names], pa.string())
            yield pa.RecordBatch.from_arrays([_signed(keys), spelled, pa.array(times)], ["key", "word", "n"])
            if longer:
                keys, times = np.unique(np.concatenate(longer), return_counts=True)
                none = pa.nulls(len(keys), pa.string())
                yield pa.RecordBatch.from_arrays([_signed(keys), none, pa.array(times, pa.int64())], ["key", "word", "n"])

        for _, t in _tokens(batches):
            place = t.place
            times = np.bincount(t.ids)
            numbers = np.flatnonzero(times)
            for i, n in zip(numbers.tolist(), times[numbers].tolist()):
                by_word[t.words.names[i]] = by_word.get(t.words.names[i], 0) + n
            for m, keys in enumerate(t.keys(order)[1:], 1):
                longer.append(keys[place >= m])
                held += len(longer[-1])
            if held >= COUNTED:
                yield from passed_on()
                longer, by_word, held = [], {}, 0
        if by_word:
            yield from passed_on()

    # Dealt out by the part of the filter, of which each task then has whole ones; a hash, so no key is hot.
    return texts.mapInArrow(count, "key bigint, word string, n bigint").repartition(F.shiftrightunsigned("key", 64 - DEAL_BITS))


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    """1 for a count of 1; a count that is ``base`` times as large has one level more."""
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def _hashes(keys: np.ndarray, level: int, pair: int) -> np.ndarray:
    """Two probes of an event, one in either half."""
    return _mix(keys + np.uint64((64 * level + pair + 1) * int(_ODD[3]) & 0xFFFFFFFFFFFFFFFF))


def _bit(hashes: np.ndarray, half: int, size: np.ndarray) -> np.ndarray:
    """Place of a probe's bit among ``size`` (below 2**32) bits."""
    number = hashes >> np.uint64(32) if half else hashes & np.uint64(0xFFFFFFFF)
    return (number * size >> np.uint64(32)).astype(np.int64)


def filter_parts(deal: np.ndarray, keys: np.ndarray, counts: np.ndarray, base: float, bits: int, probes: int) -> Iterator[tuple[int, bytes]]:
    """Each deal's part of the filter, of ``bits`` bits per event."""
    order = np.argsort(deal, kind="stable")
    deal, keys, levels = deal[order], keys[order], levels_of(counts[order], base)
    cuts = [0, *(np.flatnonzero(deal[1:] != deal[:-1]) + 1).tolist(), len(deal)] if len(deal) else []
    for a, b in zip(cuts, cuts[1:]):
        size = max(8, -(-int(levels[a:b].sum()) * bits // 8)) * 8
        part = np.zeros(size, bool)
        for level in range(1, int(levels[a:b].max()) + 1):
            there = keys[a:b][levels[a:b] >= level]
            for probe in range(probes):
                hashes = hashes if probe % 2 else _hashes(there, level, probe // 2)
                part[_bit(hashes, probe % 2, np.uint64(size))] = True
        yield int(deal[a]), np.packbits(part, bitorder="little").tobytes()


class FilterShard:
    """The parts of the filter of the deals from ``first`` to ``last``."""

    def __init__(self, first: int, last: int, parts: list[tuple[int, bytes]], probes: int):
        self.first, self.last, self.probes = first, last, probes
        parts = sorted(parts)
        self.size = np.zeros(1 << DEAL_BITS, np.uint64)
        self.start = np.zeros(1 << DEAL_BITS, np.int64)
        at = 0
        for deal, raw in parts:
            self.size[deal], self.start[deal] = 8 * len(raw), 8 * at
            at += len(raw)
        self.bits = np.frombuffer(b"".join([*(raw for _, raw in parts), b"\0"]), np.uint8)

    def has(self, deal: np.ndarray) -> np.ndarray:
        return (deal >= self.first) & (deal <= self.last)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of n-grams of these deals: one probe of each distinct one after the other, until one fails."""
        order = np.argsort(keys)
        keys = keys[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
        keys = keys[first]
        found = np.zeros(len(keys), np.uint8)
        deal = (keys >> np.uint64(64 - DEAL_BITS)).astype(np.int64)
        size, start = self.size[deal], self.start[deal]
        left = np.flatnonzero(size > 0)
        keys, size, start = keys[left], size[left], start[left]
        for level in range(1, 256):
            for probe in range(self.probes):
                hashes = hashes if probe % 2 else _hashes(keys, level, probe // 2)
                at = start + _bit(hashes, probe % 2, size)
                hit = np.flatnonzero(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                if len(hit) < len(left):
                    left, keys, size, start, hashes = left[hit], keys[hit], size[hit], start[hit], hashes[hit]
            if not len(left):
                break
            found[left] = level
        out = np.empty(len(order), np.uint8)
        out[order] = found[np.cumsum(first) - 1]
        return out


@dataclass(frozen=True)
class LanguageModel:
    """``table`` has the parts of the filter (``deal``, ``bits``) and the words' exact counts (``word``, ``n``)."""

    table: DataFrame
    tokens: int
    types: int
    order: int
    base: float
    probes: int
    prior: float

    def means(self) -> np.ndarray:
        """Count that each level stands for."""
        q = np.arange(1, 256, dtype=float)
        with np.errstate(over="ignore"):
            return np.concatenate(([0.0], (self.base ** (q - 1) + np.maximum(self.base ** (q - 1), self.base**q - 1)) / 2))


def fit_language_model(
    texts: DataFrame, text: str = "text", order: int = 2, base: float = 2.0, bits: int = 10, probes: int = 4, prior: float = 64.0
) -> LanguageModel:
    """Counts of all n-grams of up to ``order`` tokens in all of ``texts``, as a filter of ``bits`` bits per event.

    A task holds the n-grams of a shuffle partition at 16 bytes each, besides the distinct words among them.

    A text is its words and one end; a null one is empty. With 10 bits and 4 probes an n-gram that was never counted has a
    level by chance in 1 of 100 cases. ``prior`` is the weight of the shorter n-gram's estimate, in counts. An empty table
    gives a model that knows nothing.
    """
    counted = _counts(texts.select(F.col(f"`{text}`").cast("string").alias("text")), order)

    def built(batches):
        columns, named = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]], []
        for batch in batches:
            for column, name in zip(columns, ("key", "n"), strict=True):
                column.append(batch[name].to_numpy(zero_copy_only=False).astype(np.int64).view(column[0].dtype))
            named.append(batch.filter(batch["word"].is_valid()).select(["word", "n"]))
        if named:
            words = pa.Table.from_batches(named).group_by("word").aggregate([("n", "sum")])
            none = [pa.nulls(len(words), t) for t in (pa.int32(), pa.binary())]
            whole = pa.Table.from_arrays([*none, words["word"], words["n_sum"]], ["deal", "bits", "word", "n"])
            yield from whole.combine_chunks().to_batches()
        keys, times = _sums(*map(np.concatenate, columns))
        made = []
        for part in filter_parts((keys >> np.uint64(64 - DEAL_BITS)).astype(np.int64), keys, times, base, bits, probes):
            made.append(part)
            if len(made) == 1000:
                yield _parts(made)
                made = []
        if made:
            yield _parts(made)

    def _parts(made):
        columns = [pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(made), pa.string()), pa.nulls(len(made), pa.int64())], ["deal", "bits", "word", "n"])

    table = staged(counted.mapInArrow(built, "deal int, bits binary, word string, n bigint"), "filter")
    totals = table.where("word IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return LanguageModel(table, *totals, order, base, probes, prior)


def _shards(model: LanguageModel, most: int) -> list[tuple[int, int]]:
    """Ranges of deals whose parts have ``most`` bytes at most together."""
    sizes = model.table.where("deal IS NOT NULL").select("deal", F.octet_length("bits").alias("size")).toArrow().sort_by("deal")
    ranges, held, first = [], 0, 0
    for deal, size in zip(sizes["deal"].to_pylist(), sizes["size"].to_pylist()):  # at most 2**DEAL_BITS
        if held and held + size > most:
            ranges.append((first, deal - 1))
            first, held = deal, 0
        held += size
    return [*ranges, (first, (1 << DEAL_BITS) - 1)]


def _deals(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - DEAL_BITS)).astype(np.int64)


def _probed(shard: FilterShard, t: Tokens, keys: list[np.ndarray], levels: np.ndarray, alone: bool) -> None:
    """Enter the levels of n-grams of the shard's deals; ``alone``: it is the whole filter."""

    def of_words(names: list[bytes]) -> np.ndarray:
        return shard.levels(_mix(t.words.hashes[len(t.words.names) - len(names) :]))  # they are the last ones

    here = np.full(len(t.ids), True) if alone else shard.has(_deals(keys[0]))
    levels[here, 0] = t.words.by_number("levels", of_words)[t.ids[here]]
    place = t.place
    for m, key in enumerate(keys[1:], 1):
        may = place >= m
        if alone:  # an n-gram isn't there if what it begins or ends with isn't
            may[1:] &= (levels[:-1, m - 1] > 0) & (levels[1:, 0] > 0)
        asked = np.flatnonzero(may if alone else may & shard.has(_deals(key)))
        levels[asked, m] = shard.levels(key[asked])


def _log_probabilities(t: Tokens, levels: np.ndarray, model_size: int, means: np.ndarray, prior: float) -> np.ndarray:
    """Of every token given those before it: counts of an n-gram and of what it begins with, and the shorter n-gram's estimate
    with the weight of ``prior`` counts."""
    place = t.place
    p = (means[levels[:, 0]] + 1) / model_size
    for m in range(1, levels.shape[1]):
        at = np.flatnonzero(place >= m)
        context, count = means[levels[at - 1, m - 1]], means[levels[at, m]]
        count = np.where(context > 0, count, 0)
        p[at] = (count + prior * p[at]) / (np.maximum(context, count) + prior)
    return np.where(place > 0, np.log10(p), 0.0)


def score_texts(
    docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", shard_bytes: int = 256 << 20,
    held_words: int = HELD_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Tokens are the words of a whole text and one end; a null text is empty and has the end alone. ``n_known`` are the tokens that
    the training texts have, ``base_score`` adds up log10((c + 1) / (N + V + 1)) with exact counts, ``score`` the logarithms of
    the filter's smoothed probabilities. Repeated rows get equal results, null keys are kept, an empty table gives no rows, and
    other columns are not read.

    At most ``shard_bytes`` of the filter are sent to the workers at once; a larger one takes a pass over the texts for each.
    Of the exact counts at most ``held_words`` words of at most ``HELD_CHARS`` characters are sent; other words are joined.
    """
    spark = docs.sparkSession
    result_key(key, ["n_tokens", "n_known", "train_tokens", "base_score", "score"])
    order, means, size = model.order, model.means(), model.tokens + model.types + 1
    prior, train = model.prior, model.tokens
    counts = model.table.where("word IS NOT NULL").select("word", F.col("n").alias("c"))
    frequent = at_most(counts.where(F.length("word") <= HELD_CHARS), "c", held_words).toArrow()
    held = spark.sparkContext.broadcast({w.encode(): c for w, c in zip(frequent["word"].to_pylist(), frequent["c"].to_pylist())})
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.lit(None).cast("binary").alias("levels"))
    ranges = _shards(model, shard_bytes)

    def shard_of(first: int, last: int):
        parts = model.table.where(F.col("deal").between(first, last)).select("deal", "bits").toArrow()
        shard = FilterShard(first, last, list(zip(parts["deal"].to_pylist(), parts["bits"].to_pylist())), model.probes)
        return spark.sparkContext.broadcast(shard)

    def found_so_far(batch: pa.RecordBatch, t: Tokens) -> np.ndarray:
        before = b"".join(x.as_py() for x in batch["levels"] if x.is_valid)
        levels = np.frombuffer(before, np.uint8) if before else np.zeros(len(t.ids) * order, np.uint8)
        return levels.reshape(-1, order).copy()

    def passed(shard):
        def fill(batches):
            for batch, t in _tokens(batches):
                levels = found_so_far(batch, t)
                _probed(shard.value, t, t.keys(order), levels, False)
                raw = [levels[a:b].tobytes() for a, b in zip(t.start, t.start[1:])]
                yield pa.RecordBatch.from_arrays([batch["key"], batch["text"], pa.array(raw, pa.binary())], ["key", "text", "levels"])

        return fill

    for first, last in ranges[:-1]:
        shard = shard_of(first, last)
        rows = staged(rows.mapInArrow(passed(shard), rows.schema), "levels")
        shard.destroy()
    last, alone = shard_of(*ranges[-1]), len(ranges) == 1
    names = ["key", "n_tokens", "known", "base", "score", "rest"]

    def judge(batches):
        for batch, t in _tokens(batches):
            levels = found_so_far(batch, t)
            _probed(last.value, t, t.keys(order), levels, alone)
            logs = _log_probabilities(t, levels, size, means, prior)
            doc = np.repeat(np.arange(len(t.start) - 1), np.diff(t.start))
            real = t.place > 0
            n = len(t.start) - 1
            # Exact counts: of frequent words at once, the others' places are kept for the join.
            exact = t.words.by_number("exact", lambda names: np.array([held.value.get(w, -1) for w in names], np.int64))
            values = t.words.by_number("logs", lambda names: np.log10((np.array([held.value.get(w, 0) for w in names], float) + 1) / size))
            there = real & (exact[t.ids] >= 0)
            base = np.bincount(doc[there], values[t.ids[there]], n)
            spot, times = np.unique(doc[real & ~there] * (1 << 32) + t.ids[real & ~there], return_counts=True)
            spelled = [t.words.names[i].decode("utf-8", "surrogatepass") for i in (spot & 0xFFFFFFFF).tolist()]
            rest = pa.StructArray.from_arrays([pa.array(spelled, pa.string()), pa.array(times, pa.int64())], ["word", "times"])
            offsets = pa.array(np.searchsorted(spot >> 32, np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch["key"], pa.array(np.diff(t.start) - 1, pa.int64()), pa.array(np.bincount(doc[there], minlength=n), pa.int64()),
                pa.array(base, pa.float64()), pa.array(np.bincount(doc, logs, n), pa.float64()), pa.ListArray.from_arrays(offsets, rest),
            ], names)

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, known bigint, base double, score double, rest array<struct<word: string, times: bigint>>"
    judged = staged(rows.mapInArrow(judge, schema).withColumn("row_no", F.monotonically_increasing_id()), "judged")
    c = F.coalesce("c", F.lit(0))
    sums = {"more_known": F.when(c > 0, F.col("times")).otherwise(0), "more_base": F.col("times") * F.log10((c + 1) / F.lit(float(size)))}
    whole = joined_sums(judged, "row_no", "rest", counts, "word", sums)
    return whole.select(
        F.col("key").alias(key), "n_tokens", (F.col("known") + F.col("more_known")).alias("n_known"),
        F.lit(train).cast("bigint").alias("train_tokens"), (F.col("base") + F.col("more_base")).alias("base_score"), "score",
    )
