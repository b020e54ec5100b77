"""Language identification by bit-sliced Bloom filters of character n-grams.

One table holds the Bloom filters of all languages: row ``r`` is a bitmask whose bit ``l`` is bit ``r`` of language ``l``'s filter.
An n-gram picks a few rows, and their bitwise AND is the set of all languages whose filter has it, in one look-up for all. Over
a text, the bits are counted by language, the hits expected of a filter's false positives are taken off, and the language with
the largest share of the n-grams wins.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostsift.llm.common import with_fields
from hostsift.session import staged

UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")
#: Code points of a text handled at once; blocks overlap by an n-gram's length.
BLOCK = 1 << 20
#: Bits of a text's hash that name its bucket in the histogram that the sample is cut by.
BUCKET_BITS = 12
_ODD = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93]


def _hashes(text: str, n: int):
    """Hashes of the n-grams of a text in lower case, words apart by one space, one array per block."""
    clean = f" {_OTHER.sub(' ', text.lower()).strip()} "
    for start in range(0, max(1, len(clean) - n + 1), BLOCK):
        codes = np.frombuffer(clean[start : start + BLOCK + n - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = len(codes) - n + 1
        if size <= 0:
            continue
        h = np.zeros(size, np.uint64)
        for j in range(n):
            h = (h + codes[j : j + size]) * np.uint64(_ODD[0])
            h ^= h >> np.uint64(29)
        h *= np.uint64(_ODD[1])
        yield h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class LanguageFilters:
    """The table and what it was built from; languages in order of their number of documents, then name."""

    languages: tuple[str, ...]
    table: np.ndarray  # rows x words of 64 languages
    n: int
    hashes: int

    @cached_property
    def false_positives(self) -> np.ndarray:
        """Chance, by language, that the filter has an n-gram that was never put in."""
        bits = np.unpackbits(self.table.view(np.uint8), axis=1, bitorder="little")[:, : len(self.languages)]
        return bits.mean(0) ** self.hashes

    def rows(self, h: np.ndarray, i: int) -> np.ndarray:
        """The row that hash number ``i`` picks."""
        shift = np.uint64(64 - (len(self.table).bit_length() - 1))
        return (h * np.uint64(_ODD[i % 4] + 2 * (i // 4)) >> shift).astype(np.int64)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """Languages that have each n-gram."""
        found = self.table[self.rows(h, 0)]
        for i in range(1, self.hashes):
            found = found & self.table[self.rows(h, i)]
        return found

    def shares(self, text: str) -> np.ndarray:
        """Share of a text's n-grams that each language has, without the hits that false positives give."""
        counts, total = np.zeros(len(self.languages)), 0
        for h in _hashes(text, self.n):
            total += len(h)
            for word, column in enumerate(self.masks(h).T):
                here = counts[64 * word : 64 * word + 64]
                if len(here) <= 8:  # the bits of few languages are counted by whole masks
                    tally = np.bincount(column.astype(np.int64), minlength=1 << len(here))
                    for l in range(len(here)):
                        here[l] += tally.reshape(-1, 2, 1 << l)[:, 1].sum()
                else:
                    for l in range(len(here)):
                        here[l] += np.count_nonzero(column & np.uint64(1 << l))
        if not total:
            return counts
        p = self.false_positives
        return np.maximum(0, (counts / total - p) / np.maximum(1 - p, 1e-9))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its part of all languages' shares, and its share of the n-grams."""
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0
        shares = self.shares(text)
        best, total = int(shares.argmax()), float(shares.sum())  # of equal shares the more frequent language
        return self.languages[best], float(shares[best]) / total if total else 0.0, float(shares[best])


def _smallest(hashes_of: DataFrame, counts: list, most: int) -> DataFrame:
    """``lang`` and ``h`` of each language's ``most`` smallest hashes, as the histogram ``counts`` of their buckets tells.

    Whole buckets are filtered; only the hashes of the bucket that the cut falls in are put in order.
    """
    cuts: dict[str, tuple[int, int]] = {}
    for lang in sorted({r["lang"] for r in counts}):
        taken, cuts[lang] = 0, (1 << BUCKET_BITS, 0)
        for at, texts in sorted((r["bucket"], r["texts"]) for r in counts if r["lang"] == lang):
            if taken + texts > most:
                cuts[lang] = at, most - taken
                break
            taken += texts
    if not cuts:
        return hashes_of.select("lang", "h")
    cut, left = (F.create_map(*[F.lit(x) for lang, c in cuts.items() for x in (lang, c[i])])[F.col("lang")] for i in (0, 1))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    edge = hashes_of.where(F.col("bucket") == cut).withColumn("rank", order).where(F.col("rank") <= left)
    return hashes_of.where(F.col("bucket") < cut).select("lang", "h").union(edge.select("lang", "h"))


def fit_filters(
    labelled: DataFrame, lang: str = "lang", text: str = "text", per_language: int = 1000, grams: int = 4000, n: int = 3,
    rows: int = 1 << 16, hashes: int = 3, least_rate: float = 0.5,
) -> LanguageFilters:
    """Filters of n-grams from at most ``per_language`` whole texts of each language.

    A language's filter holds those of its ``grams`` most frequent n-grams that are at least ``least_rate`` times as frequent
    in it as in the language where they are most frequent; so an n-gram can be in several filters. The texts of the smallest
    hashes are taken, so the sample doesn't depend on how rows are dealt out; a histogram says how small, so no language is
    ordered in one task. What is gathered on the driver is ``grams`` hashes per language. Rows without a language or text are left out; without any there are no
    languages, and every text is undetermined.
    """
    if rows & (rows - 1):
        raise ValueError("the number of rows is a power of two")
    known = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    known = known.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    # Only hashes are chosen from; copies share one, and come in once. The texts themselves are read for what is chosen.
    hashes_of = staged(known.groupBy("lang", "h").agg(F.count("*").alias("copies")), "text-hashes")
    bucket = F.shiftrightunsigned("h", 64 - BUCKET_BITS)
    counts = hashes_of.groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("texts"), F.sum("copies").alias("copies")).collect()
    chosen = _smallest(hashes_of.withColumn("bucket", bucket), counts, per_language)
    sample = known.join(chosen, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])

    def count(batches):
        for batch in batches:
            sums: dict[str, list[np.ndarray]] = {}
            for name, raw in zip(batch.column("lang").to_pylist(), batch.column("text")):
                sums.setdefault(name, []).extend(_hashes(raw.as_py(), n))
            for name, parts in sums.items():
                values, times = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(times, pa.int64())],
                    ["lang", "gram", "times"],
                )

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram bigint, times bigint")
    total = counted.groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    rate = F.col("times") / F.sum("times").over(Window.partitionBy("lang"))
    frequent = Window.partitionBy("lang").orderBy(F.desc("rate"), "gram")
    top = total.withColumn("rate", rate).withColumn("rank", F.row_number().over(frequent)).where(F.col("rank") <= grams)
    by_lang: dict[str, list[int]] = {}
    largest: dict[int, float] = {}
    collected = top.select("lang", "gram", "rate").collect()
    for r in collected:
        largest[r["gram"]] = max(r["rate"], largest.get(r["gram"], 0.0))
    for r in collected:
        if r["rate"] >= least_rate * largest[r["gram"]]:
            by_lang.setdefault(r["lang"], []).append(r["gram"])
    sizes = Counter()
    for r in counts:
        sizes[r["lang"]] += r["copies"]
    languages = tuple(sorted(by_lang, key=lambda x: (-sizes[x], x)))
    made = LanguageFilters(languages, np.zeros((rows, max(1, -(-len(languages) // 64))), np.uint64), n, hashes)
    for l, name in enumerate(languages):
        h = np.array(by_lang[name], np.int64).view(np.uint64)
        for i in range(hashes):
            np.bitwise_or.at(made.table[:, l // 64], made.rows(h, i), np.uint64(1 << (l % 64)))
    return made


FIELDS = ["lang_pred", "score", "known_share"]


def language(text: Column, filters: LanguageFilters) -> Column:
    @F.arrow_udf("struct<lang_pred: string, score: double, known_share: double>")
    def identify(texts: pa.Array) -> pa.Array:
        found = list(zip(*(filters.predict(x.as_py()) for x in texts))) or [()] * 3
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(found, (pa.string(), pa.float64(), pa.float64()))], FIELDS)

    return identify(text)


def identify_languages(docs: DataFrame, filters: LanguageFilters, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` and ``known_share`` of every whole text.

    ``score`` is the winner's part of all languages' shares, ``known_share`` the share of the text's n-grams that it has. A
    null text, or one without a letter, is ``und`` with zeros; so is every text if no language was learned. Of equal shares
    the more frequent language wins. Rows are handled one by one: repeated rows get equal results, an empty table stays
    empty; other columns stay, and a column named as a result is replaced.
    """
    return with_fields(docs, language(F.col(f"`{text}`").cast("string"), filters), FIELDS)


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: checksum of its id, modulo 3, is 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 3 == 1
