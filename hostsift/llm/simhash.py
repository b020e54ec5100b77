"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``2 r`` bits have a value within ``r`` bits of both. So each distinct fingerprint emits every value
within half the radius, equal values meet in a shuffle, and whatever meets is verified and linked. Around one value there are
only as many fingerprints as the half ball has values, so no group grows with the input, however many copies there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostsift.llm.common import fresh, result_key, utf8
from hostsift.llm.components import components
from hostsift.session import staged

BITS, SEED = 64, 42
#: Shingles hashed at once, so that a very long text takes little memory.
BLOCK = 1 << 16


def _shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, block by block; none without a word."""
    parts = utf8(text).lower().split()  # of bytes: A-Z only, ASCII white space only
    shingles = max(1, len(parts) - words + 1) if parts else 0
    for start in range(0, shingles, BLOCK):
        yield np.fromiter(
            (
                xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), SEED)
                for i in range(start, min(start + BLOCK, shingles))
            ),
            np.uint64,
        )


def _majority(blocks: Iterable[np.ndarray]) -> int:
    ones, shingles = np.zeros(BITS, np.int64), 0
    for hashes in blocks:
        shingles += len(hashes)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * ones > shingles, bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: str | None, words: int) -> int:
    """Bits that are set in more than half of the shingles' hashes; zero without a word."""
    return _majority(_shingle_hashes(text, words))


def simhash(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("bigint")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x.as_py(), words) for x in texts], pa.int64())

    return fingerprints(text)


def _digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def ball(radius: int) -> list[int]:
    """Masks of at most ``radius`` bits."""
    return [_signed(sum(1 << b for b in bits)) for n in range(radius + 1) for bits in combinations(range(BITS), n)]


def near_links(prints: DataFrame, column: str, radius: int) -> DataFrame:
    """Links ``u``, ``v`` between distinct fingerprints, enough to join all that lie within ``radius`` (even) bits.

    Fingerprints that meet at a value lie within the radius of each other, all of them, so linking each to the next smaller
    one loses no component; the bits that differ are counted again all the same.
    """
    if radius % 2:
        raise ValueError("the radius is twice that of the ball and so even")
    masks = F.array(*map(F.lit, ball(radius // 2)))
    met = prints.select(F.col(column).alias("v"), F.explode(masks).alias("mask")).select(
        "v", F.col("v").bitwiseXOR(F.col("mask")).alias("value")
    )
    before = F.lag("v").over(Window.partitionBy("value").orderBy("v"))
    return (
        met.select(before.alias("u"), "v")
        .where(F.col("u").isNotNull() & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))
        .distinct()
    )


def _rooted(prints: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (``print``) and the component of each, ``root``."""
    groups = components(near_links(prints, "print", radius)).withColumnsRenamed({"node": "print", "component": "root"})
    return prints.join(groups, "print", "left").withColumn("root", F.coalesce("root", "print"))


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is the smallest key of all that can be
    reached over links. Texts of fewer than ``words`` words are one shingle; a text without a word, as a null one, has
    fingerprint zero and is linked as any other. Null keys take part, but are never a component's id unless all its keys
    are null. Repeated rows give repeated rows, and an empty table none. Other columns are not read.
    """
    result_key(key, ["fingerprint", "component_id"])
    rows = docs.select(F.col(f"`{key}`").alias("key"), simhash(F.col(f"`{text}`").cast("string"), words).alias("print"))
    rows = staged(rows, "prints")  # texts are read once
    rooted = _rooted(staged(rows.groupBy("print").agg(F.min("key").alias("least")), "distinct-prints"), radius)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(ids, "root").select("print", "component_id")
    return rows.join(by_print, "print").select(
        F.col("key").alias(key), _digits(F.col("print")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One document of every group of :func:`simhash_groups`, that of the smallest key; of rows with that key, one.

    A row with a null key stays only where its group has no other. All columns are kept; an empty table stays empty.
    """
    look, row = fresh(docs, "print"), fresh(docs, "row_no")
    marked = docs.withColumn(look, simhash(F.col(f"`{text}`").cast("string"), words))
    marked = staged(marked.withColumn(row, F.monotonically_increasing_id()), "marked")  # texts are read once, rows keep their number
    least = F.struct(F.col(f"`{key}`").isNull().alias("no_key"), F.col(f"`{key}`").alias("key"), F.col(row).alias("row"))
    prints = marked.select(F.col(look).alias("print"), least.alias("least")).groupBy("print").agg(F.min("least").alias("least"))
    kept = _rooted(staged(prints, "distinct-prints"), radius).groupBy("root").agg(F.min("least").alias("least"))
    rows = kept.select(F.col("least.row").alias(row))
    return marked.join(rows, row, "left_semi").select(*[f"`{c}`" for c in docs.columns])
