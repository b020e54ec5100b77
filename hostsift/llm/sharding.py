"""A reproducible shuffle: a Feistel permutation of global row numbers decides shard and slot.

A row's place follows from its number, the number of rows, the number of shards and the seed; nothing is sorted by a random
key, and the row at a given shard and slot is found by running the permutation backwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostsift.llm.common import result_key
from hostsift.session import staged

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed % 2**63], np.uint64), 2 * r + 1)[0]) for r in range(ROUNDS)]


def _half_bits(size: int) -> int:
    """Half the width of the smallest balanced network that holds ``size`` numbers."""
    return max(1, (max(size - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << shift) | right


def permuted(numbers: np.ndarray, size: int, seed: int, back: bool = False) -> np.ndarray:
    """A permutation of ``0 .. size - 1``: values that leave the range walk on along their cycle until they return."""
    half, keys = _half_bits(size), _keys(seed)
    x = _network(numbers.astype(np.uint64), half, keys, back)
    outside = x >= np.uint64(size)
    while outside.any():
        x[outside] = _network(x[outside], half, keys, back)
        outside = x >= np.uint64(size)
    return x.astype(np.int64)


def feistel(number: Column, size: Column, seed: int, back: bool = False) -> Column:
    """``permuted`` on columns; ``size`` is the same in every row."""

    @F.arrow_udf("bigint")
    def permute(numbers: pa.Array, sizes: pa.Array) -> pa.Array:
        if not len(numbers):
            return pa.array([], pa.int64())
        return pa.array(permuted(numbers.to_numpy(zero_copy_only=False), sizes[0].as_py(), seed, back))

    return permute(number, size)


def numbered(df: DataFrame, order: list[str], name: str = "row_no", total: str = "n_rows") -> DataFrame:
    """``df`` plus global row numbers from 0 in the given order, and the number of rows.

    Rows are dealt by range, numbered within their partition, and shifted by the counts of the partitions before; these are
    the only figures gathered, one per partition. The rows are written first, so that both steps see the same partitions.
    """
    local = Window.partitionBy("part").orderBy(*order)
    parts = staged(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "parts")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    shifts = counts.select(
        "part",
        (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("shift"),
        F.sum("n").over(Window.partitionBy()).alias(total),
    )
    rows = parts.withColumn("place", F.row_number().over(local) - 1)
    return rows.join(shifts, "part").withColumn(name, F.col("place") + F.col("shift")).drop("part", "place", "shift")


def shard_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, seed: int = 7
) -> DataFrame:
    """Shard and slot of every row: ``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, ``row_no``.

    Rows are numbered by key, size, checksum and hash of the text, nulls first. A row's permuted number modulo ``shards`` is its shard,
    the quotient its slot; so shards differ by at most one row and slots have no gap. Rows equal in key and text take
    neighbouring numbers and can't be told apart. ``size`` is the text's bytes and one; a null text counts as empty, and
    its checksum as that of an empty one. No rows give no rows. The law is ``rows``, so ``grown_shard`` is null: one more
    shard moves rows between all shards.
    """
    results = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_no"]
    result_key(key, results)
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("tie"), F.monotonically_increasing_id().alias("copy"),
    )
    # "copy" deals many equal rows over several ranges; which of them gets which number makes no difference.
    placed = numbered(rows, ["key", "size", "text_crc32", "tie", "copy"]).withColumn("at", feistel(F.col("row_no"), F.col("n_rows"), seed))
    return placed.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), (F.col("at") % shards).cast("int").alias("shard"),
        F.floor(F.col("at") / shards).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )
