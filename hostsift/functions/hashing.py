"""Portable hashing: the only source of "randomness" in this library.

``hash32`` depends on the row alone, so every sample, split and generated path
is the same whatever the partitioning, and a retried task repeats its rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostsift.functions.literals import literal_array

HASH_SPACE = 1 << 32


def hash32(key: Column, salt: str = "") -> Column:
    """First eight hex digits of ``md5(key || salt)`` as a BIGINT in [0, 2^32)."""
    text = F.concat(key.cast("string"), F.lit(salt)) if salt else key.cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def pick(values: tuple[str, ...], key: Column, salt: str) -> Column:
    """One entry of a fixed list, chosen by the hash of ``key || salt``."""
    return F.element_at(literal_array(values), (hash32(key, salt) % len(values) + 1).cast("int"))
