"""Rounding of non-negative scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_score(value: Column, digits: int) -> Column:
    """Round the scaled binary value.

    ``F.round`` works on the shortest decimal text of a double, so 0.345 * 3
    (stored just below 1.035) would become 1.04 instead of 1.03.
    """
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale
