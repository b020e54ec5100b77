"""Distinct registrable roots over any set of feeds and days from stored sketches, without reading the URLs again.

A theta sketch keeps the smallest hashes of a set. Sketches of one size can be united, intersected and taken from one another, and
the number of distinct elements of the outcome is estimated. Sets below the sketch's size are counted exactly; above, the
standard error is ``relative_error`` of the union of all sets that took part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of the hashes that a sketch keeps: 16,384 of them, 128 KB.
SIZE = 14


def relative_error(size: int = SIZE) -> float:
    """Standard error of an estimate, as a share of what all sets together hold."""
    return 2 ** (-size / 2)


def root_sketches(rows: DataFrame, by: Sequence[str], root: str = "root", size: int = SIZE) -> DataFrame:
    """A row for each group: its distinct roots as ``sketch``. Null roots count for nothing."""
    return rows.groupBy(*by).agg(F.theta_sketch_agg(root, size).alias("sketch"))


def united(sketches: DataFrame, *by: str, size: int = SIZE) -> DataFrame:
    """One sketch of all roots, or of each group."""
    return sketches.groupBy(*by).agg(F.theta_union_agg("sketch", size).alias("sketch"))


def sketched_roots(sketches: DataFrame, *by: str) -> DataFrame:
    """Estimated distinct roots of each group of feeds and days."""
    return united(sketches, *by).select(*by, F.theta_sketch_estimate("sketch").alias("roots"))


def sketched_report(novel_from: DataFrame, known: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """One row: ``novel``, the roots of ``novel_from`` that ``known`` hasn't, and how many of these each of ``others`` has.

    All are tables of sketches; an empty one is an empty set.
    """
    feed = united(novel_from).select(F.col("sketch").alias("feed"))
    sides = feed.crossJoin(united(known).select(F.col("sketch").alias("known")))  # one row each
    for name, table in others.items():
        sides = sides.crossJoin(united(table).select(F.col("sketch").alias(name)))
    novel = F.theta_difference("feed", "known")
    counted = [F.theta_sketch_estimate(novel).alias("novel")]
    counted += [F.theta_sketch_estimate(F.theta_intersection(novel, F.col(name))).alias(name) for name in others]
    return sides.select(*counted)
