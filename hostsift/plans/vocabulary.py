"""The most frequent terms of an array column, without shuffling every distinct term.

Each task keeps a bounded summary: when it holds too many terms, all counts are lowered by the same amount and what falls to
zero is forgotten, and it says by how much it has lowered them. The sums of the summaries are lower bounds, and no term occurs
more often than its lower bound and all that was taken off. So the bounds name the only terms that can be among the first, and
these alone are counted exactly. Where the bounds can't tell the first from the rest, everything is counted.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsift.session import staged

#: Terms in a task's summary.
CAPACITY = 50_000


def lowered(counts: dict[str, int], capacity: int) -> tuple[dict[str, int], int]:
    """At most ``capacity`` of the counts, all lowered by the same amount, and that amount."""
    if len(counts) <= capacity:
        return counts, 0
    by = sorted(counts.values(), reverse=True)[capacity]
    return {term: n - by for term, n in counts.items() if n > by}, by


def summaries(rows: DataFrame, source: str, capacity: int = CAPACITY) -> DataFrame:
    """``term`` and ``low`` of every task's summary; the row without a term has what the task took off at most."""

    def count(batches):
        held, lost = {}, 0
        for batch in batches:
            found = pc.value_counts(pc.drop_null(batch.column(0).flatten()))
            for term, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                held[term] = held.get(term, 0) + n
            if len(held) > 2 * capacity:
                held, by = lowered(held, capacity)
                lost += by
        held, by = lowered(held, capacity)
        names = pa.array([*held, None], pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array([*held.values(), lost + by], pa.int64())], ["term", "low"])

    return rows.select(source).mapInArrow(count, "term string, low bigint")


def _first(counts: DataFrame, size: int) -> list[str]:
    return [r["term"] for r in counts.orderBy(F.desc("n"), "term").limit(size).collect()]


def _counted(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(rows: DataFrame, source: str, size: int, capacity: int = CAPACITY) -> list[str]:
    """The ``size`` most frequent terms, the first of equally frequent ones in byte order; null terms count for nothing."""
    if size <= 0:
        return []
    parts = staged(summaries(rows, source, capacity), "term-summaries")
    low = parts.dropna(subset=["term"]).groupBy("term").agg(F.sum("low").alias("n"))
    lost = parts.where("term IS NULL").agg(F.coalesce(F.sum("low"), F.lit(0))).first()[0]
    if not lost:
        return _first(low, size)  # no summary was full: these are the counts
    terms = rows.select(F.explode(source).alias("term")).dropna()
    best = [r["n"] for r in low.orderBy(F.desc("n")).limit(size).collect()]
    least = best[-1] if len(best) == size else 0
    if least <= lost:
        return _first(_counted(terms), size)  # a term that no summary has could be among the first
    may = low.where(F.col("n") + lost >= least).select("term")
    return _first(_counted(terms.join(may, "term", "left_semi")), size)
