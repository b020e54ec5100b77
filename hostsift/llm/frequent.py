"""Looking up a table by key from rows that hold many keys each, where few keys make up most of what is looked up.

The most frequent keys, a bounded number of them, go to every worker; what a row holds beside these is joined with the table.
So no key is hot in the join, the broadcast doesn't grow with the input, and nothing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the histogram in which a count doubles.
STEPS = 16


def _step(n: str) -> Column:
    return F.floor(F.log2(F.col(n).cast("double")) * STEPS).cast("int")


def at_most(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of the largest ``n`` (1 or more), as many whole steps of a histogram of ``n`` as have ``most`` rows at most.

    Only the histogram's few hundred numbers come to the driver.
    """
    steps = sorted(((r["step"], r["rows"]) for r in counts.groupBy(_step(n).alias("step")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, taken = None, 0
    for step, rows in steps:
        taken += rows
        if taken > most:
            break
        least = step
    return counts.where(F.lit(False) if least is None else _step(n) >= least)


def joined_sums(rows: DataFrame, row: str, rest: str, table: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """``rows`` without ``rest``, an array of structs of ``key`` and other fields, plus the sums over it, zero for an empty one.

    Expressions in ``sums`` see the structs' fields and the columns of ``table``, null where it hasn't the key; ``row`` is unique.
    """
    looked_up = rows.select(row, F.explode(rest).alias("r")).select(row, "r.*").join(table, key, "left")
    found = looked_up.groupBy(row).agg(*[F.sum(x).alias(name) for name, x in sums.items()])
    return rows.drop(rest).join(found, row, "left").fillna(0, list(sums))
