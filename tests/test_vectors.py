"""Entries of vectors without their zeros."""

import math

import pytest
from pyspark.ml.linalg import Vectors

from registry.q_models import entries, vector_summary

WIDE = 2_000_000_000


def test_entries_are_not_filled_in(spark):
    rows = [
        (1, Vectors.sparse(WIDE, [(4, 3.0), (7, 0.0), (WIDE - 1, -4.0)])), (2, Vectors.dense([0.0, 2.0, 0.0, 1.5])),
        (3, Vectors.sparse(5, [])), (4, None),
    ]
    df = spark.createDataFrame(rows, ["url_id", "block"])
    got = df.select(entries("block").alias("all"), entries("block", 3).alias("first"), entries("block", 5).alias("more")).collect()
    assert [tuple(r) for r in got[:3]] == [([3.0, -4.0], [], [3.0]), ([2.0, 1.5], [2.0], [2.0, 1.5]), ([], [], [])]
    assert got[3][0] is None
    summed = {r.url_id: (r.terms, r.total, r.norm) for r in vector_summary(df, "block").collect()}
    assert summed[1] == (2, -1.0, 5.0) and summed[3] == (0, 0.0, 0.0)
    assert summed[2] == (2, 3.5, pytest.approx(math.sqrt(6.25)))
