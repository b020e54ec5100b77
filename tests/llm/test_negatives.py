"""Hard negatives against plain scores, and the tables of subset sums against products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostsift.llm.negatives import (
    bit_planes, from_planes, hard_negatives, labelled_vectors, planes_for, scores, subset_sums, sum_kind,
)


def by_definition(rows, is_anchor, k=5):
    """rows: id, label, whole components."""
    one = {}
    for i, label, v in sorted(rows, key=lambda r: (r[0], r[1], v_key(r[2]))):
        one.setdefault(i, (label, v))
    out = []
    for a, (label, v) in one.items():
        if not is_anchor(a):
            continue
        found = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in one.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in found if x[2] == label][:k]:
            hard = [(n, t) for t, n, other in found if other != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, r, n, -s, -t) for r, (n, t) in enumerate(hard, 1)]
    return sorted(out)


def v_key(v):
    return len(v), v


@pytest.mark.parametrize("dims", [0, 1, 7, 8, 9, 64])
@pytest.mark.parametrize("most", [1, 255, 10**6, 10**14])
def test_look_ups_equal_products(dims, most):
    rng = np.random.default_rng(dims + most % 97)
    anchors, vectors = rng.integers(-most, most + 1, (6, dims)), rng.integers(-most, most + 1, (50, dims))
    planes = planes_for(-most, most)
    codes = bit_planes(vectors, planes)
    assert codes.shape == (50, planes, -(-dims // 8)) and (from_planes(codes, dims) == vectors).all()
    if most == 10**14 and dims:
        with pytest.raises(OverflowError):
            sum_kind(anchors, planes)
        return
    kind = sum_kind(anchors, planes)
    got = scores(subset_sums(anchors, kind), codes)
    assert (got == anchors @ vectors.T).all() and got.dtype == kind


def test_planes():
    assert [planes_for(*x) for x in ((0, 0), (0, 1), (-1, 0), (-2, 1), (-128, 127), (-129, 0), (0, 128))] == [1, 2, 1, 2, 8, 9, 9]


def test_hard_negatives_with_ties_and_odd_rows(spark):
    rng = random.Random(12)
    rows = [(i, rng.randrange(3), [rng.choice([-0.5, 0.0, 0.001, 0.25, 0.5, 1.0]) for _ in range(rng.choice([3, 3, 3, 9]))]) for i in range(260)]
    rows += [(900, 1, [0.5, 0.5, 0.5])] * 3 + [(50, 2, [1.0, 1.0, 1.0]), (60, 0, [0.0] * 3), (70, 9, [1.0] * 3), (950, 0, [])]
    odd = [(None, 1, [1.0] * 3), (1000, None, [1.0] * 3), (1010, 1, None), (1020, 1, [1.0, None, 0.0]), (1030, 1, [float("nan")] * 3), (1040, 1, [float("-inf")] * 3)]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>")
    df = df.withColumns({"id": F.lit("x"), "block": F.lit("y"), "dims": F.lit(1), "rank": F.lit(2)})
    vectors = labelled_vectors(df, "vec_id", "embedding", "label")
    got = hard_negatives(vectors, F.col("id") % 10 == 0)
    assert dict(got.dtypes)["rank"] == "int"
    # Scores may be higher than what the window's ends are multiplied to; integers all the way.
    whole = [(i, str(label), [int(np.floor(256 * x)) for x in v]) for i, label, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == by_definition(whole, lambda i: i % 10 == 0)
    assert hard_negatives(vectors.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives(vectors, F.lit(False)).count() == 0


def test_several_blocks_and_groups_of_anchors(spark, monkeypatch):
    from hostsift.llm import negatives

    monkeypatch.setattr(negatives, "BLOCK", 60)
    monkeypatch.setattr(negatives, "ANCHORS", 20)
    monkeypatch.setattr(negatives, "TILE", 7)
    rng = random.Random(13)
    # A third of all rows are one vector under one label.
    rows = [(i, "hot" if i % 3 == 0 else rng.choice("ab"), [5, 5, 5] if i % 3 == 0 else [rng.randint(-9, 9) for _ in range(3)]) for i in range(400)]
    got = hard_negatives(spark.createDataFrame(rows, "id long, label string, v array<bigint>"), F.col("id") % 4 == 0)
    assert sorted(tuple(r) for r in got.collect()) == by_definition(rows, lambda i: i % 4 == 0)
