"""Brand tables: signatures lose no similar pair, and no pair is tried that shares none."""

import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from hostsift.operators import brand_tables as B


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
        row = now
    return row[-1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(row[j] + (x != y), row[j + 1] + 1, now[j] + 1))
        row = now
    return row[-1]


def near_names(n, seed):
    """Names of 1 to 62 letters and copies of them with a few letters changed."""
    rng, names = random.Random(seed), []
    for _ in range(n):
        base = "".join(rng.choices("abcdeio", k=rng.choice([1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15, 20, 30, 45, 62])))
        names.append(base)
        x = list(base)
        for _ in range(rng.randint(1, max(1, len(base) // 4))):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.randint(0, 1)] = rng.choice([[], ["x"], [rng.choice("abcdeio")]])
        names.append("".join(x)[:62])
    return names


def test_most_edits(spark):
    rows = [(a, b) for a in range(0, 40) for b in range(0, 40)]
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", B.most_edits(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        allowed = [d for d in range(abs(r.a - r.b), r.a + r.b + 1, 2) if (r.a + r.b - d) * 100 > 85 * (r.a + r.b)]
        assert r.d == max(allowed, default=-1)


def test_matches_all_pairs(spark):
    pieces, brands = near_names(220, 1), near_names(220, 1)[::2] + near_names(60, 2)
    hosts = spark.createDataFrame([(f"{p}.com", "") for p in pieces], "f_host string, host_skeleton string")
    table = spark.createDataFrame([(b,) for b in [*brands, None, "", brands[0]]], "brand string")
    want = {}
    for p in {x for x in pieces if len(x) >= 4}:
        for b in set(brands) - {""}:
            common = lcs(p, b)
            if common * 200 > 85 * (len(p) + len(b)):
                want[p, b] = 2 * common / (len(p) + len(b))
    got = {(r.piece, r.brand): r.similarity for r in B.brand_table_join(hosts, table).collect()}
    assert got == pytest.approx(want) and len(want) > 300
    assert any(len(p) > 40 and p != b for p, b in want)


def test_a_large_table_meets_few(spark):
    rng = random.Random(3)
    letters = "etaoinshrdlucmfwypvbgk"
    brands = ["".join(rng.choices(letters, k=rng.randint(5, 13))) for _ in range(20_000)]
    pieces = [b[:-1] + "z" for b in brands[::100]] + ["".join(rng.choices(letters, k=rng.randint(5, 13))) for _ in range(300)]
    frames = spark.createDataFrame([(p,) for p in pieces], "piece string"), spark.createDataFrame([(b,) for b in brands], "brand string")
    found = B.candidates(frames[0].distinct(), frames[1].distinct())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() < 20 * len(pieces)  # of 20,000 each
    met = B.piece_signatures(frames[0].distinct()).join(B.brand_signatures(frames[1].distinct()), "signature").count()
    assert met < 400 * len(pieces)


def test_long_brands_are_refused(spark):
    hosts = spark.createDataFrame([("abcd.com", "")], "f_host string, host_skeleton string")
    with pytest.raises(SparkRuntimeException, match="more than 62"):
        B.brand_table_join(hosts, spark.createDataFrame([("a" * 63,)], "brand string")).collect()


def test_typos_match_all_pairs(spark):
    names, brands = near_names(150, 5), near_names(150, 5)[::2]
    df = spark.createDataFrame([(i, f"{n}.com" if n else None) for i, n in enumerate([*names, "", names[0]])], "id long, host string")
    table = spark.createDataFrame([(b, i % 40) for i, b in enumerate([*brands, None])], "brand string, ordinal long")
    rank = {}
    for i, b in enumerate(brands):
        rank[b] = min(rank.get(b, 99), i % 40)
    got = {r.id: r.typo_brand for r in B.typo_table_join(df, table).collect()}
    for i, n in enumerate([*names, "", names[0]]):
        hits = [(rank[b], b) for b in rank if n and edits(n, b) == 1]
        assert got[i] == (min(hits)[1] if hits else None)


def test_no_table_of_keys_is_broadcast(spark, tmp_path):
    """Stored tables look small before their strings are taken apart."""
    names = near_names(150, 7)
    spark.createDataFrame([(f"{n}.com", n, i) for i, n in enumerate(names)], "host string, brand string, ordinal long").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    near = B.candidates(table.select(F.col("brand").alias("piece")).distinct(), table.select("brand").distinct())
    for found in (near, B.typo_table_join(table.select("host"), table)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        meet = [line for line in plan.splitlines() if "Join [" in line and ("key#" in line or "signature#" in line)]
        assert len(meet) == 1 and "SortMergeJoin" in meet[0], plan


def test_a_common_word_does_not_make_strings_meet(spark):
    rng = random.Random(9)
    numbers = rng.sample(range(1_000_000, 10_000_000), 3_000)
    brands = spark.createDataFrame([(f"hotbolt{n}",) for n in numbers], "brand string")
    pieces = spark.createDataFrame([(f"bolt{n}",) for n in numbers[:300] + rng.sample(range(1_000_000, 10_000_000), 200)], "piece string")
    met = B.piece_signatures(pieces).join(B.brand_signatures(brands), "signature").count()
    assert 300 <= met < 20 * 500  # of 3,000 each that have the word in its place
    found = {(r.piece, r.brand) for r in B.candidates(pieces.distinct(), brands.distinct()).collect()}
    assert {(f"bolt{n}", f"hotbolt{n}") for n in numbers[:300]} <= found
