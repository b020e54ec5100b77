"""Selection, joins and splits against brute force, with hot keys."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostsift.operators import augment as A
from hostsift.operators import joins as J
from hostsift.operators import metrics as M
from hostsift.operators import sampling as Z
from hostsift.operators import sets as S
from hostsift.operators.ranking import clamp_limit
from hostsift.operators.selection import exact_quantiles, hash_top_n
from hostsift.plans import retention as T


def h(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def hot_rows():
    rng = random.Random(3)
    rows = [("hot.example", "a")] * 700 + [(f"k{rng.randrange(400)}.example", rng.choice("ab")) for _ in range(1400)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [0, 1, 50, 699, 701, 1000, 5000])
def test_hash_top_n_with_a_hot_key(spark, n):
    rows = hot_rows()
    want = []
    for g in "ab":
        ordered = sorted((r for r in rows if r[1] == g), key=lambda r: (h(r[0] + "s"), r[0]))
        want += ordered[:n]
    df = spark.createDataFrame(rows, "k string, g string")
    for table in (df.coalesce(1), df.repartition(7)):
        got = [tuple(r) for r in hash_top_n(table, "k", n, ["g"], "s").collect()]
        assert sorted(got) == sorted(want)


def test_balance_uses_the_smaller_class(spark):
    rows = [(f"p{i}", "phishing") for i in range(30)] + [(f"l{i}", "legitimate") for i in range(90)] + [("x", "other")]
    df = spark.createDataFrame(rows, "url string, type string")
    assert {r.type: r.rows for r in M.class_distribution(Z.balance_classes(df)).collect()} == {"phishing": 30, "legitimate": 30}
    assert Z.balance_classes(df, cap=7).count() == 14
    assert Z.balance_classes(df.filter("type <> 'phishing'")).count() == 0


@pytest.mark.parametrize("spread", ["uniform", "one value", "outside"])
def test_exact_quantiles(spark, spread):
    rng = np.random.default_rng(1)
    values = {"uniform": rng.random(997), "one value": np.r_[np.full(500, 0.25), rng.random(301)],
              "outside": rng.normal(0, 40, 501)}[spread]
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("e", 0.5), ("g", None)], "g string, v double")
    qs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {r.q: r.value for r in exact_quantiles(df, "v", qs, ["g"]).filter("g = 'g'").collect()}
    assert [got[q] for q in qs] == pytest.approx(list(np.quantile(values, qs)))


def test_asof_join_with_a_hot_domain(spark):
    rng = random.Random(9)
    scans = [(i, "hot" if i % 3 == 0 else f"d{i % 7}", 1_700_000_000 + rng.randrange(20000)) for i in range(900)]
    meta = [("hot" if i % 2 else f"d{i % 7}", i, 1_700_000_000 + rng.randrange(20000)) for i in range(400)]
    want = {}
    for i, d, t in scans:
        best = max(((c, a) for m, a, c in meta if m == d and t - 900 <= c <= t), default=None)
        want[i] = -1 if best is None else best[1]
    sdf = spark.createDataFrame(scans, "id int, domain string, s long").withColumn("ts", F.timestamp_seconds("s"))
    mdf = spark.createDataFrame(meta, "domain string, age_days int, s long").select(
        "domain", "age_days", F.lit(True).alias("ssl_valid"), F.timestamp_seconds("s").alias("checked_at")
    )
    got = {r.id: (r.age_days, r.ssl_valid) for r in J.domain_meta_enrich(sdf, mdf).collect()}
    assert len(got) == len(scans)
    assert {i: a for i, (a, _) in got.items()} == want
    assert all(ssl == (age != -1) for age, ssl in got.values())


def test_grid_rates_match_plain_counting(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), p) for p in [i / 1000 for i in range(290, 960)] + [rng.random() for _ in range(500)] + [0.0, 1.0]]
    df = spark.createDataFrame(rows, "label int, prob double")
    got = {r.threshold_milli: (r.fp_pct, r.recall_pct) for r in M.grid_rates(df).collect()}
    assert len(got) == 131
    for t in range(300, 951, 5):
        for label, value in zip((0, 1), got[t]):
            side = [p for y, p in rows if y == label]
            assert value == pytest.approx(100 * sum(p > t / 1000 for p in side) / len(side))


def test_keep_first_keeps_the_phishing_label(spark):
    rows = [("u", "legitimate", 2, 1)] * 50 + [("u", "phishing", 1, 9), ("v", "legitimate", 2, 3)]
    df = spark.createDataFrame(rows, "url string, type string, prio int, line_no int")
    assert sorted(tuple(r) for r in S.dedup_keep_first(df, ["prio", "line_no"]).select("url", "type").collect()) == [
        ("u", "phishing"), ("v", "legitimate")]


def test_split_never_leaks_and_has_its_shares(spark):
    df = Z.grouped_split(spark.range(20000).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("root")))
    assert Z.split_leakage(df).count() == 0
    share = {r.split: r["count"] / 20000 for r in df.groupBy("split").count().collect()}
    assert share == pytest.approx({"train": 0.64, "calibrate": 0.16, "test": 0.20}, abs=0.02)


def test_holdout_is_at_most_a_fifth(spark):
    roots = spark.range(101).select(F.concat(F.lit("r"), F.col("id").cast("string"), F.lit(".com")).alias("root"))
    parts = {r.part: r["count"] for r in Z.holdout_split(roots).groupBy("part").count().collect()}
    assert parts == {"holdout": 20, "train": 81}
    assert Z.holdout_split(roots, cap=5).filter("part = 'holdout'").count() == 5


def test_augmentation_is_half_pathed(spark):
    from hostsift.functions.urls import has_path

    rows = [(f"https://site{i}.com/a", "phishing" if i % 2 else "legitimate") for i in range(3000)] + [("http://localhost", "phishing")]
    out = A.augment_bare_pathed(spark.createDataFrame(rows, "url string, type string"))
    stats = {r.label: r.p for r in out.groupBy("label").agg(F.avg(has_path(F.col("url")).cast("int")).alias("p")).collect()}
    assert all(abs(p - 0.5) < 0.02 for p in stats.values())
    assert out.filter(F.col("url").contains("localhost")).count() == 0


def test_expand_variants_are_distinct(spark):
    df = spark.createDataFrame([("https://www.a.com/x",), ("https://b.com",)], "url string")
    rows = [r.url for r in A.expand_variants(df, 9).collect()]
    assert len(rows) == len(set(rows)) == 20 and "https://www.a.com" in rows


def test_synthetic_urls(spark):
    out = A.synthesize_adversarial(spark.range(4000))
    hosts = out.select(F.regexp_extract("url", "^http://([^/]*)", 1).alias("h"))
    assert out.count() > 3800 and hosts.filter("h = '' OR NOT contains(h, '.')").count() == 0
    salad = hosts.filter(F.col("h").rlike("^([a-z]+-){2,}"))
    assert salad.count() > 500


def test_retention_and_limits(spark):
    assert [clamp_limit(v) for v in (-5, 10_000, 20, "x", None)] == [1, 200, 20, 20, 20]
    assert [T.retention_days(v) for v in (0, 7, "x", None)] == [1, 7, 30, 30]
    rows = spark.createDataFrame([(40,), (31,), (29,), (5,)], "age int")
    log = rows.select(F.expr("timestamp'2024-03-01' - make_dt_interval(age)").alias("ts"))
    as_of = F.lit("2024-03-01").cast("timestamp")
    assert tuple(T.retention_counts(log, as_of).first()) == (2, 2)
    assert T.retention_filter(log, as_of, 35).count() == 3


def test_empty_log_has_no_division_by_zero(spark):
    empty = spark.createDataFrame([], "id long, type string, content string, result string, risk_score double, response_time double, ts timestamp")
    row = M.scan_kpis(empty).first()
    assert (row.total_scans, row.detection_rate, row.avg_response_time_ms) == (0, 0.0, 0.0)


def test_metadata_of_exactly_the_ttl_is_stale(spark):
    scans = spark.createDataFrame([(1, "a.com", 10_000), (2, "a.com", 10_899), (3, "a.com", 10_900)], "id int, domain string, s long")
    scans = scans.withColumn("ts", F.timestamp_seconds("s"))
    meta = spark.createDataFrame([("a.com", 7)], "domain string, age_days int").withColumns(
        {"ssl_valid": F.lit(True), "checked_at": F.timestamp_seconds(F.lit(10_000))}
    )
    got = {r.id: (r.age_days, r.ssl_valid) for r in J.domain_meta_enrich(scans, meta).collect()}
    assert got == {1: (7, True), 2: (7, True), 3: (-1, False)}


def test_allowlist_as_a_table(spark):
    df = spark.createDataFrame([("a.com",), ("b.com",), (None,)], "root string")
    allowed = spark.createDataFrame([("b.com", 1), ("b.com", 2), (None, 3)], "r string, n int")
    got = {r.root: r.trusted for r in J.allowlist_match(df, allowed=allowed).collect()}
    assert got == {"a.com": False, "b.com": True, None: False}


def test_balance_keeps_copies_and_cuts_by_hash(spark):
    from hostsift.functions.hashing import hash32

    rows = [(f"u{i % 40}", "phishing") for i in range(90)] + [("hot", "legitimate")] * 60 + [(f"l{i}", "legitimate") for i in range(120)]
    df = spark.createDataFrame(rows, "url string, type string").repartition(5)
    order = {r.url: r.h for r in df.select("url", hash32(F.col("url"), "bal").alias("h")).distinct().collect()}
    for cap in (1000, 90, 50, 3, 0):
        n = min(cap, 90)
        want = []
        for c in ("phishing", "legitimate"):
            want += sorted(((u, t) for u, t in rows if t == c), key=lambda r: (order[r[0]], r[0]))[:n]
        assert sorted((r.url, r.type) for r in Z.balance_classes(df, cap=cap).collect()) == sorted(want)


def test_crowded_slots_are_salted(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    scans = [(i, "hot.com" if i % 3 else f"d{i % 5}.com", base + dt.timedelta(seconds=i * 7 % 1800)) for i in range(600)]
    meta = [(d, base + dt.timedelta(seconds=s), s, True) for d in ("hot.com", "d0.com", "d3.com") for s in range(0, 1800, 250)]
    sdf = spark.createDataFrame(scans, "id long, domain string, ts timestamp")
    mdf = spark.createDataFrame(meta, "domain string, checked_at timestamp, age_days int, ssl_valid boolean")
    plain = {r.id: (r.age_days, r.ssl_valid) for r in J.domain_meta_enrich(sdf, mdf).collect()}
    salted = {r.id: (r.age_days, r.ssl_valid) for r in J.domain_meta_enrich(sdf, mdf, heavy=10).collect()}
    assert plain == salted and len(plain) == 600 and sum(v[1] for v in plain.values()) > 300
