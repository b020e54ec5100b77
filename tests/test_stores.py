"""Vocabulary summaries, retention by day, stored partial results, root sketches."""

import datetime as dt
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostsift.operators import metrics as M
from hostsift.operators import sketches as K
from hostsift.plans import kpis as P
from hostsift.plans import retention as T
from hostsift.plans import vocabulary as V
from hostsift.sources import sinks

# --- vocabulary


def skewed(n, words, seed):
    rng = random.Random(seed)
    return [[f"t{int(rng.paretovariate(0.7)) % words}" for _ in range(rng.randrange(30))] for _ in range(n)] + [[], None, [None, "t1"]]


def first(rows, size):
    counts = Counter(t for r in rows for t in r or [] if t is not None)
    return [t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:size]]


@pytest.mark.parametrize("capacity", [3, 40, 300, 100_000])
@pytest.mark.parametrize("size", [1, 10, 60, 5000])
def test_vocabulary_whatever_the_summaries_hold(spark, capacity, size):
    rows = skewed(600, 2000, 1)
    table = spark.createDataFrame([(r,) for r in rows], "terms array<string>").repartition(4)
    assert V.vocabulary(table, "terms", size, capacity) == first(rows, size)


def test_summaries_bound_the_counts(spark):
    rows = skewed(500, 1000, 2)
    table = spark.createDataFrame([(r,) for r in rows], "terms array<string>").repartition(3)
    parts = V.summaries(table, "terms", 50).collect()
    low, lost = Counter(), sum(r.low for r in parts if r.term is None)
    for r in parts:
        if r.term is not None:
            low[r.term] += r.low
    counts = Counter(t for r in rows for t in r or [] if t is not None)
    assert lost > 0 and all(low[t] <= n <= low[t] + lost for t, n in counts.items())
    assert len(parts) <= 3 * 51
    assert V.lowered({"a": 5, "b": 3, "c": 1}, 2) == ({"a": 4, "b": 2}, 1) and V.lowered({"a": 1}, 1) == ({"a": 1}, 0)


# --- retention

SCAN = "id long, input string, result string, risk_score double, response_time double, ts timestamp"
AS_OF = dt.datetime(2024, 2, 10, 9, 30)


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(i, "u", "SAFE", 0.0, 0.1, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i)) for i in range(140)]
    sinks.append_scan_log(spark.createDataFrame(rows, SCAN), path)
    return path


def files(path):
    return {
        os.path.relpath(os.path.join(d, n), path): os.stat(os.path.join(d, n)).st_mtime_ns
        for d, _, names in os.walk(path) for n in names if n.startswith("part-")
    }


def test_purge_touches_only_the_cut_day(spark, log):
    before, rows = files(log), spark.read.parquet(log)
    want = {r.id for r in T.retention_filter(rows, F.lit(AS_OF)).select("id").collect()}
    deleted = T.retention_counts(rows, F.lit(AS_OF)).first().deleted
    gone, written = T.purge_scan_log(spark, log, AS_OF)
    assert (gone, written) == (deleted, 1) and deleted > 20
    assert {r.id for r in spark.read.parquet(log).collect()} == want
    kept = {n: t for n, t in before.items() if n > "event_date=2024-01-12"}
    after = files(log)
    assert kept.items() <= after.items() and {n.split("/")[0] for n in after.keys() - kept.keys()} == {"event_date=2024-01-11"}
    assert T.purge_scan_log(spark, log, AS_OF) == (0, 0) and files(log) == after
    assert T.purge_scan_log(spark, log, AS_OF, "x") == (0, 0)


def test_a_stopped_purge_is_finished_by_the_next(spark, log, monkeypatch):
    want = {r.id for r in T.retention_filter(spark.read.parquet(log), F.lit(AS_OF)).select("id").collect()}
    finish, calls = T._finish, []

    def stop(found):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("stopped")
        finish(found)

    with monkeypatch.context() as patched:
        patched.setattr(T, "_finish", stop)
        with pytest.raises(OSError):
            T.purge_scan_log(spark, log, AS_OF)
    T.purge_scan_log(spark, log, AS_OF)
    assert sorted(r.id for r in spark.read.parquet(log).collect()) == sorted(want)


def test_rows_appended_during_a_purge_stay(spark, log, monkeypatch):
    late = [(1000, "u", "SAFE", 0.0, 0.1, dt.datetime(2024, 1, 11, 23)), (1001, "u", "SAFE", 0.0, 0.1, dt.datetime(2024, 2, 10))]
    finish, calls = T._finish, []

    def append(found):
        calls.append(1)
        if len(calls) == 2:
            sinks.append_scan_log(spark.createDataFrame(late, SCAN), log)
        finish(found)

    monkeypatch.setattr(T, "_finish", append)
    T.purge_scan_log(spark, log, AS_OF)
    assert {1000, 1001} <= {r.id for r in spark.read.parquet(log).collect()}


# --- partial results


def test_cells_add_up_over_batches(spark, tmp_path):
    rng = random.Random(7)
    rows = [
        (i, rng.choice(["url", "url", "text"]), rng.choice(["PHISHING", "SUSPICIOUS", "SAFE"]), rng.choice([None, 0.25, 0.5]), f"u{rng.randrange(30)}", dt.datetime(2024, 1, 1 + rng.randrange(20)))
        for i in range(900)
    ]
    log = spark.createDataFrame(rows, "id long, type string, result string, response_time double, content string, ts timestamp")
    table = P.kpi_table(spark, str(tmp_path / "cells"))
    for batch in [*range(20), 7, 19]:  # two of them twice
        table.add(P.log_cells(log.filter(F.col("id") % 20 == batch)), "log", batch)
    cells = table.totals()
    assert P.scan_kpis(cells).collect() == M.scan_kpis(log).collect()
    as_of = F.lit(dt.datetime(2024, 1, 18, 5))
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(P.daily_breakdown(cells, as_of)) == order(M.daily_breakdown(log, as_of))
    assert [(r.content, r.cnt, r.missing) for r in P.top_threats(cells, 5).collect()] == [(r.content, r.cnt, 0) for r in M.top_threats(log, 5).collect()]
    assert len(table.current().folders) <= 7 + 2  # merged by eights
    assert P.scan_kpis(P.kpi_table(spark, str(tmp_path / "none")).totals()).first().total_scans == 0


def test_top_threats_say_what_they_miss(spark):
    rng = random.Random(8)
    urls = [f"u{int(rng.paretovariate(0.5)) % 300}" for _ in range(4000)]
    log = spark.createDataFrame([("url", "PHISHING", 0.1, u, dt.datetime(2024, 1, 1)) for u in urls], "type string, result string, response_time double, content string, ts timestamp")
    cells = P.combine(P.log_cells(log.repartition(4), capacity=20))
    counts = Counter(urls)
    top = P.top_threats(cells, 10).collect()
    assert top[0].missing > 0 and all(r.cnt <= counts[r.content] <= r.cnt + r.missing for r in top)


def test_score_cells(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(int(x < 0.4), float(np.round(p, 3) if x < 0.7 else p), f"s{i % 3}") for i, (x, p) in enumerate(rng.random((6000, 2)))]
    rows += [(i % 2, t / 1000, "s0") for i in range(2) for t in range(0, 1001, 5)]
    scored = spark.createDataFrame(rows, "label int, prob double, source string")
    table = P.kpi_table(spark, str(tmp_path / "cells"))
    for batch in range(3):
        table.add(P.score_cells(scored.filter(F.col("source") == f"s{batch}"), F.col("source")), "scores", batch)
    cells = table.totals()
    assert P.operating_point(cells).collect() == M.equal_fp_operating_point(scored).collect()
    assert sorted(P.threshold_sweep(cells).collect()) == sorted(M.threshold_sweep(scored).collect())
    with pytest.raises(ValueError):
        P.threshold_sweep(cells, [0.333])
    values = np.sort([r[1] for r in rows])
    for r in P.percentiles(cells).collect():
        low, high = np.searchsorted(values, r.value), np.searchsorted(values, r.value, side="right")
        assert low / len(values) - P.RANK_ERROR <= r.q <= high / len(values) + P.RANK_ERROR


# --- sketches


def test_sketches_within_their_error(spark):
    rows = spark.range(60_000).select(F.concat(F.lit("r"), "id").alias("root"), (F.col("id") % 4).alias("feed"), F.lit("d1").alias("day"))
    rows = rows.union(rows.limit(9000).withColumn("day", F.lit("d2")))
    size = 12
    sketches = K.root_sketches(rows, ["feed", "day"], size=size)
    bound = 4 * K.relative_error(size)
    whole = K.united(sketches, size=size).select(F.theta_sketch_estimate("sketch").alias("n")).first().n
    assert abs(whole - 60_000) <= bound * 60_000
    known = K.root_sketches(rows.where("feed = 1"), [], size=size)
    others = {"same": K.root_sketches(rows.where("feed = 2"), [], size=size), "none": K.root_sketches(rows.where("feed = 9"), [], size=size)}
    got = K.sketched_report(sketches, known, others).first()
    assert abs(got.novel - 45_000) <= bound * 60_000 and abs(got.same - 15_000) <= bound * 60_000 and got.none == 0
    small = K.root_sketches(rows.where("substr(root, 2) < '11'"), ["feed"], size=size)
    exact = rows.where("substr(root, 2) < '11'").select("root").distinct().count()
    assert exact < 2**size and sum(r.roots for r in K.sketched_roots(small, "feed").collect()) == exact
