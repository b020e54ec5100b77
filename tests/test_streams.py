"""Stateful streams against plain versions of what they compute, for rows in any order."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostsift.streaming.asof import newest_before, with_metadata_as_of
from hostsift.streaming.dedup import kept_places, stream_dedup_exact

BASE = dt.datetime(2024, 1, 1)
LOOKUP = "domain string, checked_at timestamp, age_days int, ssl_valid boolean"


def at(seconds):
    return BASE + dt.timedelta(microseconds=round(seconds * 1_000_000))


def batches(table, folder, parts):
    """Rows dealt at random over files that are read one by one."""
    for part in range(parts):
        table.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)


def drain(stream, out, checkpoint):
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_newest_before():
    lookups = np.array([10, 20, 20, 30])
    assert newest_before(lookups, np.array([9, 10, 19, 20, 29, 30, 39, 40, 10**9]), 10).tolist() == [-1, 0, 0, 2, 2, 3, 3, -1, -1]
    assert newest_before(lookups[:0], np.array([5]), 10).tolist() == [-1]


def test_metadata_as_of_out_of_order(spark, tmp_path):
    rng = random.Random(21)
    domains = ["hot.com"] * 6 + [f"d{i}.com" for i in range(8)]
    scans = [(i, f"http://www.{rng.choice(domains)}/p{i}", at(rng.random() * 4000), rng.random(), rng.randrange(5)) for i in range(600)]
    scans += [(None, None, at(50), None, 1), (601, "http://unknown.com", at(60), 0.5, 2), (602, "http://d0.com", None, 0.5, 2)]
    lookups = [(rng.choice(domains), at(rng.random() * 4000), rng.choice([None, -1, 5, 400]), rng.choice([None, True, False]), rng.randrange(5)) for i in range(250)]
    lookups += [("d0.com", scans[0][2], 7, True, 4), ("edge.com", at(100), 3, True, 0)]
    scans += [(700, "edge.com", at(100), 0.1, 4), (701, "edge.com", at(399.999999), 0.1, 3), (702, "edge.com", at(400), 0.1, 3)]
    folders = [str(tmp_path / n) for n in ("scans", "lookups")]
    schema = "id long, url string, ts timestamp, prob double"
    batches(spark.createDataFrame(scans, f"{schema}, part int"), folders[0], 5)
    batches(spark.createDataFrame(lookups, f"{LOOKUP}, part int"), folders[1], 5)

    def stream():
        read = spark.readStream.option("maxFilesPerTrigger", 1)
        return with_metadata_as_of(read.schema(schema).parquet(folders[0]), read.schema(LOOKUP).parquet(folders[1]), 300, "2 hours")

    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    first = drain(stream(), out, checkpoint)
    assert spark.read.schema(stream().schema).parquet(out).count() == 0  # nothing is certain yet
    assert first.lastProgress["stateOperators"][0]["numRowsTotal"] > 0
    spark.createDataFrame([(None, at(40_000), None, None)], LOOKUP).coalesce(1).write.mode("append").parquet(folders[1])
    last = drain(stream(), out, checkpoint)  # a restart goes on where the first run ended
    assert last.lastProgress["stateOperators"][0]["numRowsTotal"] == 0

    def known(url, ts):
        host = url and url.removeprefix("http://").removeprefix("www.").split("/")[0]
        found = [(t, -1 if a is None else a, bool(s)) for d, t, a, s, _ in lookups if d == host and t <= ts and t > ts - dt.timedelta(seconds=300)]
        return max(found)[1:] if found else (-1, False)

    got = spark.read.parquet(out).collect()
    order = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((i, u, t, p, *known(u, t)) for i, u, t, p, _ in scans if t is not None), key=order)
    assert sorted((tuple(r) for r in got), key=order) == want
    assert 100 < sum(w[5] for w in want) < 500


def test_rows_later_than_the_lateness_are_dropped_and_counted(spark, tmp_path):
    folders = [str(tmp_path / n) for n in ("scans", "lookups")]
    scan = "id long, url string, ts timestamp"
    read = spark.readStream.option("maxFilesPerTrigger", 1)
    spark.createDataFrame([(1, "a.com", at(0))], scan).coalesce(1).write.parquet(folders[0])
    spark.createDataFrame([("a.com", at(5000), 1, True)], LOOKUP).coalesce(1).write.parquet(folders[1])
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def go():
        return drain(with_metadata_as_of(read.schema(scan).parquet(folders[0]), read.schema(LOOKUP).parquet(folders[1]), 60, "10 minutes"), out, checkpoint)

    go()
    spark.createDataFrame([(2, "a.com", at(10)), (3, "a.com", at(5010))], scan).coalesce(1).write.mode("append").parquet(folders[0])
    late = go()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in late.recentProgress for s in p["stateOperators"])
    spark.createDataFrame([(None, at(9000), None, None)], LOOKUP).coalesce(1).write.mode("append").parquet(folders[1])
    go()
    assert dropped == 1
    assert sorted((r.id, r.age_days) for r in spark.read.parquet(out).collect()) == [(1, -1), (3, 1)]


def fold(rows, ttl=60):
    """Kept (time, row) of one URL."""
    kept = []
    for t, row in sorted(rows):
        if not kept or t - kept[-1][0] >= dt.timedelta(seconds=ttl):
            kept.append((t, row))
    return kept


def test_kept_places():
    times = np.array([0, 10, 59, 60, 61, 119, 120, 500])
    assert kept_places(times, None, 60) == [0, 3, 6, 7] and kept_places(times, 55, 60) == [5, 7] and kept_places(times[:0], 3, 60) == []


def test_exact_dedup_out_of_order(spark, tmp_path):
    rng = random.Random(22)
    scans = [(i, "hot" if i % 2 else f"u{rng.randrange(30)}", at(rng.randrange(5000) + rng.choice([0, 0.5])), rng.randrange(10)) for i in range(1500)]
    scans += [(3000, "tie", at(7), 1), (3001, "tie", at(7), 8), (3002, "tie", at(67), 0), (3003, "tie", at(66.999999), 3), (3004, None, at(9), 2), (3005, "u1", None, 2)]
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "id long, url string, ts timestamp"
    batches(spark.createDataFrame(scans, f"{schema}, part int"), folder, 10)

    def go():
        return drain(stream_dedup_exact(spark.readStream.option("maxFilesPerTrigger", 1).schema(schema).parquet(folder), lateness="2 hours"), out, checkpoint)

    go()
    spark.createDataFrame([(0, None, at(40_000))], schema).coalesce(1).write.mode("append").parquet(folder)
    last = go()
    assert last.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    by_url = {}
    for i, u, t, _ in scans:
        if u is not None and t is not None:
            by_url.setdefault(u, []).append((t, i))
    got = spark.read.schema(schema).parquet(out).collect()
    assert sorted((r.url, r.ts) for r in got) == sorted((u, t) for u, rows in by_url.items() for t, _ in fold(rows))
    assert {(r.id, r.url, r.ts) for r in got} <= {x[:3] for x in scans}
    assert [r.id for r in got if r.url == "tie" and r.ts == at(7)] == [3000]


def test_exact_dedup_releases_as_the_watermark_moves(spark, tmp_path):
    """In order and with little lateness most rows are out before the end, and state is small."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "url string, ts timestamp"
    rows = [("a", at(10 * i), i // 40) for i in range(200)]
    batches(spark.createDataFrame(rows, f"{schema}, part int"), folder, 5)
    query = drain(stream_dedup_exact(spark.readStream.option("maxFilesPerTrigger", 1).schema(schema).parquet(folder)), out, checkpoint)
    got = sorted(r.ts for r in spark.read.schema(schema).parquet(out).collect())
    assert got == [at(60 * i) for i in range(len(got))] and 30 <= len(got) <= 33
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 30


def test_exact_dedup_reads_a_busy_url_piece_by_piece(spark, tmp_path):
    """More rows of one URL than a chunk has; the state has chunks and not rows or URLs."""
    rng = random.Random(23)
    times = [at(rng.randrange(2_000_000) + 0.25 * (i % 4)) for i in range(30_000)]
    scans = [("busy" if i % 3 else f"u{i % 3000}", t, i % 2) for i, t in enumerate(times)]
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "url string, ts timestamp"
    batches(spark.createDataFrame(scans, f"{schema}, part int").repartition(4), folder, 2)

    def go():
        read = spark.readStream.option("maxFilesPerTrigger", 1).schema(schema).parquet(folder)
        return drain(stream_dedup_exact(read, lateness="60 days"), out, checkpoint)

    first = go()
    assert 0 < first.lastProgress["stateOperators"][0]["numRowsTotal"] < 1000
    spark.createDataFrame([(None, at(20_000_000))], schema).coalesce(1).write.mode("append").parquet(folder)
    assert go().lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    by_url = {}
    for u, t, _ in scans:
        by_url.setdefault(u, []).append((t, 0))
    got = spark.read.schema(schema).parquet(out).collect()
    assert sorted((r.url, r.ts) for r in got) == sorted((u, t) for u, rows in by_url.items() for t, _ in fold(rows))
