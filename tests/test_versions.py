"""Versioned key tables: what readers see, crashes, rival writers, merging, and the scans that use them."""

import random

import pytest
from pyspark.sql import functions as F

from hostsift.sources.versions import KeyTable, Taken
from hostsift.streaming import jobs as S


@pytest.fixture
def table(spark, tmp_path):
    return KeyTable(spark, str(tmp_path / "keys"), "key string, n long", "key", buckets=4)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, n long")


def contents(df):
    return sorted((r.key, r.n) for r in df.collect())


def test_additions_and_old_versions(spark, table):
    assert table.read().count() == 0 and table.current().number == 0
    first = table.add(rows(spark, ("a", 2), ("a", 1), ("b", 3), (None, 9)))
    second = table.add(rows(spark, ("b", 1), ("c", 4)))
    assert contents(table.read()) == [("a", 1), ("b", 3), ("c", 4)]
    assert contents(table.read(version=first)) == [("a", 1), ("b", 3)]
    assert contents(table.bucketed(second)) == contents(table.read())
    assert table.add(rows(spark, ("c", 7))).folders == second.folders  # nothing new, no folder


def test_a_batch_counts_once(spark, table):
    table.add(rows(spark, ("a", 1)), "feed", 0)
    again = table.add(rows(spark, ("z", 1)), "feed", 0)  # as after a failure between commit and checkpoint
    assert contents(table.read()) == [("a", 1)] and again.number == 1
    table.add(rows(spark, ("z", 1)), "other", 0)
    assert contents(table.read()) == [("a", 1), ("z", 1)]


def test_a_crash_before_the_manifest_leaves_the_old_version(spark, table, monkeypatch):
    table.add(rows(spark, ("a", 1)))
    with monkeypatch.context() as patched:
        patched.setattr(KeyTable, "_commit", lambda self, version: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            table.add(rows(spark, ("b", 1)))
    assert contents(table.read()) == [("a", 1)] and len(list(table.folders_on_disk())) == 2
    assert table.vacuum() == 1 and contents(table.read()) == [("a", 1)]


def test_two_writers(spark, table, monkeypatch):
    """The other one commits while this one writes its files: both additions are there, and no key twice."""
    table.add(rows(spark, ("a", 1)))
    write, other = KeyTable._write, []

    def slow(self, fresh, level):
        made = write(self, fresh, level)
        if not other:
            other.append(True)
            self.add(rows(spark, ("b", 1), ("c", 1)))
        return made

    monkeypatch.setattr(KeyTable, "_write", slow)
    table.add(rows(spark, ("c", 2), ("d", 2)))
    assert contents(table.read()) == [("a", 1), ("b", 1), ("c", 1), ("d", 2)]
    with pytest.raises(Taken):
        table._commit(table.current())


def test_files_stay_few_over_many_batches(spark, table):
    rng, want = random.Random(31), {}
    for batch in range(40):
        pairs = [(f"k{rng.randrange(400)}", batch) for _ in range(5)]
        table.add(rows(spark, *pairs), "feed", batch)
        for k, n in pairs:
            want.setdefault(k, n)
    now = table.current()
    assert contents(table.read()) == sorted(want.items())
    assert len(now.folders) <= 7 + 5 and max(f.level for f in now.folders) == 1  # 40 = 5 x 8
    assert all(len(names) == 1 for f in now.folders for names in f.files.values())
    table.vacuum(keep=1)
    assert len(list(table.folders_on_disk())) == len(now.folders) and contents(table.read()) == sorted(want.items())


def test_only_touched_buckets_are_read(spark, table):
    table.add(rows(spark, *((f"k{i}", i) for i in range(100))))
    key = rows(spark, ("k7", 0))
    (bucket,) = table.touched(key)
    part = table.read([bucket])
    assert len(part.inputFiles()) == 1 and len(table.read().inputFiles()) == 4
    assert 0 < part.count() < 100 and ("k7", 7) in contents(part)
    assert part.where(table.bucket(F.col("key")) != bucket).count() == 0


def test_bucketed_reads_need_no_exchange(spark, table):
    table.add(rows(spark, *((f"k{i}", i) for i in range(100))))
    table.add(rows(spark, *((f"k{i}", i) for i in range(50, 200))))
    new = rows(spark, *((f"k{i}", i) for i in range(150, 300))).repartition(4, "key")
    with_hint = new.hint("merge").join(table.bucketed().select("key"), "key", "left_anti")
    plan = with_hint._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert with_hint.count() == 100
    assert plan.count("Exchange hashpartitioning") == 1  # of the new side alone


def test_scans_see_entries_that_come_while_they_run(spark, tmp_path):
    feed, entries, scans, out = (str(tmp_path / n) for n in ("feed", "entries", "scans", "out"))
    schema = "id long, url string, prob double, response_time double, ts timestamp"

    def refresh(*urls):
        spark.createDataFrame([(u,) for u in urls], "value string").coalesce(1).write.mode("append").text(feed)
        S.stream_feed_refresh(spark.readStream.text(feed), entries, str(tmp_path / "cp-feed"), availableNow=True).awaitTermination()

    def scan(*found):
        data = [(i, u, 0.1, 0.1) for i, u in found]
        table = spark.createDataFrame(data, "id long, url string, prob double, response_time double").withColumn("ts", F.current_timestamp())
        table.coalesce(1).write.mode("append").parquet(scans)
        stream = spark.readStream.schema(schema).parquet(scans)
        S.write_scans(stream, entries, out, str(tmp_path / "cp-scans"), availableNow=True).awaitTermination()

    scan((1, "http://evil.example.com/a/"))  # no blocklist yet
    refresh("hxxp://other.example.net/x", "# none", "nodots")
    scan((2, "http://evil.example.com/a/"), (3, "http://other.example.net/x/"))
    refresh("http://evil.example.com/a", "hxxp://other.example.net/x")
    scan((4, "http://evil.example.com/a/"))
    got = {r.id: r.result for r in spark.read.parquet(out).collect()}
    assert got == {1: "SAFE", 2: "SAFE", 3: "PHISHING", 4: "PHISHING"}
    table = S.blocklist(spark, entries)
    assert table.current().number == 2 and sorted(r.url for r in table.read().collect()) == ["http://evil.example.com/a", "hxxp://other.example.net/x"]


def test_a_batch_of_one_file_is_judged_by_all_cores(spark, tmp_path, monkeypatch):
    table = spark.range(0, 400, 1, 1).selectExpr(
        "id", "'http://shop' || id % 7 || '.example.com/a' AS url", "0.1D AS prob", "0.1D AS response_time", "timestamp'2024-01-01' AS ts"
    )
    table.write.parquet(str(tmp_path / "scans"))
    sizes, judge = [], S.verdicts

    def verdicts(batch, *others):
        sizes.extend(r["count"] for r in batch.groupBy(F.spark_partition_id()).count().collect())
        return judge(batch, *others)

    monkeypatch.setattr(S, "verdicts", verdicts)
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "scans"))
    S.write_scans(stream, str(tmp_path / "list"), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) <= 60
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(400))
