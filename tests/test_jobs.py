"""Feeds, sinks, streams and the model pipeline."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from hostsift.plans import boost as B
from hostsift.plans import model as L
from hostsift.plans.corpus import labelled_corpus
from hostsift.session import shared_dir
from hostsift.sources import feeds, sinks
from hostsift.streaming import jobs as S


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def urls(df):
    return sorted(r.url for r in df.collect())


def test_line_feed(spark, tmp_path):
    path = write(tmp_path, "f.txt", "# comment\n  HTTP://A.com \n\nnodot\nhttp://b.com/x\n")
    assert urls(feeds.read_line_feed(spark, path)) == ["HTTP://A.com", "http://b.com/x"]
    assert urls(feeds.read_line_feed(spark, path, lower=True)) == ["http://a.com", "http://b.com/x"]


def test_keyed_feed(spark, tmp_path):
    named = write(tmp_path, "a.csv", 'id, URL \n1,"http://a.com/?q=1,2"\n2,\n')
    second = write(tmp_path, "b.csv", "id,detail,x\n1,http://b.com,z\n")
    assert urls(feeds.read_keyed_feed(spark, named)) == ["http://a.com/?q=1,2"]
    assert urls(feeds.read_keyed_feed(spark, second)) == ["http://b.com"]


def test_mixed_labelled(spark, tmp_path):
    path = write(tmp_path, "m.csv", "URL,Label\na.com,1\nb.com,BAD\nc.com,good\nd.com,0\ne.com,Phishing\nf.com,\n")
    got = {r.url: r.type for r in feeds.read_mixed_labelled(spark, path).collect()}
    assert [u for u, t in got.items() if t == "phishing"] == ["a.com", "b.com", "e.com"] and len(got) == 6
    typed = write(tmp_path, "t.csv", "url,type\na.com,phishing\n")
    assert feeds.read_mixed_labelled(spark, typed).first().type == "phishing"


def test_feed_glob(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        feeds.read_feed_glob(spark, str(tmp_path / "active.txt"), str(tmp_path / "extra_*.txt"))
    write(tmp_path, "extra_b.txt", "B.com\nc.com\n#x\n")
    only_extra = feeds.read_feed_glob(spark, str(tmp_path / "active.txt"), str(tmp_path / "extra_*.txt"))
    assert urls(only_extra) == ["b.com", "c.com"]
    write(tmp_path, "active.txt", "a.com\n")
    both = feeds.read_feed_glob(spark, str(tmp_path / "active.txt"), str(tmp_path / "extra_*.txt"))
    assert {r.feed_file.rpartition("/")[2]: r.entries for r in feeds.feed_line_counts(both).collect()} == {"active.txt": 1, "extra_b.txt": 2}


def test_optional_source(spark, tmp_path):
    missing = feeds.optional_source(spark, lambda: feeds.read_mixed_labelled(spark, str(tmp_path / "none.csv")))
    assert missing.columns == ["url", "type"] and missing.count() == 0


def test_pruned_scan_pushes_the_filter(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a.com", "phishing", "x"), ("b.com", "legitimate", "y")], "url string, type string, extra string")
    sinks.write_labelled_dataset(df, path)
    scan = feeds.read_pruned_phishing_urls(spark, path)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(type,phishing)" in plan and urls(scan) == ["a.com"]


def test_scan_log_is_partitioned_by_day(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame(
        [(1, "u" * 900, "SAFE", 1.23456, 0.98765, dt.datetime(2024, 1, 2, 23, 59)), (2, "v", "PHISHING", 9.0, 0.1, dt.datetime(2024, 1, 3))],
        "id long, input string, result string, risk_score double, response_time double, ts timestamp",
    )
    sinks.append_scan_log(rows, path)
    sinks.append_scan_log(rows, path)
    stored = spark.read.parquet(path)
    day = stored.filter("event_date = '2024-01-02'")
    assert stored.count() == 4 and day.count() == 2
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().executedPlan().toString()
    first = day.first()
    assert len(first.content) == 900
    assert (len(first.content_shown), first.risk_score, first.response_time) == (500, 1.2346, 0.9877)


def test_fp_reports_are_guarded(spark, tmp_path):
    path = str(tmp_path / "fp")
    rows = spark.createDataFrame([("=cmd()", "@x", dt.datetime(2024, 1, 2)), ("hxxp://a[.]com", "ok", dt.datetime(2024, 1, 2))],
                                 "url string, reason string, reported timestamp")
    sinks.append_fp_reports(rows, path)
    got = {r.url: (r.domain, r.reason, r.type) for r in spark.read.schema(feeds.FP_REPORT).parquet(path).collect()}
    assert got["http://a.com"] == ("a.com", "ok", "legitimate") and got["'=cmd()"][1] == "'@x"


def test_labelled_corpus_priority(spark):
    def source(*rows):
        return spark.createDataFrame(list(rows), "url string, type string, line_no long")

    merged = labelled_corpus([source(("a", "phishing", 1), (None, "phishing", 2)), source(("a", "legitimate", 1), ("b", "legitimate", 2))])
    assert {r.url: r.type for r in merged.collect()} == {"a": "phishing", "b": "legitimate"}


# --- streams ---------------------------------------------------------------------


def run(spark, stream, tmp_path, name):
    out = str(tmp_path / name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-cp")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_native_dedup_keeps_every_url(spark, tmp_path):
    rng = random.Random(4)
    scans = [(f"u{rng.randrange(40)}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(4000))) for _ in range(900)]
    table = spark.createDataFrame(scans, "url string, ts timestamp")
    table.write.parquet(str(tmp_path / "in"))
    native = run(spark, S.stream_dedup(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))), tmp_path, "native")
    assert {r.url for r in native.select("url").distinct().collect()} == {u for u, _ in scans}


def test_daily_kpis_survive_a_restart(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i % 3, i % 24), "PHISHING" if i % 4 == 0 else "SAFE") for i in range(200)]
    table = spark.createDataFrame(rows, "ts timestamp, result string")
    source, out, cp = (str(tmp_path / n) for n in ("in", "kpi", "cp"))
    for part in (0, 1):
        table.filter(F.hour("ts") % 2 == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(table.schema).parquet(source)
        S.write_daily_kpis(S.stream_daily_kpis(stream, "10 days"), out, cp, availableNow=True).awaitTermination()
    got = {r.day.day: (r.total, r.phishing) for r in S.latest_daily_kpis(spark, out).collect()}
    want = {}
    for ts, result in rows:
        total, hits = want.get(ts.day, (0, 0))
        want[ts.day] = (total + 1, hits + (result == "PHISHING"))
    assert got == want


def test_feed_refresh_only_adds(spark, tmp_path):
    source, out, cp = (tmp_path / "in"), str(tmp_path / "bl"), str(tmp_path / "cp")
    source.mkdir()
    for name, text in (("1.txt", "http://a.com\nhttp://b.com\n"), ("2.txt", "# c\nhttp://b.com\nhttp://c.com\n")):
        write(source, name, text)
        S.stream_feed_refresh(spark.readStream.text(str(source)), out, cp, availableNow=True).awaitTermination()
    table = S.blocklist_table(spark, out)
    assert urls(table) == ["http://a.com", "http://b.com", "http://c.com"]


# --- model -----------------------------------------------------------------------


def test_char_ngrams(spark):
    got = spark.createDataFrame([("abcd",), ("ab",), ("",)], "t string").select(L.char_ngrams(F.col("t"))).collect()
    assert [r[0] for r in got] == [["abc", "bcd", "abcd"], [], []]


def test_tfidf_weights_by_hand(spark):
    rows = spark.createDataFrame([(["x", "x", "y"],), (["y", "z"],), (["y"],)], "grams array<string>")
    stages = L.tfidf_char(rows, 10)
    vocabulary = stages.stages[0].vocabulary
    first = dict(zip(vocabulary, stages.transform(rows).first().char_block.toArray()))
    idf = {"x": math.log(4 / 2) + 1, "y": math.log(4 / 4) + 1}
    raw = {"x": 2 * idf["x"], "y": idf["y"]}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert first["x"] == pytest.approx(raw["x"] / norm) and first["y"] == pytest.approx(raw["y"] / norm) and first["z"] == 0


def test_model_round_trip_and_monotone_calibration(spark, sf_dir, tmp_path):
    from registry.q_models import corpus

    rows = corpus(spark, sf_dir)
    trees = L.train_boosted_trees(rows.filter("split = 'train'"), 3, 3, 0.05, 100, 50)
    model = L.calibrate_isotonic(trees, rows.filter("split = 'calibrate'"))
    L.save_model(model, str(tmp_path / "m"))
    table = rows.select("url_id", "url")
    a = {r.url_id: (r.raw_prob, r.prob) for r in L.score_batch(model, table).collect()}
    b = {r.url_id: (r.raw_prob, r.prob) for r in L.score_batch(L.load_model(str(tmp_path / "m")), table).collect()}
    assert a == b and len(a) == table.count()
    tiered = rows.select("url_id", "url", F.when(F.col("url_id") % 3 == 0, "trusted").otherwise("model").alias("tier"))
    split = {r.url_id: (r.raw_prob, r.prob) for r in L.score_undecided(model, tiered, "url").collect()}
    assert split == {i: (None, None) if i % 3 == 0 else v for i, v in a.items()}
    ordered = [p for _, p in sorted(a.values())]
    assert ordered == sorted(ordered) and all(0 <= p <= 1 for p in ordered)
    stacked = model.transform(rows).first().stacked
    assert len(stacked) == len(model.stages[0].vocabulary) + len(model.stages[4].vocabulary) + 22


def counted_scores(spark, monkeypatch):
    """Scores that say how many rows were scored."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scored(url, model):
        seen.add(1)
        return len(url) / 10

    monkeypatch.setattr(L, "score_batch", lambda model, df: df.withColumn("prob", scored("url", F.lit(model))))
    return seen


def test_two_versions_score_each_row_once(spark, monkeypatch):
    seen = counted_scores(spark, monkeypatch)
    table = spark.createDataFrame([("a" * n, n % 2) for n in range(1, 10)] + [("a.com", None)], "url string, label int")
    lines = L.compare_model_versions("new", "old", table).collect()
    assert seen.value == 2 * 10
    assert [(r.version, r.legit, r.false_positives, r.threshold_milli) for r in lines] == [
        (v, 4, 1, 800) for v in ("candidate", "shipped")
    ]


def test_percentiles_of_sources_score_each_row_once(spark, monkeypatch):
    from registry import q_models as Q

    seen = counted_scores(spark, monkeypatch)
    rows = [("http://" + "a" * n + ".com", 1, "one", "r", "train") for n in range(1, 8)] + [("b.com", 0, "two", "q", "train")]
    table = spark.createDataFrame(rows, "url string, label int, source string, root string, split string")
    monkeypatch.setattr(Q, "plain", lambda spark, sf: table)
    monkeypatch.setattr(Q, "model", lambda spark, sf: None)
    found = {(r.source, r.stat): r.value for r in Q.evaluate_source_percentiles(spark, "").collect()}
    assert seen.value == 7
    assert found["one", "p50"] == found["one", "mean"] == 1.5 and len(found) == 6


def separable(spark, n=300):
    from pyspark.ml.linalg import Vectors

    rng = random.Random(5)
    rows = []
    for _ in range(n):
        x = [rng.random() for _ in range(4)]
        rows.append((int(x[0] + 0.5 * x[1] + 0.3 * (x[2] > 0.5) + 0.2 * rng.random() > 1.0), Vectors.dense(x)))
    return spark.createDataFrame(rows, ["label", "stacked"])


def stored(spark, rows, path):
    rows.coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def test_boosting_that_was_stopped_goes_on_with_the_same_trees(spark, tmp_path):
    rows = stored(spark, separable(spark), str(tmp_path / "rows"))
    whole, losses = B.boost(rows, None, str(tmp_path / "whole"), rounds=6, depth=3, step=0.3, segment=2)
    assert [n for n, _ in losses] == [2, 4, 6] and whole.getNumTrees == 6
    B.boost(rows, None, str(tmp_path / "stopped"), rounds=4, depth=3, step=0.3, segment=2)
    (tmp_path / "stopped" / "trees-6").mkdir()  # a crash between the trees and the state
    resumed, _ = B.boost(rows, None, str(tmp_path / "stopped"), rounds=6, depth=3, step=0.3, segment=2)
    assert B.tree_rows(resumed) == B.tree_rows(whole)
    again, _ = B.boost(rows, None, str(tmp_path / "whole"), rounds=6, depth=3, step=0.3, segment=2)
    assert B.tree_rows(again) == B.tree_rows(whole)
    assert B.tree_rows(B.truncated(whole, 4)) == [r for r in B.tree_rows(whole) if r[0] < 4]


def walk(nodes, x):
    at = 0
    while nodes[at][2] is not None:
        _, _, feature, threshold, categories, left, right, _ = nodes[at]
        goes_left = x[feature] <= threshold if categories is None else x[feature] in categories
        at = left if goes_left else right
    return nodes[at][7]


def test_boosted_scores_are_the_trees_walked(spark, tmp_path):
    rows = stored(spark, separable(spark), str(tmp_path / "rows"))
    model, _ = B.boost(rows, None, str(tmp_path / "b"), rounds=5, depth=4, step=0.3, segment=3)
    trees = {}
    for r in B.tree_rows(model):
        trees.setdefault(r[0], {})[r[1]] = r
    hits = 0
    for r in model.transform(rows).collect():
        odds = sum(0.3 * walk(nodes, r.stacked) for nodes in trees.values())
        assert r.probability[1] == pytest.approx(1 / (1 + math.exp(-odds)))
        hits += r.prediction == r.label
    assert hits > 0.9 * rows.count()
    # Newton steps: the first tree's leaves are means of (label - p) / (p (1 - p)) at p = 0.5, plus or minus 2.
    leaves = [n[7] for n in trees[0].values() if n[2] is None]
    assert all(-2 - 1e-9 <= v <= 2 + 1e-9 for v in leaves) and min(leaves) < 0 < max(leaves)


def test_boosting_ends_when_the_held_out_loss_rises(spark, tmp_path):
    rows = separable(spark, 120)
    noise = rows.select((F.rand(3) < 0.5).cast("int").alias("label"), "stacked")
    train, held = stored(spark, noise, str(tmp_path / "t")), stored(spark, noise.select(1 - F.col("label").alias("label"), "stacked").toDF("label", "stacked"), str(tmp_path / "h"))
    model, losses = B.boost(train, held, str(tmp_path / "b"), rounds=400, depth=4, step=0.5, segment=2)
    assert [n for n, _ in losses] == [2, 4] and model.getNumTrees == 2  # the labels are the other way round


def test_the_gate_falls_each_way(spark, tmp_path):
    from hostsift.operators import metrics

    good = [(i, 1 if i % 4 == 0 else 0, 0.9 if i % 4 == 0 else 0.1) for i in range(400)]
    poor = [(i, y, random.Random(i).random()) for i, y, _ in good]
    tables = [spark.createDataFrame(x, "url_id long, label int, prob double") for x in (good, poor)]
    ships = [metrics.model_gate(*pair).first().asDict() for pair in (tables, tables[::-1])]
    assert ships[0] != ships[1] and sorted(s["ships"] for s in ships) == [False, True]


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_only_a_missing_path_reads_as_an_absent_source(spark, tmp_path):
    from pyspark.errors import AnalysisException

    missing = feeds.optional_source(spark, lambda: spark.read.parquet(str(tmp_path / "none")))
    assert missing.count() == 0
    spark.range(3).write.parquet(str(tmp_path / "there"))
    with pytest.raises(AnalysisException):
        feeds.optional_source(spark, lambda: spark.read.parquet(str(tmp_path / "there")).select("url"))
