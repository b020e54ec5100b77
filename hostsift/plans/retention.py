"""Retention of the scan log.

The log lies in a folder per day. Purging drops whole days by deleting their folders and rewrites the one day that the cut falls
in; other days' files aren't touched, and rows that are appended meanwhile stay, as only files that were read are replaced. What
has to be deleted and moved for the cut day is written down first, so that a purge that was stopped is finished by the next.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_DAYS = 30


def retention_days(days: object = DEFAULT_DAYS) -> int:
    """At least one day; anything unreadable gives the default."""
    try:
        return max(1, int(days))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return DEFAULT_DAYS


def _cutoff(as_of: Column, days: object) -> Column:
    return as_of.cast("timestamp") - F.make_dt_interval(days=F.lit(retention_days(days)))


def retention_filter(log: DataFrame, as_of: Column, days: object = DEFAULT_DAYS) -> DataFrame:
    return log.filter(F.col("ts") >= _cutoff(as_of, days))


def retention_counts(log: DataFrame, as_of: Column, days: object = DEFAULT_DAYS) -> DataFrame:
    old = F.col("ts") < _cutoff(as_of, days)
    return log.agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))


def rewrite_retained(log: DataFrame, path: str, as_of: Column, days: object = DEFAULT_DAYS) -> None:
    """Write the retained events to a new version folder, by day."""
    kept = retention_filter(log, as_of, days).withColumn("event_date", F.to_date("ts"))
    kept.hint("rebalance", "event_date").write.mode("errorifexists").partitionBy("event_date").parquet(path)


_DAY = re.compile(r"event_date=(\d{4}-\d\d-\d\d)")
#: Spark's readers pass over names that begin so.
_OWN = "_retention"


class _Log:
    """The log's folder on whatever file system it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(path))) if self.fs.exists(self.at(path)) else []

    def write(self, path: str, text: str) -> None:
        draft = f"{path}.draft"
        out = self.fs.create(self.at(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.rename(self.at(draft), self.at(path))


def _finish(log: _Log) -> None:
    """Do what is written down; each step can be done again."""
    note = f"{log.path}/{_OWN}/todo.json"
    if not log.fs.exists(log.at(note)):
        return
    todo = json.loads(log.spark.read.option("wholetext", "true").text(note).first().value)
    for source, target in todo["move"]:
        if log.fs.exists(log.at(source)):
            log.fs.rename(log.at(source), log.at(target))
    for old in todo["delete"]:
        log.fs.delete(log.at(old), False)
    log.fs.delete(log.at(note), False)


def purge_scan_log(spark: SparkSession, path: str, as_of: dt.datetime, days: object = DEFAULT_DAYS) -> tuple[int, int]:
    """Take events older than the retention out of the log at ``path``; returns how many went and how many files were written.

    ``as_of`` is in UTC. A day without a file left keeps its empty folder until the next purge. Times are compared as in
    :func:`retention_filter`.
    """
    log = _Log(spark, path)
    _finish(log)
    cut = as_of - dt.timedelta(days=retention_days(days))
    gone, old_days, cut_day = 0, [], None
    for name in log.names(log.path):
        if m := _DAY.fullmatch(name):
            if m[1] < cut.date().isoformat():
                old_days.append(name)
            elif m[1] == cut.date().isoformat():
                cut_day = name
    if old_days:  # counted from the files' footers
        gone += spark.read.parquet(*[f"{log.path}/{d}" for d in old_days]).count()
        for d in old_days:
            log.fs.delete(log.at(f"{log.path}/{d}"), True)
    files = [n for n in log.names(f"{log.path}/{cut_day}") if n.startswith("part-")] if cut_day else []
    if not files:
        return gone, 0
    folder = f"{log.path}/{cut_day}"
    rows = spark.read.parquet(*[f"{folder}/{n}" for n in files])  # what is appended from now on isn't read
    old = F.col("ts") < F.lit(cut.replace(tzinfo=dt.timezone.utc))
    before, after = rows.agg(F.count_if(old), F.count_if(~old)).first()
    if not before:
        return gone, 0
    work = f"{log.path}/{_OWN}/{uuid.uuid4().hex}"
    if after:
        rows.where(~old).write.parquet(work)
    made = [n for n in log.names(work) if n.startswith("part-")]
    todo = {"move": [[f"{work}/{n}", f"{folder}/{n}"] for n in made], "delete": [f"{folder}/{n}" for n in files]}
    log.fs.mkdirs(log.at(f"{log.path}/{_OWN}"))
    log.write(f"{log.path}/{_OWN}/todo.json", json.dumps(todo))
    _finish(log)
    log.fs.delete(log.at(work), True)
    return gone + before, len(made)
