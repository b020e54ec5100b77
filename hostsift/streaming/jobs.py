"""Continuous forms of the batch jobs.

Sinks are written per micro-batch under the batch's own id, so a batch that is
retried after a failure replaces its output instead of adding to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hostsift.operators.joins import blocklist_key
from hostsift.plans.verdict import verdicts
from hostsift.rules import DEFAULT_RULES, RuleSet
from hostsift.sources.feeds import feed_entry
from hostsift.sources.sinks import scan_log_rows
from hostsift.sources.versions import KeyTable
from hostsift.streaming.asof import with_metadata_as_of

DEDUP_TTL = "60 seconds"
#: How late scans and lookups of domains may be.
META_LATENESS = "10 minutes"


def stream_scan(
    scans: DataFrame, blocklist: DataFrame, rules: RuleSet = DEFAULT_RULES, meta: DataFrame | None = None,
    lateness: str = META_LATENESS,
) -> DataFrame:
    """Log rows for a stream of (id, url, prob, response_time, ts).

    ``meta`` is a stream of lookups of domains; every scan gets the newest one at or before it, as in the batch job, and so
    waits until lookups that are ``lateness`` late are in.
    """
    if meta is not None:
        scans = with_metadata_as_of(scans, meta, rules.meta_cache_ttl_sec, lateness)
    return scan_log_rows(verdicts(scans, blocklist, rules))


def write_scan_log(log: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    writer = log.writeStream.format("parquet").partitionBy("event_date").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_dedup(scans: DataFrame, ts: str = "ts", url: str = "url", ttl: str = DEDUP_TTL) -> DataFrame:
    """Drop repeats of a URL within the TTL, natively.

    State is one entry per URL until the watermark passes it, so repeats a
    little later than the TTL may be dropped too; ``dedup.stream_dedup_exact`` drops none of these.
    """
    return scans.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([url])


def stream_daily_kpis(log: DataFrame, lateness: str) -> DataFrame:
    """Running totals per day of a stream of log rows.

    Rows later than ``lateness`` behind the newest are not counted, so the caller has to say how late rows may be; the
    query's progress reports what came later as ``numRowsDroppedByWatermark``.
    """
    day = F.window("ts", "1 day")
    return (
        log.withWatermark("ts", lateness)
        .groupBy(day.alias("w"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("result") == "PHISHING").alias("phishing"))
        .select(F.to_date("w.start").alias("day"), "total", "phishing")
    )


def write_daily_kpis(kpis: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep each micro-batch's changed days under its batch id."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = kpis.writeStream.outputMode("update").foreachBatch(put)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest_daily_kpis(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("day", T.DateType()),
            T.StructField("total", T.LongType()),
            T.StructField("phishing", T.LongType()),
            T.StructField("batch_id", T.LongType()),
        ]
    )
    versions = spark.read.schema(schema).parquet(path)
    newest = versions.groupBy("day").agg(F.max(F.struct("batch_id", "total", "phishing")).alias("v"))
    return newest.select("day", "v.total", "v.phishing")


def blocklist(spark: SparkSession, path: str, buckets: int = 64) -> KeyTable:
    """The versioned blocklist at ``path``: entries as they came, dealt by what URLs are looked up by."""
    return KeyTable(spark, path, "key string, url string", "key", ["key", "url"], buckets)


def stream_feed_refresh(lines: DataFrame, path: str, checkpoint: str, writer: str = "feed", **trigger) -> StreamingQuery:
    """Add the new entries of arriving feed files to the versioned blocklist at ``path``; nothing is dropped."""

    def put(batch: DataFrame, batch_id: int) -> None:
        entries = batch.select(feed_entry(F.col("value")).alias("url")).dropna()
        blocklist(batch.sparkSession, path).add(entries.withColumn("key", blocklist_key(F.col("url"))), writer, batch_id)

    query = lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return query.trigger(**trigger).start()


def blocklist_table(spark: SparkSession, path: str) -> DataFrame:
    return blocklist(spark, path).read().select("url")


def write_scans(
    scans: DataFrame, entries: str, path: str, checkpoint: str, rules: RuleSet = DEFAULT_RULES, **trigger
) -> StreamingQuery:
    """Judge a stream of scans by the blocklist as it is when each micro-batch begins, and write the log.

    Only the buckets that a batch's URLs fall in are read. A batch is written under its own id, so that a repeated one replaces
    what it wrote; it may then see a newer blocklist. Its rows are dealt out to all cores, however few files they came in.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        table = blocklist(batch.sparkSession, entries)
        batch = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism).persist()
        keys = batch.select(blocklist_key(F.col("url")).alias("key")).dropna()
        judged = verdicts(batch, table.read(table.touched(keys)).select("url"), rules)
        log = scan_log_rows(judged)
        log.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.unpersist()

    query = scans.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return query.trigger(**trigger).start()
