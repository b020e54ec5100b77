"""Streaming jobs run to completion over file sources (section L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostsift.functions.hashing import hash32
from hostsift.operators.joins import blocklist_key
from hostsift.plans import kpis as KP
from hostsift.session import scratch_path
from hostsift.streaming import jobs as S
from hostsift.streaming.asof import with_metadata_as_of
from hostsift.streaming.dedup import stream_dedup_exact
from registry.base import h, parsed, query, verdict_ctes
from registry.corpus import RULES, derived, given, with_duck
from registry.q_tables import META_DUCK, scans_and_meta

ALL = {"availableNow": True}


def as_stream(spark, table, files: int = 4, per_trigger: int = 2):
    """A table written as several files, read as a stream of micro-batches."""
    path = scratch_path(spark, "stream-in")
    table.repartition(files, *[c for c in ("id", "url") if c in table.columns]).write.parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def nav(spark, sf):
    log = derived(spark, sf, "fx_scan_log")
    return log.select("id", F.col("content").alias("url"), "ts", "result", "response_time")


#: The newest lookup at or before each scan that is younger than the TTL.
AS_OF_SCAN = [
    *META_DUCK,
    parsed("lg", "fx_scan_log", "content"),
    """nearest AS (SELECT l.id, m.age_days, m.ssl_valid, row_number() OVER (PARTITION BY l.id ORDER BY m.checked_at DESC) AS rn
        FROM lg l LEFT JOIN meta m ON m.domain = l.host AND m.checked_at <= l.ts AND m.checked_at > l.ts - INTERVAL 900 SECOND)""",
    f"""sv AS (SELECT l.id, content AS url, CAST({h("content || 'p'")} % 1000 AS DOUBLE) / 1000 AS prob,
        coalesce(n.age_days, -1) AS age_days, coalesce(n.ssl_valid, FALSE) AS ssl_valid
        FROM lg l JOIN nearest n ON n.id = l.id AND n.rn = 1)""",
]


def scans_and_lookups(spark, sf):
    """Both tables as streams of five micro-batches, rows in any order, and a function that ends them with a heartbeat."""
    scans = nav(spark, sf).withColumn("prob", (hash32(F.col("url"), "p") % 1000).cast("double") / 1000).drop("result")
    lookups = scans_and_meta(spark, sf)[1].select("domain", "checked_at", "age_days", "ssl_valid")
    streams, folder = [], scratch_path(spark, "lookups")
    lookups.withColumn("part", F.rand(7)).repartition(5, "part").drop("part").write.parquet(folder)
    streams = [as_stream(spark, scans, 5, 1), spark.readStream.schema(lookups.schema).option("maxFilesPerTrigger", 1).parquet(folder)]

    def end():
        last = scans.agg(F.max("ts") + F.expr("INTERVAL 90 DAYS")).select(F.lit(None).cast("string"), "*", F.lit(-1), F.lit(False))
        last.toDF(*lookups.columns).coalesce(1).write.mode("append").parquet(folder)

    return *streams, end


def finished(spark, stream, start, end):
    """Run what is there, then the heartbeat, which lets the last rows go."""
    checkpoint = scratch_path(spark, "stream-cp")
    for step in (None, end):
        if step:
            step()
        start(stream, checkpoint).awaitTermination()


@query(
    "stream_scan",
    with_duck(
        ("fx_urls", "fx_scan_log", "fx_blocklist"), *AS_OF_SCAN, *verdict_ctes("sv", "age_days", "ssl_valid"),
        select="SELECT id, norm AS content, result, risk_score FROM verdict",
    ),
)
def stream_scan(spark, sf):
    scans, lookups, end = scans_and_lookups(spark, sf)
    log = S.stream_scan(scans, derived(spark, sf, "fx_blocklist"), meta=lookups, lateness="60 days")
    out = scratch_path(spark, "stream-log")
    finished(spark, log, lambda s, checkpoint: S.write_scan_log(s, out, checkpoint, **ALL), end)
    return spark.read.schema(log.schema).parquet(out).select("id", "content", "result", "risk_score")


@query(
    "stream_metadata_as_of",
    with_duck(("fx_urls", "fx_scan_log"), *AS_OF_SCAN, select="SELECT id, age_days, ssl_valid FROM sv"),
)
def stream_metadata_as_of(spark, sf):
    """What each scan of the stream knows of its domain."""
    scans, lookups, end = scans_and_lookups(spark, sf)
    known = with_metadata_as_of(scans, lookups, RULES.meta_cache_ttl_sec, lateness="60 days")
    out = scratch_path(spark, "stream-out")
    finished(spark, known, lambda s, checkpoint: to_path(s, out, checkpoint), end)
    return spark.read.schema(known.schema).parquet(out).select("id", "age_days", "ssl_valid")


def to_path(stream, out, checkpoint):
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(**ALL)
    return writer.option("path", out).option("checkpointLocation", checkpoint).start()


def first_within_ttl(source: str) -> str:
    """CTE chain: ``e`` (url, us) has the scans; kept are the first of a URL, then the first a TTL after it, and so on."""
    return f"""e AS ({source}),
        nxt AS (SELECT url, us, min(us) OVER (PARTITION BY url ORDER BY us
            RANGE BETWEEN 60000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM e),
        kept AS (SELECT url, min(us) AS us FROM e GROUP BY url
            UNION ALL SELECT n.url, n.following FROM kept k JOIN (SELECT DISTINCT * FROM nxt) n ON n.url = k.url AND n.us = k.us
            WHERE n.following IS NOT NULL)"""


def deduplicated(spark, table):
    """Exact form over ten micro-batches of rows in any order."""
    source = scratch_path(spark, "dedup-in")
    table.withColumn("part", F.rand(11)).repartition(10, "part").drop("part").write.parquet(source)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def end():
        last = table.agg(F.max("ts") + F.expr("INTERVAL 90 DAYS")).toDF("ts").withColumn("url", F.lit(None).cast("string"))
        last.select(*table.columns).coalesce(1).write.mode("append").parquet(source)

    kept, out = stream_dedup_exact(stream, lateness="60 days"), scratch_path(spark, "dedup-out")
    finished(spark, kept, lambda s, checkpoint: to_path(s, out, checkpoint), end)
    return spark.read.schema(kept.schema).parquet(out).select("url", F.unix_micros("ts").alias("us"))


@query(
    "stream_dedup_ttl",
    with_duck(
        ("fx_scan_log",), first_within_ttl("SELECT content AS url, epoch_us(ts) AS us FROM fx_scan_log"),
        select="SELECT url, us FROM kept",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def stream_dedup_ttl(spark, sf):
    return deduplicated(spark, nav(spark, sf).select("url", "ts"))


@query(
    "stream_dedup_exact",
    "WITH RECURSIVE " + first_within_ttl("SELECT 'https://' || event_type || '.example.com/' AS url, epoch_us(ts) AS us FROM events")
    + " SELECT url, us FROM kept",
)
def stream_dedup_busy(spark, sf):
    """Page views of a few busy URLs."""
    url = F.concat(F.lit("https://"), F.col("event_type"), F.lit(".example.com/"))
    return deduplicated(spark, given(spark, sf, "events").select(url.alias("url"), "ts"))


@query(
    "stream_daily_kpis",
    with_duck(
        ("fx_scan_log",),
        select="""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total,
            count(*) FILTER (result = 'PHISHING') AS phishing FROM fx_scan_log GROUP BY 1""",
    ),
)
def stream_daily_kpis(spark, sf):
    """From the cells that the micro-batches add up, however late their rows are."""
    log = nav(spark, sf).withColumnRenamed("url", "content").withColumn("type", F.lit("url"))
    path = scratch_path(spark, "daily-cells")
    KP.write_log_cells(as_stream(spark, log), path, scratch_path(spark, "stream-cp"), **ALL).awaitTermination()
    return KP.daily_breakdown(KP.kpi_table(spark, path).totals()).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "stream_feed_refresh",
    with_duck(
        ("fx_feed_old", "fx_feed_new"),
        select="SELECT url FROM (SELECT url FROM fx_feed_old UNION SELECT url FROM fx_feed_new) WHERE contains(url, '.')",
    ),
)
def stream_feed_refresh(spark, sf):
    path, out = scratch_path(spark, "feed-in"), scratch_path(spark, "blocklist")
    for name in ("fx_feed_old", "fx_feed_new"):
        derived(spark, sf, name).repartition(2, "url").write.mode("append").text(path)
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(path)
    S.stream_feed_refresh(lines, out, scratch_path(spark, "stream-cp"), **ALL).awaitTermination()
    return S.blocklist_table(spark, out).select("url")


@query(
    "stream_scan_versions",
    with_duck(
        ("fx_scan_log", "fx_blocklist"),
        f"sv AS (SELECT id, content AS url, CAST({h("content || 'p'")} % 1000 AS DOUBLE) / 1000 AS prob FROM fx_scan_log)",
        *verdict_ctes("sv", known="(t.id % 2 = 1 OR length(b.key) % 2 = 0)"),
        select="SELECT id, norm AS content, result, risk_score FROM verdict",
    ),
)
def stream_scan_versions(spark, sf):
    """Scans of even ids run while half of the blocklist is there, the others after the rest has come."""
    scans = nav(spark, sf).withColumn("prob", (hash32(F.col("url"), "p") % 1000).cast("double") / 1000).drop("result")
    # A feed's lines need a dot as they are, so the entries are written without obfuscation.
    entries = derived(spark, sf, "fx_blocklist").select(blocklist_key(F.col("url")).alias("url")).dropna()
    entries = entries.withColumn("even", F.length("url") % 2 == 0)
    feed, source, path, out, *checkpoints = (scratch_path(spark, f"versions-{n}") for n in ("feed", "scans", "list", "log", "cp1", "cp2"))
    for half in (0, 1):
        entries.where(F.col("even") == (half == 0)).select("url").write.mode("append").text(feed)
        S.stream_feed_refresh(spark.readStream.text(feed), path, checkpoints[0], **ALL).awaitTermination()
        scans.where(F.col("id") % 2 == half).write.mode("append").parquet(source)
        S.write_scans(spark.readStream.schema(scans.schema).parquet(source), path, out, checkpoints[1], **ALL).awaitTermination()
    return spark.read.parquet(out).select("id", "content", "result", "risk_score")
