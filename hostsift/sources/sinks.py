"""Writers: labelled tables, the scan log and false-positive reports.

Tables partitioned by day are written behind a ``rebalance`` hint, so AQE sizes
the files and splits a day that holds most of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsift.functions.numbers import round_score
from hostsift.functions.urls import csv_safe, normalize_url, parse_host


#: Characters of a URL that displays of the log show.
SHOWN = 500


def write_labelled_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.select("url", "type").write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def scan_log_rows(verdicts: DataFrame, ts: str = "ts") -> DataFrame:
    """Log rows of verdicts: the whole URL, its first 500 characters for display, scores to four decimals."""
    return verdicts.select(
        F.col("id").cast("bigint").alias("id"),
        F.lit("url").alias("type"),
        F.col("input").alias("content"),
        F.substring("input", 1, SHOWN).alias("content_shown"),
        "result",
        round_score(F.col("risk_score"), 4).alias("risk_score"),
        round_score(F.col("response_time"), 4).alias("response_time"),
        F.col(ts).alias("ts"),
        F.to_date(ts).alias("event_date"),
    )


def append_scan_log(verdicts: DataFrame, path: str, ts: str = "ts") -> None:
    rows = scan_log_rows(verdicts, ts).hint("rebalance", "event_date")
    rows.write.mode("append").partitionBy("event_date").parquet(path)


def fp_report_rows(reports: DataFrame, reported: str = "reported") -> DataFrame:
    """User reports as guarded cells: URL normalised, its host added, label legitimate."""
    url = normalize_url(F.col("url"))
    return reports.withColumn("_url", url).select(
        csv_safe(F.col("_url")).alias("url"),
        F.lit("legitimate").alias("type"),
        csv_safe(parse_host(F.col("_url"))).alias("domain"),
        csv_safe(F.col("reason")).alias("reason"),
        F.date_format(reported, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("reported"),
    )


def append_fp_reports(reports: DataFrame, path: str, reported: str = "reported") -> None:
    fp_report_rows(reports, reported).write.mode("append").parquet(path)
