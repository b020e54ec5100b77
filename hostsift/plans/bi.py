"""Star schema over the scan log for dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostsift.functions.urls import csv_safe
from hostsift.operators.metrics import percent, scan_kpis
from hostsift.sources.versions import KeyTable

# Severity, display colour and order of each verdict.
RESULT_ROWS = (
    ("PHISHING", "High", "#E24B4A", 1),
    ("SUSPICIOUS", "Medium", "#EF9F27", 2),
    ("SAFE", "Low", "#639922", 3),
)
TYPE_ROWS = (("url", "URL scan"),)


def date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def fact_events(log: DataFrame) -> DataFrame:
    """One row per event; the content guarded, whole and as its first 200 characters for display."""
    return log.select(
        "id",
        date_key(F.col("ts")).alias("date_key"),
        F.hour("ts").alias("hour"),
        "type",
        "result",
        csv_safe(F.col("content")).alias("content"),
        csv_safe(F.substring("content", 1, 200)).alias("content_shown"),
        "risk_score",
        "response_time",
    )


def dim_date(log: DataFrame) -> DataFrame:
    days = log.select(F.to_date("ts").alias("day")).distinct()
    day = F.col("day")
    return days.select(
        date_key(day).alias("date_key"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.dayofmonth(day).alias("day_of_month"),
        F.date_format(day, "EEEE").alias("weekday"),
        F.weekofyear(day).alias("iso_week"),
    )


_FACT = (
    "id bigint, date_key int, hour int, type string, result string, content string, content_shown string, risk_score double, "
    "response_time double"
)
_DATE = "date_key int, year int, month int, month_name string, day_of_month int, weekday string, iso_week int"


def star_tables(spark: SparkSession, path: str, buckets: int = 64) -> tuple[KeyTable, KeyTable]:
    """The stored facts, one row per event id, and the dates they have."""
    return KeyTable(spark, f"{path}/fact_events", _FACT, "id", buckets=buckets), KeyTable(spark, f"{path}/dim_date", _DATE, "date_key", buckets=1)


def load_star(spark: SparkSession, path: str, log: DataFrame, writer: str, batch: int, buckets: int = 64) -> None:
    """Add a batch of the log to the stored star schema; only the buckets of its ids are read, nothing is built again.

    Rows may be late, and an event that is there already isn't added again. A batch that was stopped between the tables is
    completed when it is loaded again.
    """
    facts, dates = star_tables(spark, path, buckets)
    facts.add(fact_events(log), writer, batch)
    dates.add(dim_date(log), writer, batch)


def dim_type(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TYPE_ROWS), "type string, type_name string")


def dim_result(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RESULT_ROWS), "result string, severity string, colour string, sort_order int")


def dimension_usage(log: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Every row of a dimension with the number of its events, zero included."""
    used = log.groupBy(key).agg(F.count(F.lit(1)).alias("events"))
    joined = dimension.join(used, key, "left")
    return joined.withColumn("events", F.coalesce("events", F.lit(0).cast("bigint")))


def kpi_summary(log: DataFrame, as_of: Column) -> DataFrame:
    """The headline numbers plus mean risk and threats of the last seven days."""
    since = F.date_sub(F.to_date(as_of), 7).cast("timestamp")
    threat = F.col("result").isin("PHISHING", "SUSPICIOUS") & (F.col("ts") >= since)
    total = F.count(F.lit(1))
    phishing = F.count_if(F.col("result") == "PHISHING")
    return log.agg(
        total.alias("total_scans"),
        phishing.alias("phishing_count"),
        F.count_if(F.col("result") == "SUSPICIOUS").alias("suspicious_count"),
        F.count_if(F.col("result") == "SAFE").alias("safe_count"),
        F.round(percent(phishing, total), 2).alias("detection_rate"),
        F.round(F.coalesce(F.avg("response_time"), F.lit(0.0)) * 1000, 1).alias("avg_response_time_ms"),
        F.round(F.coalesce(F.avg("risk_score"), F.lit(0.0)), 2).alias("avg_risk_score"),
        F.count_if(threat).alias("threats_this_week"),
    )


__all__ = [
    "date_key", "dim_date", "dim_result", "dim_type", "dimension_usage", "fact_events", "kpi_summary", "scan_kpis",
]
