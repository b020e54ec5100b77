"""Readers for line feeds, keyed CSV feeds, ranked lists and labelled tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostsift.functions.urls import py_strip
from hostsift.session import path_is_missing

LABELLED = T.StructType([T.StructField("url", T.StringType()), T.StructField("type", T.StringType())])
RANKED = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("domain", T.StringType())])
FP_REPORT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("url", "type", "domain", "reason")]
    + [T.StructField("reported", T.StringType())]
)


def feed_entry(line: Column, lower: bool = False) -> Column:
    """Cleaned feed line; NULL for blanks, ``#`` comments and lines without a dot."""
    entry = py_strip(F.lower(line) if lower else line)
    return F.when(~entry.startswith("#") & entry.contains("."), entry)


def read_line_feed(spark: SparkSession, path: str | list[str], lower: bool = False) -> DataFrame:
    """One URL or domain per line."""
    lines = spark.read.text(path)
    return lines.select(feed_entry(F.col("value"), lower).alias("url")).dropna()


def _read_headed_csv(spark: SparkSession, path: str) -> DataFrame:
    # Only the header is looked at; every column stays a string, nothing is inferred.
    return spark.read.csv(path, header=True, inferSchema=False, escape='"', enforceSchema=False)


def read_keyed_feed(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a ``url`` column in any case; without one, the second column."""
    table = _read_headed_csv(spark, path)
    named = [c for c in table.columns if c.strip().lower() == "url"]
    column = named[0] if named else table.columns[1]
    url = py_strip(table[f"`{column}`"])
    return table.select(url.alias("url")).filter(F.col("url") != "")


def read_ranked_domains(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RANKED).csv(path)


def label_to_type(label: Column) -> Column:
    positive = F.lower(label.cast("string")).isin("1", "bad", "phishing")
    return F.when(positive, F.lit("phishing")).otherwise(F.lit("legitimate"))


def read_mixed_labelled(spark: SparkSession, path: str) -> DataFrame:
    """CSV with ``url`` and ``type``, or ``url`` and a 0/1/good/bad ``label``."""
    table = _read_headed_csv(spark, path)
    table = table.toDF(*[c.lower() for c in table.columns])
    kind = F.col("type") if "type" in table.columns else label_to_type(F.col("label"))
    return table.select("url", kind.alias("type"))


def read_feed_glob(spark: SparkSession, primary: str, extra_glob: str, lower: bool = True) -> DataFrame:
    """Primary feed plus drop-in files, with the path of the file of each entry."""
    found = []
    for path in (primary, extra_glob):
        try:
            found.append(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("feed_file")))
        except AnalysisException as error:
            if not path_is_missing(error):
                raise
    if not found:
        raise FileNotFoundError(f"no feed file at {primary} or {extra_glob}")
    lines = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return lines.select(feed_entry(F.col("value"), lower).alias("url"), "feed_file").dropna(subset=["url"])


def feed_line_counts(feeds: DataFrame) -> DataFrame:
    """Entries of each file."""
    return feeds.groupBy("feed_file").agg(F.count(F.lit(1)).alias("entries"))


def optional_source(spark: SparkSession, reader: Callable[[], DataFrame], schema: T.StructType = LABELLED) -> DataFrame:
    """The table a reader gives, or an empty one of the same schema if its path is missing; other faults are raised."""
    try:
        return reader()
    except AnalysisException as error:
        if not path_is_missing(error):
            raise
        return spark.createDataFrame([], schema)


def read_pruned_phishing_urls(spark: SparkSession, path: str) -> DataFrame:
    """Phishing URLs of a labelled Parquet table; filter and projection reach the scan."""
    table = spark.read.schema(LABELLED).parquet(path)
    return table.filter((F.col("type") == "phishing") & F.col("url").isNotNull()).select("url")


def read_fp_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reported false positives as legitimate examples."""
    reports = spark.read.schema(FP_REPORT).parquet(path)
    return reports.filter(F.col("url").isNotNull()).select("url", F.lit("legitimate").alias("type"))
