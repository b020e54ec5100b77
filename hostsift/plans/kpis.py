"""Scan KPIs and model reports from partial results that are stored per day and source.

A batch of log rows or of scored rows is reduced to a few cells: counts and times by type and verdict, the most flagged URLs, score
counts on the threshold grid, and a quantile sketch. Cells of equal name are added up, so any set of batches can be merged, a batch
is counted once however often it is written, and a report reads cells instead of events.

Counts, rates, thresholds and operating points are exact. A URL's count is a lower bound, short by at most what its column
``missing`` says (0 unless a task met more than ``CAPACITY`` flagged URLs); percentiles have a rank within ``RANK_ERROR`` of the one
asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostsift.operators import metrics as M
from hostsift.plans.vocabulary import CAPACITY, summaries
from hostsift.sources.versions import SumTable

SCHEMA = "day string, source string, kind string, cell string, n long, total double, sketch binary"
#: Size of the quantile sketch, and the error of its ranks in 99 of 100 cases.
SKETCH, RANK_ERROR = 4000, 0.002


def combine(cells: DataFrame) -> DataFrame:
    """Cells of one name become one."""
    by = ["day", "source", "kind", "cell"]
    sums = cells.where("sketch IS NULL").groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    sketches = cells.where("sketch IS NOT NULL").groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", SKETCH).alias("sketch")
    )
    return sums.withColumn("sketch", F.lit(None).cast("binary")).unionByName(sketches)


def kpi_table(spark: SparkSession, path: str) -> SumTable:
    return SumTable(spark, path, SCHEMA, "cell", combine)


def _cells(df: DataFrame, kind: str, cell: Column, n: Column, total: Column | None = None, sketch: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        "day", "source", F.lit(kind).alias("kind"), cell.alias("cell"), n.cast("bigint").alias("n"),
        (none if total is None else total).cast("double").alias("total"), (none if sketch is None else sketch).cast("binary").alias("sketch"),
    )


def _pair(a: str, b: str) -> Column:
    return F.concat_ws("|", F.coalesce(F.col(a).cast("string"), F.lit("")), F.coalesce(F.col(b).cast("string"), F.lit("")))


def log_cells(log: DataFrame, source: str = "", capacity: int = CAPACITY) -> DataFrame:
    """Cells of log rows (``ts``, ``type``, ``result``, ``response_time``, ``content``)."""
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = log.select(day.alias("day"), F.lit(source).alias("source"), "type", "result", "response_time", "content")
    counted = rows.groupBy("day", "source", "type", "result").agg(
        F.count(F.lit(1)).alias("n"), F.sum("response_time").alias("time"), F.count("response_time").alias("timed")
    )
    flagged = rows.where(F.col("result").isin("PHISHING", "SUSPICIOUS") & (F.col("type") == "url"))
    urls = summaries(flagged.select(F.array("content").alias("urls")), "urls", capacity)
    urls = urls.select(F.lit("").alias("day"), F.lit(source).alias("source"), "term", "low")
    return (
        _cells(counted, "scans", _pair("type", "result"), F.col("n"), F.col("time"))
        .unionByName(_cells(counted, "timed", _pair("type", "result"), F.col("timed")))
        .unionByName(_cells(urls.where("term IS NOT NULL"), "flagged", F.col("term"), F.col("low")))
        .unionByName(_cells(urls.where("term IS NULL AND low > 0"), "missing", F.lit(""), F.col("low")))
    )


def score_cells(scored: DataFrame, source: Column | None = None, day: Column | None = None) -> DataFrame:
    """Cells of scored rows (``label``, ``prob``)."""
    rows = scored.select(
        (F.lit("") if day is None else day).alias("day"), (F.lit("") if source is None else source).alias("source"), "label", "prob",
        M.grid_bucket(F.col("prob")).alias("bucket"),
    )
    counted = rows.groupBy("day", "source", "label", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sketched = rows.groupBy("day", "source", "label").agg(
        F.count("prob").alias("n"), F.sum("prob").alias("sum"), F.kll_sketch_agg_double("prob", F.lit(SKETCH)).alias("sketch")
    )
    return _cells(counted, "scores", _pair("label", "bucket"), F.col("n")).unionByName(
        _cells(sketched, "quantiles", F.col("label").cast("string"), F.col("n"), F.col("sum"), F.col("sketch"))
    )


def write_log_cells(log: DataFrame, path: str, checkpoint: str, source: str = "", **trigger) -> StreamingQuery:
    """Add every micro-batch of a stream of log rows under its batch id."""

    def put(batch: DataFrame, batch_id: int) -> None:
        kpi_table(batch.sparkSession, path).add(log_cells(batch, source), f"log {source}", batch_id)

    return log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()


# --- reports from the cells


def _of(cells: DataFrame, kind: str) -> DataFrame:
    parts = F.split("cell", r"\|")
    return cells.where(F.col("kind") == kind).withColumns({"_1": parts[0], "_2": F.get(parts, F.lit(1))})


def scan_kpis(cells: DataFrame) -> DataFrame:
    """As :func:`metrics.scan_kpis` of all rows."""

    def total(kind: str, more: Column | None = None, column: str = "n") -> Column:
        which = F.col("kind") == kind
        return F.coalesce(F.sum(F.when(which if more is None else which & more, F.col(column))), F.lit(0))

    result = F.col("_2")
    count, phishing = total("scans"), total("scans", result == "PHISHING")
    mean = F.coalesce(F.try_divide(total("scans", None, "total"), total("timed")), F.lit(0.0))
    return _of(cells, "scans").unionByName(_of(cells, "timed")).agg(
        count.alias("total_scans"), phishing.alias("phishing_count"), total("scans", result == "SUSPICIOUS").alias("suspicious_count"),
        total("scans", result == "SAFE").alias("safe_count"), total("scans", F.col("_1") == "url").alias("url_scans"),
        F.round(M.percent(phishing, count), 2).alias("detection_rate"), F.round(mean * 1000, 1).alias("avg_response_time_ms"),
    )


def daily_breakdown(cells: DataFrame, as_of: Column | None = None, days: int = 7) -> DataFrame:
    """As :func:`metrics.daily_breakdown`; without ``as_of`` all days."""
    rows = _of(cells, "scans").where("day <> ''")
    if as_of is not None:
        rows = rows.where(F.col("day") >= F.date_format(F.date_sub(F.to_date(as_of), days), "yyyy-MM-dd"))
    phishing = F.sum(F.when(F.col("_2") == "PHISHING", F.col("n")).otherwise(0)).alias("phishing")
    return rows.groupBy(F.to_date("day").alias("day")).agg(F.sum("n").alias("total"), phishing)


def top_threats(cells: DataFrame, n: int = 10) -> DataFrame:
    """Most flagged URLs, the least number of times each was flagged, and how many more it can be."""
    urls = cells.where("kind = 'flagged'").groupBy(F.col("cell").alias("content")).agg(F.sum("n").alias("cnt"))
    short = cells.where("kind = 'missing'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("missing"))
    return urls.orderBy(F.desc("cnt"), "content").limit(n).crossJoin(short)  # one row


def _rates(cells: DataFrame) -> DataFrame:
    counted = _of(cells, "scores").select(
        F.col("_2").cast("int").alias("_bucket"), F.when(F.col("_1") == "0", F.col("n")).otherwise(0).alias("_l"),
        F.when(F.col("_1") == "1", F.col("n")).otherwise(0).alias("_p"),
    )
    return M.rates_of_buckets(counted)


def operating_point(cells: DataFrame, max_fp_pct: float = 9.70) -> DataFrame:
    return M.operating_point_of(_rates(cells), max_fp_pct)


def threshold_sweep(cells: DataFrame, thresholds: Sequence[float] = M.SWEEP_THRESHOLDS) -> DataFrame:
    """As :func:`metrics.threshold_sweep`, for thresholds on the grid."""
    milli = [round(1000 * t) for t in thresholds]
    if any(m % M.GRID_STEP or not M.GRID_START <= m <= M.GRID_STOP for m in milli):
        raise ValueError("the thresholds have to lie on the grid")
    return _rates(cells).where(F.col("threshold_milli").isin(milli)).select(
        (F.col("threshold_milli") / 1000).alias("threshold"), F.round("fp_pct", 4).alias("fp_pct"), F.round("recall_pct", 4).alias("recall_pct")
    )


def percentiles(cells: DataFrame, quantiles: Sequence[float] = M.PERCENTILES) -> DataFrame:
    """``q`` and ``value`` of all scores."""
    whole = cells.where("kind = 'quantiles'").agg(F.kll_merge_agg_double("sketch", SKETCH).alias("sketch")).where("sketch IS NOT NULL")
    lines = [
        F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("value")) for q in quantiles
    ]
    return whole.select(F.explode(F.array(*lines)).alias("line")).select("line.*")
