"""Set algebra over feeds and labelled tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostsift.rules import DEFAULT_RULES, RuleSet
from hostsift.sources.versions import KeyTable


def union_sources(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def feed_union(existing: DataFrame, fresh: DataFrame, url: str = "url") -> DataFrame:
    """Existing plus fresh entries; nothing is ever dropped."""
    return existing.select(url).unionByName(fresh.select(url)).distinct()


def feed_union_report(existing: DataFrame, fresh: DataFrame, url: str = "url") -> DataFrame:
    """Distinct entries in the old table, the fetch, the fetch only, and the union."""
    sides = (
        existing.select(url, F.lit(True).alias("_old"), F.lit(False).alias("_new"))
        .unionByName(fresh.select(url, F.lit(False).alias("_old"), F.lit(True).alias("_new")))
        .groupBy(url)
        .agg(F.bool_or("_old").alias("_old"), F.bool_or("_new").alias("_new"))
    )
    return sides.agg(
        F.count_if("_old").alias("existing"),
        F.count_if("_new").alias("fresh"),
        F.count_if(F.col("_new") & ~F.col("_old")).alias("new"),
        F.count(F.lit(1)).alias("union_size"),
    )


def feed_refresh(existing: DataFrame, fresh: DataFrame, version_path: str, url: str = "url") -> bool:
    """Write the union to a new version folder; no write when nothing is new."""
    if fresh.select(url).join(existing.select(url), url, "left_anti").isEmpty():
        return False
    feed_union(existing, fresh, url).write.mode("errorifexists").parquet(version_path)
    return True


def roots_except(left: DataFrame, right: DataFrame, root: str = "root") -> DataFrame:
    return left.select(root).subtract(right.select(root))


def roots_intersect_report(
    novel: DataFrame, legit_roots: DataFrame, root: str = "root", rules: RuleSet = DEFAULT_RULES
) -> DataFrame:
    """How many novel roots collide with legitimate, trusted and shared roots."""
    roots = novel.select(root).distinct()
    legit = roots.intersect(legit_roots.select(root)).withColumn("_legit", F.lit(True))
    marked = roots.join(legit, root, "left")
    return marked.agg(
        F.count(F.lit(1)).alias("novel"),
        F.count_if(F.col("_legit")).alias("in_legit"),
        F.count_if(F.col(root).isin(*rules.trusted_roots)).alias("in_trusted"),
        F.count_if(F.col(root).isin(*rules.noise_roots)).alias("in_noise"),
    )


def dedup_keep_first(df: DataFrame, order: list[str], url: str = "url") -> DataFrame:
    """One row per URL, the first in source order.

    A minimum over an ordered struct combines before the shuffle, so a URL with
    very many copies sends one row per task.
    """
    others = [c for c in df.columns if c != url and c not in order]
    first = F.min(F.struct(*order, *others)).alias("_first")
    return df.groupBy(url).agg(first).select(url, "_first.*").select(*df.columns)


def first_rows_table(spark: SparkSession, path: str, rows: DataFrame, order: list[str], url: str = "url", buckets: int = 64) -> KeyTable:
    """A table that keeps the first row of every URL while it grows; ``rows`` shows the columns."""
    others = [c for c in rows.columns if c != url and c not in order]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (url, *order, *others))
    return KeyTable(spark, path, schema, url, buckets=buckets)


def dedup_increment(table: KeyTable, rows: DataFrame, writer: str, batch: int) -> DataFrame:
    """Add the first row of every URL that the table doesn't have yet; returns all rows kept so far.

    Increments come in source order, so that what is there is earlier than what comes. The stored rows aren't moved: only new
    rows go to the buckets that they fall in. An increment that is added again changes nothing.
    """
    return table.read(version=table.add(rows, writer, batch, large=True))


def dedup_report(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows before, blank rows, distinct URLs and rows removed."""
    per_url = df.groupBy(url).agg(F.count(F.lit(1)).alias("_rows"))
    return per_url.agg(
        F.sum("_rows").alias("rows"),
        F.count(url).alias("kept"),
        (F.sum("_rows") - F.count(url)).alias("removed"),
    )


def dedup_distinct(df: DataFrame, url: str = "url") -> DataFrame:
    return df.dropDuplicates([url])
