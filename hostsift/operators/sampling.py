"""Seeded samples and splits.

Every choice is a hash of the row's key, so results do not depend on how the
data is partitioned and survive task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostsift.functions.hashing import hash32
from hostsift.operators.selection import BUCKET_BITS, hash_top_n
from hostsift.session import staged

#: Bound on the labelled rows of a class that the classifier is fitted on.
MAX_PER_CLASS = 150_000


CLASSES = ("phishing", "legitimate")


def balance_classes(df: DataFrame, cap: int = MAX_PER_CLASS, key: str = "url", seed: str = "bal") -> DataFrame:
    """Equal numbers of phishing and legitimate rows, at most ``cap`` each: those of the smallest hashes.

    One aggregate counts the classes and the buckets that their hashes fall in; where to cut follows from it. Rows below the
    cut are then filtered, without a shuffle, and only those of the cut's own bucket are put in order.
    """
    rows = df.filter(F.col("type").isin(*CLASSES))
    place = hash32(F.col(key), seed)
    bucket = F.shiftright(place, 32 - BUCKET_BITS)
    counted = rows.groupBy("type", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()  # two histograms
    sizes = {c: sorted((r["bucket"], r["n"]) for r in counted if r["type"] == c) for c in CLASSES}
    n = min(cap, *(sum(k for _, k in buckets) for buckets in sizes.values()))
    whole, cut = F.lit(False), []
    for c, buckets in sizes.items():
        before = 0
        for at, k in buckets:
            if before + k > n:  # the first bucket that isn't taken whole
                whole = whole | ((F.col("type") == c) & (bucket < at))
                cut += [(c, at, n - before)] if n > before else []
                break
            before += k
        else:
            whole = whole | (F.col("type") == c)
    picked = rows.filter(whole)
    for c, at, left in cut:
        picked = picked.unionByName(_least(rows.filter((F.col("type") == c) & (bucket == at)), place, key, left))
    return picked


def _least(rows: DataFrame, place: Column, key: str, n: int) -> DataFrame:
    """The ``n`` rows of the smallest hashes, ties by key and the other columns; copies are counted before they are moved."""
    others = [c for c in rows.columns if c != key]
    copies = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies"))
    seen = F.sum("_copies").over(Window.orderBy(place, key, *others))  # of one bucket's distinct rows
    take = F.least("_copies", F.lit(n) - (F.col("_seen") - F.col("_copies")))
    taken = copies.withColumn("_seen", seen).withColumn("_take", take).filter("_take > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_take")))).select(*rows.columns)


def split_name(root: Column, seed: str = "split") -> Column:
    """train / calibrate / test by registrable root: 64 / 16 / 20 percent of the roots."""
    bucket = hash32(root, seed) % 1000
    return F.when(bucket < 200, "test").when(bucket < 360, "calibrate").otherwise("train")


def grouped_split(df: DataFrame, root: str = "root", seed: str = "split") -> DataFrame:
    return df.withColumn("split", split_name(F.col(root), seed))


def split_leakage(df: DataFrame, root: str = "root") -> DataFrame:
    """Roots found in more than one slice; empty for a sound split."""
    ends = df.groupBy(root).agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
    return ends.filter(F.col("first_split") != F.col("last_split"))


def holdout_split(roots: DataFrame, cap: int = 5000, root: str = "root", seed: str = "hold") -> DataFrame:
    """``http://root`` rows in ``part`` holdout (at most a fifth) or train."""
    distinct = staged(roots.select(root).distinct(), "roots")  # read four times below
    limit = distinct.agg(
        F.least(F.lit(cap).cast("bigint"), F.floor(F.count(F.lit(1)) / 5)).alias("_n")
    )
    held = hash_top_n(distinct, root, limit, (), seed).withColumn("part", F.lit("holdout"))
    rest = distinct.join(held.select(root), root, "left_anti").withColumn("part", F.lit("train"))
    both = held.unionByName(rest)
    return both.select(F.concat(F.lit("http://"), root).alias("url"), F.lit("phishing").alias("type"), "part")


def head_plus_tail_sample(
    ranked: DataFrame, head: int = 30_000, total: int = 80_000, seed: str = "tail"
) -> DataFrame:
    """All of the first ``head`` ranks plus a seeded sample of the rest up to ``total``."""
    top = ranked.filter(F.col("rank") <= head)
    tail = hash_top_n(ranked.filter(F.col("rank") > head), "domain", max(0, total - head), (), seed)
    return top.unionByName(tail)


def one_per_root_sample(df: DataFrame, kind: str, n: int = 100, seed: str = "probe") -> DataFrame:
    """One URL for each of n registrable roots of a class.  Reads url, host, root, type."""
    rows = df.filter((F.col("type") == kind) & F.col("host").contains("."))
    first = rows.groupBy("root").agg(F.min(F.struct(hash32(F.col("url"), seed).alias("_h"), "url", "host")).alias("_f"))
    ranked = first.select("root", "_f.url", "_f.host", hash32(F.col("root"), seed).alias("_r"))
    return ranked.orderBy("_r", "root").limit(n).drop("_r")


def sample_per_source(df: DataFrame, n: int = 4000, key: str = "url", seed: str = "src") -> DataFrame:
    """Up to n rows of each (source, class)."""
    return hash_top_n(df, key, n, ["source", "type"], seed)
