"""Joins of URL tables with blocklists, allowlists, known roots and metadata.

Fixed rule lists are ``IN`` sets, not joins.  Lists that can grow carry no
broadcast hint: Spark broadcasts them when their measured size allows, and
otherwise shuffles with AQE splitting skewed keys of the (outer, semi, anti)
streamed side.  The list side is always distinct on the key first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostsift.functions import brands as B
from hostsift.functions.urls import label_count, normalize_url, registrable_root, registrable_root_of_host, strip_www
from hostsift.rules import DEFAULT_RULES, RuleSet


def existence_flag(df: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """Add a boolean: does the value of ``on`` occur in the one-column table ``keys``?"""
    known = keys.select(on).filter(F.col(on).isNotNull()).distinct().withColumn("_hit", F.lit(True))
    return df.join(known, on, "left").withColumn(flag, F.col("_hit").isNotNull()).drop("_hit")


def blocklist_key(url: Column) -> Column:
    """What a URL is looked up by: normalised, without trailing slashes; NULL for entries without a dot."""
    entry = normalize_url(url)
    return F.when(entry.contains("."), F.regexp_replace(entry, "/+$", ""))


def blocklist_keys(blocklist: DataFrame, url: str = "url") -> DataFrame:
    """Normalised entries without trailing slashes; entries without a dot are ignored."""
    return blocklist.select(blocklist_key(F.col(url)).alias("_key")).dropna().distinct()


def blocklist_match(df: DataFrame, blocklist: DataFrame, norm: str = "norm") -> DataFrame:
    """Exact match of normalised URLs, trailing slashes ignored; never by root."""
    keyed = df.withColumn("_key", F.regexp_replace(norm, "/+$", ""))
    return existence_flag(keyed, blocklist_keys(blocklist), "_key", "blocklisted").drop("_key")


def allowlist_match(
    df: DataFrame, root: str = "root", rules: RuleSet = DEFAULT_RULES, allowed: DataFrame | None = None
) -> DataFrame:
    """Add ``trusted``: is the root in the rule set, or in ``allowed``, a table of roots of any size?"""
    if allowed is not None:
        return existence_flag(df, allowed.select(F.col(allowed.columns[0]).alias(root)), root, "trusted")
    return df.withColumn("trusted", F.coalesce(F.col(root).isin(*rules.trusted_roots), F.lit(False)))


def shared_host_join(hosts: DataFrame, roots: DataFrame, host: str = "host", root: str = "root") -> DataFrame:
    """(host, root) for hosts at or under a platform root, for a root table of any size.

    Works on distinct hosts; each offers its label suffixes as equi-join keys.
    """
    bare = hosts.select(strip_www(F.col(host)).alias(host)).filter(F.col(host) != "").distinct()
    suffixes = F.transform(F.sequence(F.lit(1), label_count(F.col(host))), lambda i: F.array_join(
        F.slice(F.split(F.col(host), r"\."), -i, i), "."))
    return (
        bare.withColumn(root, F.explode(suffixes))
        .join(roots.select(root).distinct(), root)
        .select(host, root)
    )


def brand_fuzzy_join(df: DataFrame, host: str = "f_host", rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Distinct (piece, brand, similarity) above the ratio.

    The brand side is a literal array probed inside the row; pieces are made
    distinct first, so a hot host is compared once.
    """
    pieces = df.select(F.explode(B.host_pieces(F.col(host), F.col("host_skeleton"))).alias("piece")).distinct()
    hits = F.explode(B.brand_hits(F.array("piece"), rules)).alias("hit")
    return pieces.select(hits).select("hit.piece", "hit.brand", "hit.similarity")


def novel_roots(feed_roots: DataFrame, known_roots: DataFrame, root: str = "root") -> DataFrame:
    return feed_roots.select(root).distinct().join(known_roots.select(root).distinct(), root, "left_anti")


def clean_roots(
    novel: DataFrame, legit_roots: DataFrame, root: str = "root", rules: RuleSet = DEFAULT_RULES
) -> DataFrame:
    """Novel roots that are neither legitimate, trusted nor shared by many owners."""
    listed = set(rules.trusted_roots) | set(rules.noise_roots)
    candidates = novel.select(root).distinct().filter(~F.col(root).isin(*sorted(listed)))
    return candidates.join(legit_roots.select(root).distinct(), root, "left_anti")


def label_noise_trusted(df: DataFrame, root: str = "root", rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """A trusted root is never a phishing example, whatever path a feed attached."""
    return df.filter((F.col("type") != "phishing") | ~F.col(root).isin(*rules.trusted_roots))


def label_noise_shared_roots(df: DataFrame, root: str = "root", rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Shortener and free-hosting roots say nothing about their tenants: drop both classes."""
    return df.filter(~F.col(root).isin(*rules.noise_roots))


def contested_roots(df: DataFrame, root: str = "root") -> DataFrame:
    """Roots seen with both labels, with their row counts per class."""
    return (
        df.groupBy(root)
        .agg(
            F.count_if(F.col("type") == "phishing").alias("phishing_rows"),
            F.count_if(F.col("type") == "legitimate").alias("legit_rows"),
        )
        .filter((F.col("phishing_rows") > 0) & (F.col("legit_rows") > 0))
    )


def label_noise_contested_roots(df: DataFrame, root: str = "root") -> DataFrame:
    """Optional: drop phishing rows on contested roots (off in the default corpus)."""
    contested = contested_roots(df, root).select(root)
    marked = existence_flag(df, contested, root, "_contested")
    return marked.filter((F.col("type") != "phishing") | ~F.col("_contested")).drop("_contested")


def novelty_flag(df: DataFrame, known_roots: DataFrame, root: str = "root") -> DataFrame:
    """Add ``novel``: the row's root was not in training."""
    flagged = existence_flag(df, known_roots, root, "_known")
    return flagged.withColumn("novel", ~F.col("_known")).drop("_known")


def domain_meta_enrich(
    scans: DataFrame,
    meta: DataFrame,
    domain: str = "domain",
    ts: str = "ts",
    ttl_seconds: int = DEFAULT_RULES.meta_cache_ttl_sec,
    heavy: int = 1_000_000,
) -> DataFrame:
    """As-of join: the newest metadata of the domain less than the TTL before each scan.

    Scans and lookups are merged and ordered inside (domain, TTL-wide time
    slot), so no pairs are formed; a lookup is copied into its own slot and the
    next.  Where more than ``heavy`` scans of a domain fall into a slot, as a
    count of scans by domain and slot tells, they are dealt over as many salts
    as it takes, and only these lookups are copied more often.  Misses give age
    -1 and no TLS.
    """
    slot = F.floor(F.unix_seconds(F.col("_at")) / ttl_seconds)
    payload = [c for c in meta.columns if c not in (domain, "checked_at")]
    left = scans.withColumn("_at", F.col(ts).cast("timestamp")).withColumn("_slot", slot).withColumn("_scan", F.lit(1))
    crowded = left.groupBy(domain, "_slot").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > heavy)
    # At most a line for every `heavy` scans.
    lines = crowded.select(domain, "_slot", F.ceil(F.col("_n") / heavy).cast("int").alias("_salts"))
    limits = left.sparkSession.createDataFrame(lines.collect(), lines.schema)
    left = left.join(limits, [domain, "_slot"], "left").withColumn(
        "_salt", F.pmod(F.xxhash64(ts, F.monotonically_increasing_id()), F.coalesce("_salts", F.lit(1))).cast("int")
    )
    right = (
        meta.withColumn("_at", F.col("checked_at").cast("timestamp"))
        .select(domain, "_at", F.struct(F.col("_at").alias("checked"), *payload).alias("_meta"), slot.alias("_slot"))
        .withColumn("_slot", F.explode(F.array(F.col("_slot"), F.col("_slot") + 1)))
        .join(limits, [domain, "_slot"], "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .withColumn("_scan", F.lit(0))
    )
    ordered = (
        Window.partitionBy(domain, "_slot", "_salt")
        .orderBy("_at", "_scan", "_meta")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    merged = left.unionByName(right, allowMissingColumns=True)
    seen = merged.withColumn("_last", F.last("_meta", ignorenulls=True).over(ordered)).filter("_scan = 1")
    fresh = F.col("_last.checked") > F.col("_at") - F.make_dt_interval(secs=F.lit(ttl_seconds))
    found = {name: F.when(fresh, F.col(f"_last.{name}")) for name in payload}
    if "age_days" in found:
        found["age_days"] = F.coalesce(found["age_days"], F.lit(-1))
    if "ssl_valid" in found:
        found["ssl_valid"] = F.coalesce(found["ssl_valid"], F.lit(False))
    return seen.withColumns(found).drop("_at", "_slot", "_salt", "_salts", "_scan", "_meta", "_last")
