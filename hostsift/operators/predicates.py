"""Filters and rule predicates over URL tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostsift.functions import brands as B
from hostsift.functions.urls import host_is_ip
from hostsift.rules import DEFAULT_RULES, RuleSet

INTERNAL_PAGE = r"^(chrome|chrome-extension|file)://|^(about|data):"


def typo_squat(df: DataFrame, host: str = "host", rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add ``typo_brand``: the first brand one edit away from the host's first label."""
    return df.withColumn("typo_brand", B.typo_brand(F.col(host), rules))


def brand_in_subdomain(df: DataFrame, url: str = "url", rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    return df.withColumn("sub_brand", B.subdomain_brand(F.col(url), rules))


def brand_in_domain(df: DataFrame, host: str = "host", rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    return df.withColumn("brand_flag", B.brand_in_domain(host, rules))


def shared_hosting(df: DataFrame, host: str = "host", rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    return df.withColumn("shared_host", B.on_shared_hosting(host, rules))


def keyword_gate(url: str, prob: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Keywords only corroborate a model that already leans to phishing."""
    return (prob >= rules.keyword_min_prob) & B.any_keyword(f"lower({url})", rules)


def structural_override(host: Column) -> Column:
    """Certain on its own: raw IP host, '@' in the authority, or a corroborated brand spoof.

    Reads the named feature columns of ``with_features``.
    """
    corroborated = (
        (F.col("brand_with_keyword") == 1)
        | (F.col("suspicious_tld") == 1)
        | (F.col("punycode") == 1)
        | (F.col("non_ascii_host") == 1)
    )
    return host_is_ip(host) | (F.col("authority_at") == 1) | ((F.col("brand_spoof") == 1) & corroborated)


def drop_null_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.dropna(subset=[url])


def drop_malformed_hosts(df: DataFrame, bare: str = "bare") -> DataFrame:
    """Keep rows whose ``scheme://host`` has a dot in the host."""
    return df.filter(F.substring_index(bare, "//", -1).contains("."))


def skip_internal_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Drop browser-internal pages and missing URLs from a navigation table."""
    return df.filter(F.col(url).isNotNull() & (F.col(url) != "") & ~F.col(url).rlike(INTERNAL_PAGE))


def validate_rules(spark: SparkSession, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """One row per broken rule-set invariant; an empty table is a valid rule set."""
    orphans = sorted(set(rules.shared_hosting_roots) - set(rules.trusted_roots))
    problems = [("shared_host_not_trusted", root) for root in orphans]
    if not 0 < rules.ml_safe_threshold < rules.keyword_min_prob < rules.ml_decision_threshold <= 1:
        problems.append(("threshold_order", "0 < safe < keyword gate < decision <= 1"))
    if not rules.t_suspicious < rules.t_phishing:
        problems.append(("verdict_order", "suspicious < phishing"))
    return spark.createDataFrame(problems, "problem string, detail string")


def threshold_order(scored: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Each threshold and the next one up: whether they are in order, and how many scores lie from one up to the other.

    Between thresholds that aren't in order no score lies: these are the rows that a rule of the ladder would never see.
    """
    marks = [
        ("zero", 0.0), ("safe", rules.ml_safe_threshold), ("keyword", rules.keyword_min_prob), ("decision", rules.ml_decision_threshold),
        ("one", 1.0),
    ]
    pairs = list(zip(marks, marks[1:]))
    counts = [F.count_if((F.col("prob") >= a) & (F.col("prob") < b)).alias(f"n{i}") for i, ((_, a), (_, b)) in enumerate(pairs)]
    lines = [
        F.struct(
            F.lit(low).alias("lower"), F.lit(high).alias("upper"), F.lit(a < b or (high == "one" and a <= b)).alias("in_order"),
            F.col(f"n{i}").alias("scores"),
        )
        for i, ((low, a), (high, b)) in enumerate(pairs)
    ]
    return scored.agg(*counts).select(F.explode(F.array(*lines)).alias("line")).select("line.*")


def orphan_shared_roots(shared: DataFrame, trusted: DataFrame, root: str = "root") -> DataFrame:
    """The subset check on tables: shared-hosting roots missing from the allowlist."""
    return shared.select(root).distinct().join(trusted.select(root).distinct(), root, "left_anti")
