"""Corpus jobs: labelled table, training corpus, legitimate set, fresh-root harvest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsift.functions.urls import registrable_root
from hostsift.operators import augment, joins, sampling, sets
from hostsift.rules import DEFAULT_RULES, RuleSet


def labelled_corpus(sources: list[DataFrame]) -> DataFrame:
    """Union of labelled sources in priority order, blanks dropped, first label kept.

    Each source has ``url``, ``type`` and ``line_no``; its place in the list is
    its priority, so a URL in a phishing and a later legitimate source stays
    phishing.
    """
    ranked = [s.select("url", "type", F.lit(i).alias("prio"), "line_no") for i, s in enumerate(sources)]
    present = sets.union_sources(*ranked).dropna(subset=["url"])
    return sets.dedup_keep_first(present, ["prio", "line_no"]).select("url", "type")


def clean_labels(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Drop blank URLs, phishing rows on trusted roots and all rows on shared roots."""
    rooted = df.dropna(subset=["url"]).withColumn("root", registrable_root(F.col("url")))
    return joins.label_noise_shared_roots(joins.label_noise_trusted(rooted, "root", rules), "root", rules)


def training_corpus(
    base: DataFrame,
    adversarial: DataFrame,
    legit: DataFrame,
    fresh: DataFrame | None = None,
    cap: int = sampling.MAX_PER_CLASS,
    rules: RuleSet = DEFAULT_RULES,
) -> DataFrame:
    """Union, clean, balance and augment: ``url``, ``label``, ``root``, ``split``."""
    parts = [base.select("url", "type"), augment.oversample(adversarial.select("url", "type"))]
    if fresh is not None:
        parts.append(fresh.select("url", F.lit("phishing").alias("type")))
    parts.append(legit.select("url", F.lit("legitimate").alias("type")))
    cleaned = clean_labels(sets.union_sources(*parts), rules).select("url", "type")
    augmented = augment.augment_bare_pathed(sampling.balance_classes(cleaned, cap))
    return sampling.grouped_split(augmented.withColumn("root", registrable_root(F.col("url"))))


def legit_dataset(
    ranked: DataFrame,
    seeds: DataFrame,
    reports: DataFrame,
    head: int = 30_000,
    total: int = 80_000,
    seed_variants: int = 9,
    report_variants: int = 4,
) -> DataFrame:
    """Ranked domains, up-weighted seed URLs and user reports as one legitimate set."""
    popular = augment.legit_from_ranked(sampling.head_plus_tail_sample(ranked, head, total))
    curated = augment.expand_variants(seeds.select("url"), seed_variants, salt="seed")
    reported = augment.expand_variants(reports.select("url").dropna(), report_variants, salt="report")
    return sets.union_sources(popular, curated, reported).distinct().withColumn("type", F.lit("legitimate"))


def feed_roots(feeds: DataFrame, url: str = "url") -> DataFrame:
    roots = feeds.select(registrable_root(F.col(url)).alias("root")).distinct()
    return roots.filter(F.col("root").contains("."))


def harvest_fresh_roots(
    feeds: DataFrame, known: DataFrame, cap: int = 5000, rules: RuleSet = DEFAULT_RULES
) -> DataFrame:
    """New, clean phishing roots of the feeds, split into train and holdout rows."""
    roots_of = {
        kind: known.filter(F.col("type") == kind).select(registrable_root(F.col("url")).alias("root")).distinct()
        for kind in ("phishing", "legitimate")
    }
    novel = joins.novel_roots(feed_roots(feeds), roots_of["phishing"])
    return sampling.holdout_split(joins.clean_roots(novel, roots_of["legitimate"], "root", rules), cap)


def harvest_report(feeds: DataFrame, known: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Counts of the harvest: novel roots and what each filter removes."""
    phishing = known.filter(F.col("type") == "phishing").select(registrable_root(F.col("url")).alias("root"))
    legit = known.filter(F.col("type") == "legitimate").select(registrable_root(F.col("url")).alias("root"))
    return sets.roots_intersect_report(joins.novel_roots(feed_roots(feeds), phishing), legit, "root", rules)
