"""Ordered reports: the limit is the feature, so each is a distributed top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsift.rules import DEFAULT_RULES


def clamp_limit(limit: object, default: int = 20, maximum: int = DEFAULT_RULES.recent_max_limit) -> int:
    """Page size between 1 and the maximum; anything non-numeric gives the default."""
    try:
        return max(1, min(int(limit), maximum))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default


def recent_events(log: DataFrame, limit: object = 20) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(clamp_limit(limit))


def worst_offenders(df: DataFrame, n: int = 15, threshold: float = 0.6) -> DataFrame:
    """Legitimate rows with the highest scores above the threshold."""
    wrong = df.filter((F.col("label") == 0) & (F.col("prob") > threshold))
    return wrong.orderBy(F.desc("prob"), "url", "url_id").limit(n)


def lost_examples(df: DataFrame, n: int = 12) -> DataFrame:
    """Phishing rows flagged under the old rule and safe under the new one, by score."""
    lost = df.filter((F.col("label") == 1) & F.col("flagged_before") & ~F.col("flagged_after"))
    return lost.orderBy(F.desc("prob"), "url", "url_id").limit(n)


def verdict_cache_topn(verdicts: DataFrame, n: int = 200, url: str = "url", ts: str = "ts") -> DataFrame:
    """The newest verdict of each URL, then the newest n of those."""
    others = [c for c in verdicts.columns if c not in (url, ts)]
    newest = verdicts.groupBy(url).agg(F.max(F.struct(ts, *others)).alias("_v"))
    return newest.select(url, "_v.*").orderBy(F.desc(ts), url).limit(n)
