"""URL-risk analytics as Spark jobs: feeds, features, corpora, models, verdicts, KPIs."""

from hostsift.rules import DEFAULT_RULES, RuleSet

__all__ = ["DEFAULT_RULES", "RuleSet"]
