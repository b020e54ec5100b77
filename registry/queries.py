"""All registered queries."""

from registry import q_corpus, q_models, q_streams, q_tables, q_urls, q_verdicts  # noqa: F401
from registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
