"""Relational operators: rules, joins, set algebra, metrics, sampling."""
