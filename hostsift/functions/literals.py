"""Fixed lists as literal arrays: parsed once instead of one call per entry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values: Sequence[str]) -> Column:
    return F.expr(f"array({', '.join(map(quoted, values))})")
