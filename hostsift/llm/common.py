"""Small helpers of the operators of this subpackage."""

from __future__ import annotations

import gc
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def result_key(key: str, results: list[str]) -> str:
    """``key``, unless the result has a column of that name already."""
    if key.lower() in {r.lower() for r in results}:
        raise ValueError(f"{key} is the name of a result column; rename the key first")
    return key


def with_fields(df: DataFrame, made: Column, fields: list[str]) -> DataFrame:
    """``df`` plus the fields of a struct expression, which is computed once; columns of these names are replaced."""
    made_name = fresh(df, "made")
    lower = {f.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in lower]
    return df.withColumn(made_name, made).select(*[f"`{c}`" for c in kept], *[f"{made_name}.{f}" for f in fields])


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, and the others as the signs from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@contextmanager
def without_collector():
    """For work that leaves no cycles behind: looking for them in large memories takes a tenth of its time."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


class Memory(dict):
    """A bounded memory: when ``size`` entries are in, they become the old half, and the old half before is forgotten.

    Who finds something in ``old`` keeps it again, so entries that are used often stay.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def keep(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = {}  # freed before the copy is made
            self.old = dict(self)
            self.clear()
        self[key] = value

    def keep_all(self, entries: dict) -> None:
        if len(self) + len(entries) > self.size:
            self.old = {}
            self.old = dict(self)
            self.clear()
        self.update(entries)
