"""Homograph folding: punycode decoding and the ASCII skeleton of a host.

Spark has no punycode or NFKD function, so this is the library's one Python
function.  It is Arrow-batched and sees only hosts that need it: every plain
ASCII host goes in as NULL and its answer is filled in on the JVM side, and a
host that comes again in a batch is folded once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostsift.rules import CONFUSABLES

NEEDS_DECODING = r"xn--|[^\x00-\x7F]"


def _skeleton_udf():
    confusables = dict(CONFUSABLES)

    @F.pandas_udf("struct<skeleton string, non_ascii boolean>")
    def fold(hosts: pd.Series) -> pd.DataFrame:
        import unicodedata

        def decode(label: str) -> str:
            try:
                return label[4:].encode("ascii").decode("punycode") if label.startswith("xn--") else label
            except (UnicodeError, ValueError):
                return label

        def skeleton(host: str) -> tuple[str, bool]:
            shown = ".".join(map(decode, host.split(".")))
            folded = unicodedata.normalize("NFKD", shown)
            ascii_only = "".join(confusables.get(ch, ch if ch.isascii() else "") for ch in folded)
            return ascii_only, not shown.isascii()

        folded = {h: skeleton(h) for h in hosts.dropna().unique()}
        return pd.DataFrame(
            {"skeleton": hosts.map({h: s for h, (s, _) in folded.items()}), "non_ascii": hosts.map({h: n for h, (_, n) in folded.items()})},
            dtype=object,
        )

    return fold


def with_idn(df: DataFrame, host: str = "host") -> DataFrame:
    """Add ``host_skeleton`` and ``host_non_ascii``; plain ASCII hosts pass through."""
    rare = F.col(host).rlike(NEEDS_DECODING)
    return (
        df.withColumn("_idn", _skeleton_udf()(F.when(rare, F.col(host))))
        .withColumn("host_skeleton", F.coalesce(F.col("_idn.skeleton"), F.col(host)))
        .withColumn("host_non_ascii", F.coalesce(F.col("_idn.non_ascii"), F.lit(False)))
        .drop("_idn")
    )


def idn_skeleton(df: DataFrame, host: str = "host") -> DataFrame:
    """Add ``skeleton``, the de-confused ASCII form of the host."""
    return with_idn(df, host).withColumnRenamed("host_skeleton", "skeleton").drop("host_non_ascii")
