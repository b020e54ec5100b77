"""Metadata as of the scan, for streams of scans and lookups that arrive in any order.

A scan has to wait until no lookup from before it can come any more: until the watermark has passed it. So scans and lookups
wait in state; an event-time timer releases those that the watermark has passed, in the order of their times, and each scan gets
the newest lookup at or before it that is younger than the TTL. A lookup leaves the state once every scan still to come is a TTL
younger, so a domain that nobody scans any more has no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hostsift.functions.urls import normalize_url, parse_host
from hostsift.streaming.state import packed, unpacked, use_state_store
from hostsift.streaming.waiting import Waiting, loaded, stored

_SCAN, _LOOKUP, _TICK = 1, 0, 2
_RELEASED = "payload string, age_days int, ssl_valid boolean"
_ROWS = pa.schema({
    "at_us": pa.int64(), "kind": pa.int32(), "domain": pa.string(), "payload": pa.string(), "age_days": pa.int32(), "ssl_valid": pa.bool_(),
})
_NEWEST = pa.schema({"domain": pa.string(), "at_us": pa.int64(), "age_days": pa.int32(), "ssl_valid": pa.bool_()})


def newest_before(lookups: np.ndarray, scans: np.ndarray, ttl: int) -> np.ndarray:
    """For each scan the place of the newest of the ascending lookups at or before it and less than a TTL old; else -1."""
    at = np.searchsorted(lookups, scans, side="right") - 1
    known = at >= 0
    known[known] = lookups[at[known]] > scans[known] - ttl
    return np.where(known, at, -1)


class AsOf(StatefulProcessor):
    """State of a part of the domains: scans and lookups that wait, and each domain's newest lookup of those that don't."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = Waiting(handle, _ROWS, ("at_us", "kind", "age_days", "ssl_valid"))
        self.newest = handle.getValueState("newest", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.waiting.add(frame.loc[frame["kind"] != _TICK, _ROWS.names] for frame in rows)
        self.waiting.timer.sooner(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.waiting.timer.expired()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known = loaded(self.newest.get()[0]).to_pydict() if self.newest.exists() else {c: [] for c in _NEWEST.names}
        newest = {d: x for d, *x in zip(*known.values(), strict=True)}
        for table in self.waiting.due(passed):
            found, at = {"payload": [], "age_days": [], "ssl_valid": []}, passed
            for at, kind, domain, payload, age, tls in zip(*(table[c].to_pylist() for c in _ROWS.names), strict=True):
                if kind == _LOOKUP:
                    newest[domain] = [at, age, tls]
                else:
                    seen = newest.get(domain)
                    _, age, tls = seen if seen and seen[0] > at - self.ttl else (0, -1, False)
                    for column, value in zip(found.values(), (payload, age, tls), strict=True):
                        column.append(value)
            if found["payload"]:
                yield pd.DataFrame(found).astype({"payload": object, "age_days": np.int32, "ssl_valid": bool})
            newest = {d: x for d, x in newest.items() if x[0] > at - self.ttl}
        newest = {d: x for d, x in newest.items() if x[0] > passed - self.ttl}
        if newest:
            self.newest.update((stored(pa.table([list(newest), *zip(*newest.values(), strict=True)], schema=_NEWEST)),))
        else:
            self.newest.clear()
        first = self.waiting.first()
        self.waiting.timer.set(min((x[0] + self.ttl for x in newest.values()), default=None) if first is None else first)


def with_metadata_as_of(
    scans: DataFrame, lookups: DataFrame, ttl_seconds: int, lateness: str, url: str = "url", ts: str = "ts", salts: int = 8, parts: int = 32,
) -> DataFrame:
    """``scans`` plus ``age_days`` and ``ssl_valid`` of the domain's newest lookup at or before each scan, TTL not reached.

    Both are streams; ``lookups`` has ``domain``, ``checked_at``, ``age_days`` and ``ssl_valid``. A scan comes out when the newest
    time of either stream is ``lateness`` past it; rows that arrive later than that are dropped, and the query's progress counts
    them. Misses, and unknown ages or TLS states, give age -1 and no TLS. A lookup without a domain only moves the time on,
    as a source's heartbeat does while nothing else arrives. Of lookups of one time the one of the larger age, then with TLS, counts.

    Domains are dealt over ``parts`` states, and each part's scans over ``salts``, each of which has all its lookups, so a domain
    with a large share of the scans is the work of several tasks.
    """
    use_state_store(scans.sparkSession)
    domain = parse_host(normalize_url(F.col(url)))
    nothing = {"age_days": F.lit(-1), "ssl_valid": F.lit(False)}
    asked = scans.select(
        domain.alias("domain"), F.col(ts).cast("timestamp").alias("at"), F.lit(_SCAN).alias("kind"), packed(scans).alias("payload"),
        *[x.alias(c) for c, x in nothing.items()],
    ).withColumn("salt", F.pmod(F.xxhash64("payload"), F.lit(salts)).cast("int"))
    known = lookups.select(
        F.coalesce("domain", F.lit("")).alias("domain"), F.col("checked_at").cast("timestamp").alias("at"),
        F.when(F.col("domain").isNull(), _TICK).otherwise(_LOOKUP).alias("kind"), F.lit("").alias("payload"),
        *[F.coalesce(F.col(c), x).alias(c) for c, x in nothing.items()],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    both = asked.unionByName(known).where(F.col("at").isNotNull()).withWatermark("at", lateness)
    released = (
        both.withColumn("at_us", F.unix_micros("at")).withColumn("part", F.pmod(F.xxhash64("domain"), F.lit(parts)))
        .groupBy("part", "salt")
        .transformWithStateInPandas(AsOf(ttl_seconds * 1_000_000), _RELEASED, "Append", "EventTime")
    )
    return unpacked(released, scans.schema, "age_days", "ssl_valid")
