"""Repeats of a URL within a TTL, exact for scans that arrive in any order.

Which scans are kept follows from their order: the first of a URL, then the first at least a TTL after that one, and so on. So a
scan waits until the watermark has passed it and no earlier one can come; then all that are due are gone through in order. What
is known of a URL goes a TTL after its last kept scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hostsift.streaming.state import packed, unpacked, use_state_store
from hostsift.streaming.waiting import Waiting, loaded, stored

_SCANS = pa.schema([("at_us", pa.int64()), ("key", pa.string()), ("payload", pa.string())])


def kept_places(times: np.ndarray, last: int | None, ttl: int) -> list[int]:
    """Of ascending times those at least a TTL after the last kept one, which each kept one becomes in turn."""
    kept, at = [], 0 if last is None else int(np.searchsorted(times, last + ttl))
    while at < len(times):
        kept.append(at)
        at = int(np.searchsorted(times, times[at] + ttl))
    return kept


class FirstWithinTtl(StatefulProcessor):
    """State of a part of the URLs: scans that wait, and from when on a URL that was kept can be kept again."""

    def __init__(self, ttl_us: int):
        self.ttl = max(ttl_us, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = Waiting(handle, _SCANS, ("at_us", "payload"))
        self.free = handle.getValueState("free", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.waiting.add(frame.loc[~frame["tick"], _SCANS.names] for frame in rows)
        self.waiting.timer.sooner(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.waiting.timer.expired()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known = loaded(self.free.get()[0]) if self.free.exists() else None
        free = dict(zip(known["key"].to_pylist(), known["at_us"].to_pylist(), strict=True)) if known else {}
        for table in self.waiting.due(passed):
            times, urls, kept = table["at_us"].to_pylist(), table["key"].to_pylist(), []
            for i, (at, url) in enumerate(zip(times, urls, strict=True)):
                if at >= free.get(url, at):
                    kept.append(i)
                    free[url] = at + self.ttl
            if kept:
                yield pd.DataFrame({"payload": np.array(table["payload"].take(pa.array(kept)).to_pylist(), object)})
            free = {url: at for url, at in free.items() if at > times[-1]}
        free = {url: at for url, at in free.items() if at > passed}
        if free:
            self.free.update((stored(pa.table({"key": list(free), "at_us": list(free.values())})),))
        else:
            self.free.clear()
        first = self.waiting.first()
        self.waiting.timer.set(min(free.values(), default=None) if first is None else first)


def stream_dedup_exact(
    scans: DataFrame, ts: str = "ts", url: str = "url", ttl_seconds: int = 60, lateness: str = "60 seconds",
    parts: int = 64,
) -> DataFrame:
    """Exactly the first scan of a URL, then the first at least a TTL after it, and so on; whole rows come out.

    Of scans of a URL at the same time one can be kept, that of the least row as text. A scan comes out when the newest time is
    ``lateness`` past it; later rows are dropped, and the query's progress counts them. Rows without a URL only move the time
    on, as a source's heartbeat does. URLs are dealt over ``parts`` states.
    """
    use_state_store(scans.sparkSession)
    rows = scans.select(
        F.coalesce(F.col(url), F.lit("")).alias("key"), F.col(url).isNull().alias("tick"), F.col(ts).cast("timestamp").alias("at"),
        packed(scans).alias("payload"),
    )
    timed = rows.where(F.col("at").isNotNull()).withWatermark("at", lateness).withColumn("at_us", F.unix_micros("at"))
    kept = timed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("part").transformWithStateInPandas(
        FirstWithinTtl(ttl_seconds * 1_000_000), "payload string", "Append", "EventTime"
    )
    return unpacked(kept, scans.schema)
