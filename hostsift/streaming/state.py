"""What the stateful processors share: rows as strings, one timer per key, the state store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

#: Written with all digits of a time, so that rows come back as they were.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def packed(rows: DataFrame) -> Column:
    """A whole row as a string."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), _JSON)


def unpacked(released: DataFrame, schema: T.StructType, *more: str) -> DataFrame:
    """The rows in ``payload``, and further columns."""
    row = F.from_json("payload", schema, _JSON).alias("row")
    return released.select(row, *more).select("row.*", *more)


class OneTimer:
    """A key's only timer; it moves with what the key waits for."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.state = handle.getValueState("timer", "at long")

    def set(self, us: int | None) -> None:
        """Wake once the watermark has passed a time in microseconds; without one, never."""
        ms = None if us is None else us // 1000 + 1
        now = self.state.get()[0] if self.state.exists() else None
        if ms == now:
            return
        if now is not None:
            self.handle.deleteTimer(now)
            self.state.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.state.update((ms,))

    def sooner(self, us: int | None) -> None:
        """Wake by this time, or before as it was."""
        now = self.state.get()[0] if self.state.exists() else None
        if us is not None and (now is None or us // 1000 + 1 < now):
            self.set(us)

    def expired(self) -> None:
        self.state.clear()


def use_state_store(spark: SparkSession) -> None:
    """State of any size on the executors' disks, with its changes in the query's checkpoint; holds for queries started later."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
