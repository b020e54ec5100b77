"""Rows that wait in state until the watermark has passed them, and come out ordered by time.

One state belongs to a part of all keys, dealt by hash, so that calls to the state store are made for each part and not for each
key. Rows are kept as Arrow chunks of bounded size, each a stretch of time; chunks are read in the order of their first times,
and rows go out once no chunk that is still unread can have earlier ones. So a task holds the chunks that overlap at a time and
not all that waits, however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming import StatefulProcessorHandle

from hostsift.streaming.state import OneTimer

#: Rows of a chunk, and rows that are gathered before chunks are cut or read on.
CHUNK, GATHER = 10_000, 50_000


def stored(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def loaded(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


class Waiting:
    """The waiting rows of one part; ``schema`` has ``at_us`` and ``order`` says how rows go out, ``at_us`` first."""

    def __init__(self, handle: StatefulProcessorHandle, schema: pa.Schema, order: tuple[str, ...]):
        self.schema, self.order = schema, [(c, "ascending") for c in order]
        self.chunks = handle.getMapState("chunks", "first long, number long", "data binary")
        self.number = handle.getValueState("number", "n long")
        self.timer = OneTimer(handle)

    def add(self, frames: Iterator[pd.DataFrame]) -> int | None:
        """Keep rows; the first of their times."""
        first, held, n = None, [], 0
        for frame in frames:
            if len(frame):
                held.append(pa.Table.from_pandas(frame, schema=self.schema, preserve_index=False))
                n += len(frame)
            if n >= GATHER:
                first, held, n = self._cut(held, first), [], 0
        return self._cut(held, first) if held else first

    def _cut(self, tables: list[pa.Table], first: int | None) -> int:
        rows = pa.concat_tables(tables)
        rows = rows.take(pa.array(np.argsort(rows["at_us"].to_numpy(), kind="stable")))
        number = self.number.get()[0] if self.number.exists() else 0
        times = rows["at_us"].to_numpy()
        for at in range(0, len(rows), CHUNK):
            self.chunks.updateValue((int(times[at]), number), (stored(rows.slice(at, CHUNK).combine_chunks()),))
            number += 1
        self.number.update((number,))
        return int(times[0]) if first is None else min(first, int(times[0]))

    def due(self, passed: int) -> Iterator[pa.Table]:
        """The rows up to a time, in order; what waits longer stays. To be read to the end."""
        chunks = sorted((int(k[0]), int(k[1])) for k in self.chunks.keys()) if self.chunks.exists() else []
        chunks = [c for c in chunks if c[0] <= passed]
        held, fresh = [], 0
        for i, key in enumerate(chunks):
            held.append(loaded(self.chunks.getValue(key)[0]))
            fresh += len(held[-1])
            self.chunks.removeKey(key)
            last = i + 1 == len(chunks)
            if last or fresh >= GATHER:
                rows, fresh = pa.concat_tables(held), 0
                goes = rows["at_us"].to_numpy() <= (passed if last else min(passed, chunks[i + 1][0] - 1))
                held = [rows.filter(pa.array(~goes))]
                out = rows.filter(pa.array(goes))
                if len(out):
                    yield out.take(pc.sort_indices(out, sort_keys=self.order))
        if held and len(held[0]):
            self._cut(held, None)

    def first(self) -> int | None:
        """The first time that waits; without any, the chunks' numbers begin anew."""
        found = min((int(k[0]) for k in self.chunks.keys()), default=None) if self.chunks.exists() else None
        if found is None:
            self.number.clear()
        return found
