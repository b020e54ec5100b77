"""Token counts from flat token files by a scan for end-of-document ids.

A flat file is token ids of two or four bytes one after the other, little end first, without an index; a document ends with
the end id. Files are read in blocks of equal size by as many tasks as there are blocks. Each block finds its separators in
one vectorised search; the tokens before its first and after its last separator belong to documents that go over its edges,
and a prefix scan over the blocks' edges, a few numbers per block, puts these together.
"""

from __future__ import annotations

import base64
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostsift.llm.common import result_key
from hostsift.session import qualified, scratch_path

#: Bytes of a block, a multiple of either width.
BLOCK = 4 << 20
_LONG_SPACE = re.compile(r"\s{500}")
#: Bytes after which a writing task begins a new file.
FILE = 64 << 20


@lru_cache(maxsize=4)
def byte_bpe(path: str, pattern: str) -> tiktoken.Encoding:
    """A byte-level BPE encoder from a file of ranks; read once in each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(path: str, pattern: str, text: str) -> list[int]:
    """Ids of a whole text. The encoder's own splitting can't take very long white space, so such a text is split here."""
    encoder = byte_bpe(path, pattern)
    if not _LONG_SPACE.search(text):
        return encoder.encode_ordinary(text)
    return [i for piece in regex.findall(pattern, text) for i in encoder._encode_single_piece(piece)]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    """Spark also writes file:/x; the store of the files is found by file:///x."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def write_token_files(
    docs: DataFrame, ranks: str, pattern: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text",
    width: int = 2,
) -> DataFrame:
    """Write the ids of every whole text and an end id to flat files in a folder all executors share.

    Returns what stands where, one row per document: ``key``, ``file`` (its name) and ``ordinal`` (from 0 in it). A task writes under a name of its
    own and renames the finished file, so a task that runs twice, or on an executor that is lost, leaves the same files. A
    null text is empty: its document is the end id alone. No rows give no files; ids must fit in ``width`` bytes, 2 or
    4. ``ranks`` is the path of a file of byte-level BPE ranks that every executor has, ``pattern`` splits the text before.
    """
    kind = {2: "<u2", 4: "<u4"}[width]
    target = _uri(qualified(docs.sparkSession, folder))  # a path without a scheme is on Spark's file system
    store, root = _filesystem(target)
    store.create_dir(root, recursive=True)

    def write(batches):
        store, root = _filesystem(target)
        part, n_files, sink, name, size, ordinal = TaskContext.get().partitionId(), 0, None, None, 0, 0

        def close() -> None:
            sink.close()
            store.move(f"{root}/.{name}-{attempt}", f"{root}/{name}")

        attempt = uuid.uuid4().hex
        for batch in batches:
            files, ordinals = [], []
            for raw in batch.column("text"):
                if sink is None:
                    name, size, ordinal = f"part-{part:06d}-{n_files:06d}.bin", 0, 0
                    sink = store.open_output_stream(f"{root}/.{name}-{attempt}")
                    n_files += 1
                ids = np.array([*encode_text(ranks, pattern, raw.as_py() or ""), end_id], np.int64)
                if int(ids.max()) >> (8 * width):
                    raise ValueError(f"an id needs more than {width} bytes")
                data = ids.astype(kind).tobytes()
                sink.write(data)
                files.append(name)
                ordinals.append(ordinal)
                size, ordinal = size + len(data), ordinal + 1
                if size >= FILE:
                    close()
                    sink = None
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(files, pa.string()), pa.array(ordinals, pa.int64())], ["key", "file", "ordinal"]
            )
        if sink is not None:
            close()

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind_of_key = rows.schema["key"].dataType.simpleString()
    placed = rows.mapInArrow(write, f"key {kind_of_key}, file string, ordinal bigint")
    index = scratch_path(docs.sparkSession, "token-index")
    placed.write.parquet(index)  # the files are there when this is done
    return docs.sparkSession.read.parquet(index).withColumnRenamed("key", key)


def _edges(files: DataFrame, end_id: int, width: int, block: int) -> DataFrame:
    """Of every block: number of separators, tokens before the first and after the last, and the lengths between them."""
    kind = {2: "<u2", 4: "<u4"}[width]
    blocks = files.select(
        "file", "length", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / block)))).alias("block")
    ).where("length > 0").repartition("file", "block")

    def scan(batches):
        for batch in batches:
            rows = []
            for file, number in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                store, path = _filesystem(_uri(file))
                with store.open_input_file(path) as source:
                    ids = np.frombuffer(source.read_at(block, number * block), kind)
                ends = np.flatnonzero(ids == end_id)
                rows.append(
                    {
                        "file": file, "block": number, "n_ends": len(ends), "head": int(ends[0]) if len(ends) else len(ids),
                        "tail": len(ids) - 1 - int(ends[-1]) if len(ends) else 0, "inner": np.diff(ends) - 1,
                    }
                )
            schema = pa.schema(
                [("file", pa.string()), ("block", pa.int64()), ("n_ends", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()),
                 ("inner", pa.list_(pa.int64()))]
            )
            yield pa.RecordBatch.from_pylist(rows, schema)

    return blocks.select("file", "block").mapInArrow(
        scan, "file string, block bigint, n_ends bigint, head bigint, tail bigint, inner array<bigint>"
    )


def count_tokens(
    spark: SparkSession, folder: str, end_id: int, width: int = 2, block: int = BLOCK
) -> DataFrame:
    """``file``, ``ordinal`` (from 0), ``n_tokens`` of every document in the flat files of a folder.

    Documents don't go over the end of a file: tokens after a file's last separator are a document of their own, unless there
    are none. An empty file has no documents, and a folder without files gives no rows. ``block`` is in bytes, a multiple of
    ``width``. The folder is one that all executors reach.
    """
    if block % width:
        raise ValueError("a block holds whole ids")
    # Spark lists the files; their contents are read in blocks below.
    files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), "length")
    edges = _edges(files, end_id, width, block)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    has_end = F.col("n_ends") > 0
    # A block leaves open what comes after its last separator, or all of itself. What is open at a block's start is the sum
    # of that from the last block with a separator on: a running sum less its value where that block began.
    leaves = F.when(has_end, F.col("tail")).otherwise(F.col("head"))
    summed = edges.withColumns(
        {
            "first_ordinal": F.coalesce(F.sum("n_ends").over(before), F.lit(0)),
            "left": F.coalesce(F.sum(leaves).over(before), F.lit(0)),
            "is_last": F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull(),
        }
    )
    since = F.coalesce(F.last(F.when(has_end, F.col("left")), ignorenulls=True).over(before), F.lit(0))
    opened = summed.withColumn("first", F.col("left") - since + F.col("head"))
    none = F.array().cast("array<bigint>")
    whole = F.when(has_end, F.concat(F.array("first"), "inner")).otherwise(none)
    rest = F.when(has_end, F.col("tail")).otherwise(F.col("first"))
    ended = F.concat(whole, F.when(F.col("is_last") & (rest > 0), F.array(rest)).otherwise(none))
    return opened.select("file", "first_ordinal", F.posexplode(ended).alias("at", "n_tokens")).select(
        "file", (F.col("first_ordinal") + F.col("at")).alias("ordinal"), "n_tokens"
    )


def document_tokens(
    docs: DataFrame, ranks: str, pattern: str, end_id: int, key: str = "doc_id", text: str = "text", width: int = 2
) -> DataFrame:
    """``key`` and ``n_tokens`` of every document, counted in token files that are written for it."""
    folder = scratch_path(docs.sparkSession, "tokens")
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    index = write_token_files(texts, ranks, pattern, end_id, folder, "key", "text", width)
    counts = count_tokens(docs.sparkSession, folder, end_id, width)
    result_key(key, ["n_tokens"])
    name = F.substring_index("file", "/", -1)
    # Both sides have a row per document; what their files weigh says little about that, so neither is broadcast.
    return index.hint("merge").join(counts.withColumn("file", name), ["file", "ordinal"]).select(F.col("key").alias(key), "n_tokens")
