"""Hard negatives by full exact scores, computed the way of the four Russians.

Eight dimensions of an anchor have 256 subset sums. With these in a table, the part of an inner product that one bit of eight
components adds is one look-up: the byte that holds these bits of a candidate is the index. So candidates are stored as bit
planes, a byte for each plane and group of eight dimensions, and the look-ups of the planes are added from the top one down,
shifting by one bit between them; the top plane is the sign and counts negative.

The queries, a stated set of anchors, meet all vectors in blocks of bounded size, twice: first to find each anchor's positives,
whose scores are only known over all blocks, then to find the negatives in the windows that these scores open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostsift.session import staged

#: Vectors in a block, anchors that meet it together, and anchors whose tables are held at once.
BLOCK, ANCHORS, TILE = 4096, 8192, 128
#: Tasks at most of one meeting of blocks and anchors; a task takes several where there are more.
TASKS = 10_000


def planes_for(least: int, most: int) -> int:
    """Bits that hold all numbers from ``least`` to ``most``, the sign included."""
    return 1 + max((~x if x < 0 else x).bit_length() for x in (least, most))


def bit_planes(vectors: np.ndarray, planes: int) -> np.ndarray:
    """n x planes x groups bytes: bit ``d`` of a byte is that plane's bit of the group's dimension ``d``."""
    n, dims = vectors.shape
    padded = np.zeros((n, -(-dims // 8) * 8), np.int64)
    padded[:, :dims] = vectors
    return np.stack([np.packbits((padded >> p & 1).astype(bool), axis=1, bitorder="little") for p in range(planes)], axis=1)


def from_planes(codes: np.ndarray, dims: int) -> np.ndarray:
    bits = np.unpackbits(codes, axis=2, bitorder="little")[:, :, :dims].astype(np.int64)
    weights = np.array([1 << p for p in range(codes.shape[1] - 1)] + [-(1 << (codes.shape[1] - 1))], np.int64)
    return (bits * weights[:, None]).sum(1)


def sum_kind(anchors: np.ndarray, planes: int) -> np.dtype:
    """A type in which no sum of the look-ups overflows."""
    most = int(np.abs(anchors).astype(object).sum(1).max()) << planes if anchors.size else 0
    if most >= 1 << 63:
        raise OverflowError("scores don't fit in 64 bits")
    return np.dtype(np.int32 if most < 1 << 31 else np.int64)


def subset_sums(anchors: np.ndarray, kind: np.dtype) -> np.ndarray:
    """groups x 256 x anchors: what the dimensions that a byte's bits name add up to."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    padded = np.zeros((n, groups * 8), kind)
    padded[:, :dims] = anchors
    parts = padded.T.reshape(groups, 8, n)
    table = np.zeros((groups, 256, n), kind)
    for d in range(8):
        table[:, 1 << d : 2 << d] = table[:, : 1 << d] + parts[:, d, None]
    return table


def scores(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """anchors x candidates."""
    n, planes, groups = codes.shape
    total, plane, part = (np.zeros((n, table.shape[2]), table.dtype) for _ in range(3))
    for p in reversed(range(planes)):
        plane[:] = 0
        for g in range(groups):
            plane += np.take(table[g], codes[:, p, g], axis=0, out=part, mode="clip")
        total += total
        total += -plane if p == planes - 1 else plane
    return np.ascontiguousarray(total.T)


def _first(found: np.ndarray, ranked: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``found``, those of the ``k`` highest ``ranked`` numbers, ties to the smaller place."""
    if len(found) > k:
        values = ranked[found]
        found = found[values >= np.partition(values, len(values) - k)[len(values) - k]]
    return found[np.lexsort((found, -ranked[found]))[:k]]


def _percent_up(score: int, percent: int) -> int:
    return -(-percent * score // 100)


def _meet(vectors: pa.Table, anchors: pa.Table, planes: int, choose) -> list[tuple]:
    """``choose`` applied to every anchor: its row, its score with each vector, the ids, and where the labels are equal."""
    if not len(vectors) or not len(anchors):
        return []
    dims = anchors["dims"][0].as_py()

    def codes(t: pa.Table) -> np.ndarray:
        raw = b"".join(x.as_py() for x in t["code"])
        return np.frombuffer(raw, np.uint8).reshape(len(t), planes, -(-dims // 8))

    vectors = vectors.sort_by("id")  # so that the first of equal scores has the smallest id
    ids, held = vectors["id"].to_numpy(), codes(vectors)
    names = pa.concat_tables([vectors.select(["label"]), anchors.select(["label"])])["label"].combine_chunks().dictionary_encode()
    labels, own = np.split(names.indices.to_numpy(), [len(vectors)])
    components = from_planes(codes(anchors), dims)
    kind = sum_kind(components, planes)
    rows = anchors.drop_columns(["code"]).to_pylist()
    found = []
    for start in range(0, len(rows), TILE):
        table = subset_sums(components[start : start + TILE], kind)
        for i, score in enumerate(scores(table, held), start):
            found += choose(rows[i], score, ids, labels == own[i])
    return found


def _meetings(vectors: DataFrame, anchors: DataFrame, blocks: int, groups: int, planes: int, choose, schema: str) -> DataFrame:
    """Every anchor meets every vector of as many dimensions, in tasks of a block of these and a group of those.

    A vector is copied once for each ``ANCHORS`` anchors, an anchor once for each ``BLOCK`` vectors: next to nothing beside the
    scores that a meeting computes.
    """
    keys, tasks = ["dims", "block", "group"], min(TASKS, 3 * blocks * groups)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("group", every(groups))
    asked = anchors.toDF(*anchors.columns).withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("block", every(blocks))
    names = [f.split()[0] for f in schema.split(", ")]

    def search(v: pa.Table, a: pa.Table) -> pa.Table:
        found = _meet(v, a, planes, choose)
        return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in range(len(names))], names)

    both = (side.repartition(tasks, *keys).groupBy(*keys) for side in (held, asked))
    return next(both).cogroup(next(both)).applyInArrow(search, schema)


def _packed(vectors: DataFrame, planes: int) -> DataFrame:
    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        sizes, values = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        starts, out = np.cumsum(sizes) - sizes, np.empty(len(sizes), object)
        for size in np.unique(sizes):
            of = np.flatnonzero(sizes == size)
            codes = bit_planes(values[starts[of, None] + np.arange(size)], planes)
            out[of] = [code.tobytes() for code in codes]
        return pa.array(out.tolist(), pa.binary())

    rows = vectors.select("id", "label", F.size("v").alias("dims"), pack("v").alias("code"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "dims", "code")).alias("row")).select("id", "row.*")


def labelled_vectors(df: DataFrame, key: str, vector: str, label: str | Column, scale: int = 256) -> DataFrame:
    """``id``, ``label`` and ``v``, floor(scale * x) of every component; rows that can't take part are left out."""
    parts = df.select(
        F.col(f"`{key}`").cast("bigint").alias("id"),
        (F.col(f"`{label}`") if isinstance(label, str) else label).cast("string").alias("label"),
        F.col(f"`{vector}`").alias("v"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    return parts.where(whole).withColumn("v", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80, most_percent: int = 100
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    ``vectors`` has ``id``, ``label`` and ``v``, as ``labelled_vectors`` gives them; ``is_anchor`` is a condition on ``id``. The
    score of two vectors is their integer inner product. An anchor's positives are the ``positives`` rows of its label with the
    highest scores, and for each of these it gets the ``negatives`` highest of the rows of other labels that score between
    ``least_percent`` and ``most_percent`` of the positive; ties go to the smaller id. Where there are fewer, all are returned,
    without any no row. Only vectors of equally many components meet. Of rows that repeat an id one takes part, that of the
    smallest label and vector. An empty table gives no rows; scores beyond 64 bits raise an error.
    """
    ends = vectors.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    planes = planes_for(ends[0] or 0, ends[1] or 0)
    held = staged(_packed(vectors, planes), "packed")
    anchors = held.where(is_anchor)
    blocks, groups = max(1, -(-held.count() // BLOCK)), max(1, -(-anchors.count() // ANCHORS))

    def same_label(anchor, score, ids, same):
        at = _first(np.flatnonzero(same & (ids != anchor["id"])), score, positives)
        return [(anchor["id"], int(ids[i]), int(score[i])) for i in at]

    found = _meetings(held, anchors, blocks, groups, planes, same_label, "anchor_id bigint, positive_id bigint, positive_score bigint")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives).drop("rank")
    chosen = staged(chosen, "positives")
    targets = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("targets"))

    def in_windows(anchor, score, ids, same):
        rows, others = [], np.flatnonzero(~same)
        values = score[others]
        for target in anchor["targets"]:
            least, most = _percent_up(target, least_percent), most_percent * target // 100
            at = _first(others[(values >= least) & (values <= most)], score, negatives)
            rows += [(anchor["id"], target, int(ids[i]), int(score[i])) for i in at]
        return rows

    found = _meetings(
        held, anchors.toDF(*anchors.columns).join(targets, "id"), blocks, groups, planes, in_windows,
        "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    best = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hard = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= negatives)
    return chosen.join(hard, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
