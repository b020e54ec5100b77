"""Exact top-k by inner product with the threshold algorithm over sorted lists, one list per dimension.

Candidates lie in blocks, and each block has its vectors sorted by every dimension. A query reads these lists in parallel, from
the largest values down where its own component is positive and from the smallest up where it is negative, scores whatever
comes up, and stops when even a vector with the values last read in all lists could not beat its k-th score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostsift.llm.common import fresh

#: Vectors in a block, and queries that read a block together; a task holds one of each.
BLOCK, QUERIES = 4096, 512
FIRST_DEPTH = 8


def _exact(vectors: np.ndarray, queries: np.ndarray) -> np.dtype:
    """The narrowest type in which all products and sums are exact."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
    return np.dtype(np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64)


class SortedLists:
    """Vectors of one length with the order of each dimension, smallest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")  # so that the first of equal scores has the smallest id
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.vectors, self.order, 0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """Query id, id and score of each query's ``k`` best, its own id left out."""
        n, dims = self.vectors.shape
        kind = _exact(self.vectors, queries)
        vectors, ends, q = self.vectors.astype(kind), self.sorted.astype(kind), queries.astype(kind)
        signs = np.sign(queries)
        seen = np.zeros((len(q), n), bool)
        active = np.arange(len(q))
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, kind), np.zeros(0, np.int64))] * len(q)
        read, depth = 0, min(n, FIRST_DEPTH)
        while len(active):
            came = np.zeros((len(active), n), bool)
            for d in range(dims):
                side = signs[active, d]
                for sign, part in ((1, self.order[n - depth : n - read, d]), (-1, self.order[read:depth, d])):
                    readers = np.flatnonzero(side == sign)
                    if len(readers):
                        came[readers[:, None], part] = True
            if depth == n:
                came[:] = True  # a query of zeros reads no list
            came &= ~seen[active]
            seen[active] |= came
            top = np.where(signs[active] > 0, ends[n - depth], np.where(signs[active] < 0, ends[depth - 1], 0))
            bound = (top * q[active]).sum(1)
            going = []
            for row, i in enumerate(active):
                new = np.flatnonzero(came[row])
                new = new[self.ids[new] != query_ids[i]]
                scores, at = np.concatenate((best[i][0], vectors[new] @ q[i])), np.concatenate((best[i][1], new))
                if len(at) > k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    may = np.flatnonzero(scores >= least)
                    may = may[np.lexsort((at[may], -scores[may]))[:k]]
                    scores, at = scores[may], at[may]
                best[i] = scores, at
                # An unseen vector that ties could have a smaller id, so the k-th score must be above the bound.
                if depth < n and not (len(at) >= k and scores.min() > bound[row]):
                    going.append(i)
            active = np.array(going, np.int64)
            read, depth = depth, min(n, 2 * depth)
        return [
            (int(query_ids[i]), int(self.ids[v]), int(s)) for i, (scores, at) in enumerate(best) for s, v in zip(scores, at)
        ]


def _search_block(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    found: list[tuple[int, int, int]] = []
    sizes = vectors["v"].map(len).to_numpy()
    query_sizes = queries["v"].map(len).to_numpy()
    for size in np.unique(query_sizes):
        own, asked = vectors[sizes == size], queries[query_sizes == size]
        if len(own):
            shape = (-1, int(size))
            lists = SortedLists(own["id"].to_numpy(), np.array(own["v"].tolist(), np.int64).reshape(len(own), shape[1]))
            found += lists.search(
                asked["id"].to_numpy(), np.array(asked["v"].tolist(), np.int64).reshape(len(asked), shape[1]), k
            )
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """``id`` and ``v``, floor(scale * x) of every component; rows that can't take part are left out."""
    whole = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    kept = df.where(F.col(key).isNotNull() & F.coalesce(whole, F.lit(False)))
    return kept.select(
        F.col(key).cast("bigint").alias("id"),
        F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint")).alias("v"),
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's ``k`` highest integer inner products.

    Both tables have ``id`` and ``v``, as ``integer_vectors`` gives them. A query's candidates are the vectors of its own
    length but those of its own id; ties go to the smaller id. With fewer than ``k`` candidates all are returned, without
    any the query has no row. Repeated rows of a vector are candidates each; a repeated query is one query. Every query meets
    every block, in tasks of a block and a group of queries; blocks have a bounded size whatever values their vectors have.
    """
    asked = queries.dropDuplicates(["id"])
    n_blocks, n_groups = max(1, -(-vectors.count() // BLOCK)), max(1, -(-asked.count() // QUERIES))
    copy = fresh(vectors, "copy")
    held = vectors.withColumn(copy, F.monotonically_increasing_id()).select(
        "id", "v", F.pmod(F.xxhash64("id", copy), F.lit(n_blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"),
    )
    sent = asked.select(
        "id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("id"), F.lit(n_groups)).cast("int").alias("group"),
    )
    found = held.groupBy("block", "group").cogroup(sent.groupBy("block", "group")).applyInPandas(
        lambda v, q: _search_block(v, q, k), "query_id bigint, vec_id bigint, score bigint"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
