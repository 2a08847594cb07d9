"""Nearest neighbours of a stated query set by a matrix join in blocks.

Queries and candidates fall into blocks by a hash.  A tile is one block of each.
In a tile, every vector becomes int8 codes and a scale; one matrix product of
the codes gives all inner products approximately.  With ``e = x - s*c`` the rest
that the codes leave, the error of a product is at most
``|e_q| |x_c| + |s_q c_q| |e_c|`` (Cauchy-Schwarz).  A candidate survives if its
upper bound reaches the k-th largest lower bound of its query, so no true
neighbour is lost.  Survivors are computed again in double precision, from the
first component to the last, and go into the query's heap of k.  The heaps of
the tiles are merged by a ranked window, of which each task keeps k rows.

A task holds one block of queries and one of candidates, whatever the tables'
size.  The work is the stated query set against all rows, hence its product.

Defined cases: a row takes no part if its id or vector is null, or the vector is
empty, all zero, or holds a null or a value that is not finite.  Vectors meet
those of their own length only.  A query meets no row that has its id; a query
id that occurs twice asks twice, and both answers carry it.  Equal scores rank
by the smaller id.  Fewer than k candidates: all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 16_384


def usable(id_: Column, vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return id_.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """codes, scales, and the lengths of the vectors, of their codes and of the rest."""
    scale = np.maximum(np.abs(x).max(axis=1), np.finfo(np.float64).tiny) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    kept = codes * scale[:, None]
    norm = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m))
    return codes, scale, norm(x), norm(kept), norm(x - kept)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k nearest (score, -id) of the candidates."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    q_codes, q_scale, _, q_kept, q_rest = _coded(q)
    step = 4096
    for at in range(0, len(c_ids), step):
        ids, vectors = c_ids[at:at + step], c[at:at + step]
        codes, scale, norm, _, rest = _coded(vectors)
        # Sums of int8 products stay below 2**24 up to a thousand components, else doubles hold them.
        kind = np.float32 if c.shape[1] <= 1024 else np.float64
        near = (q_codes.astype(kind) @ codes.astype(kind).T).astype(np.float64)
        near *= q_scale[:, None] * scale[None, :]
        error = q_rest[:, None] * norm[None, :] + q_kept[:, None] * rest[None, :]
        error += 1e-9 * (np.abs(near) + error)
        near[q_ids[:, None] == ids[None, :]] = -np.inf
        floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        if len(ids) > k:
            floor = np.maximum(floor, np.partition(near - error, len(ids) - k, axis=1)[:, len(ids) - k])
        rows, columns = np.nonzero((near + error >= floor[:, None]) & (near > -np.inf))
        scores = _exact(q[rows], vectors[columns])
        for row, score, id_ in zip(rows.tolist(), scores.tolist(), ids[columns].tolist(), strict=True):
            heap, entry = heaps[row], (score, -id_)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
    return heaps


def _by_length(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, keys, ids, matrix) for each length of vector."""
    lists = table.column("_vector").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    ids, keys = table.column("_id").to_numpy(), table.column("_key").to_numpy()
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield n, keys[rows], ids[rows], values[starts[rows][:, None] + np.arange(n)]


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query."""
    rows = df.where(usable(F.col(f"`{id_}`"), F.col(f"`{vector}`"))).select(
        F.col(f"`{id_}`").cast("long").alias("_id"), F.col(f"`{vector}`").alias("_vector"),
        is_query.alias("_asks"), F.xxhash64(f"`{id_}`", f"`{vector}`").alias("_key"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("_asks")).first()
    q_blocks, c_blocks = 1 + asked // QUERY_BLOCK, 1 + n // CANDIDATE_BLOCK
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # A query row has one key in all blocks of candidates, so it is given before the row is repeated.
    queries = rows.where("_asks").select(
        "_id", "_vector", F.monotonically_increasing_id().alias("_row"),
        F.pmod("_key", F.lit(q_blocks)).cast("int").alias("_q")).select(
        "_id", "_vector", F.col("_row").alias("_key"), "_q", every(c_blocks).alias("_c"))
    candidates = rows.select(
        "_id", "_vector", "_key", F.pmod(F.xxhash64("_key"), F.lit(c_blocks)).cast("int").alias("_c"),
        every(q_blocks).alias("_q"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, asks, scores, found = [], [], [], []
        others = {n: (ids, x) for n, _, ids, x in _by_length(right)} if right.num_rows else {}
        for n, key, ids, x in _by_length(left) if left.num_rows else ():
            if n not in others:
                continue
            for one, ask, heap in zip(key.tolist(), ids.tolist(), tile(ids, x, *others[n], k), strict=True):
                keys += [one] * len(heap)
                asks += [ask] * len(heap)
                scores += [s for s, _ in heap]
                found += [-i for _, i in heap]
        return pa.table({"_key": pa.array(keys, pa.int64()), "query_id": pa.array(asks, pa.int64()),
                         "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64())})

    heaps = queries.groupBy("_q", "_c").cogroup(candidates.groupBy("_q", "_c")).applyInArrow(
        run, "_key long, query_id long, vec_id long, score double")
    ranked = Window.partitionBy("_key", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return (heaps.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
