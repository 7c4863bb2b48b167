"""Exact top-k search by inner product: columnar branch-and-bound in blocks.

Vectors are stored upright: a block of candidates is one row that holds all values of the first dimension, then all of the second, and
so on. A query block meets a candidate block dimension block by dimension block. After each, a candidate's score is bounded by what it has so far
and the product of the remaining masses (the norms of what is left of both vectors); candidates that cannot reach the k-th best score of
any query of the block are dropped and the survivors are moved together. What is left at the end has its exact score.

Query blocks and candidate blocks are joined by key: the candidates are dealt into groups, every query block is sent to every group and every
candidate block of a group to every query block, so that no task holds all queries or all candidates and no key is hot. A task keeps the best k of each
query within a pair of blocks; a last ranking by query joins them.

Components are integers. Sums below 2^53 are computed in doubles without rounding, larger ones in 64-bit integers or, beyond
those, in Python's integers.

Defined results: vectors that are null or empty or hold a null or non-finite component take no part. Vectors of another length have no score with a
query. Ties go to the smaller id. A row with a query's id, also a repeated one, is not its candidate; other repeated rows are candidates
each. A query row that is repeated asks once; vectors that share a query id ask together, for the best ``k`` of all of them. A query without candidates gives no rows. Null ids take no part. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
DIMENSION_BLOCK = 16


def quantized(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(id, x): every component times ``scale``, rounded down; only vectors that take part."""
    x = F.col(vector_column)
    sound = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(F.col(id_column).isNotNull() & x.isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(id_column).alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("x")
    )


def _blocks(rows: DataFrame, size: int, salt: int) -> DataFrame:
    """Rows gathered into upright blocks of about ``size``: block, dim, n, ids and values as bytes."""

    def upright(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            lists = batch.column(1)
            lengths = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten()).astype("<i8")
            begin = np.cumsum(lengths) - lengths
            out = []
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                for lo in range(0, len(own), size):
                    part = own[lo : lo + size]
                    grid = flat[begin[part][:, None] + np.arange(dim)]
                    out.append((dim, len(part), ids[part].tobytes(), np.ascontiguousarray(grid.T).tobytes()))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["dim", "n", "ids", "cells"])

    return rows.mapInArrow(upright, "dim int, n int, ids binary, cells binary").withColumn(
        "block", F.xxhash64("ids", F.lit(salt))
    )


def _grid(n: int, ids: bytes, cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(cells, "<i8").reshape(-1, n)


def best_of_blocks(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(query positions, candidate ids, scores) of the best ``k`` of each query; matrices are dimension by vector.

    ``floor``: scores that a candidate must reach to be of use, raised in place to the k-th best found.
    """
    dims = q.shape[0]
    mass = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dims
    if mass >= 2.0**53:
        return _wide(q_ids, q, c_ids, c, k, mass)
    order = np.argsort(-(c.astype(float) ** 2).sum(1), kind="stable")  # dimensions that carry most come first
    qf, cf = q[order].astype(float), c[order].astype(float)
    q_left = np.sqrt(np.cumsum((qf**2)[::-1], axis=0)[::-1])
    c_left = np.sqrt(np.cumsum((cf**2)[::-1], axis=0)[::-1])
    if floor is None:
        floor = np.full(len(q_ids), -np.inf)
    # the k-th best of the longest candidates is a first bound; one more than k as one of them may be the query itself
    first = np.argsort(-c_left[0], kind="stable")[: max(64, 4 * (k + 1))]
    if len(first) > k:
        tried = qf.T @ cf[:, first]
        tried[q_ids[:, None] == c_ids[first][None, :]] = -np.inf
        np.maximum(floor, np.partition(tried, len(first) - k, axis=1)[:, len(first) - k], out=floor)
    alive = np.arange(len(c_ids))
    score = np.zeros((len(q_ids), len(alive)))
    for lo in range(0, dims, DIMENSION_BLOCK):
        hi = min(lo + DIMENSION_BLOCK, dims)
        score += qf[lo:hi].T @ cf[lo:hi][:, alive]
        if hi < dims:
            reach = score + q_left[hi][:, None] * c_left[hi][alive][None, :] * (1 + 1e-9) + 1e-6
            keep = (reach >= floor[:, None]).any(0)
            if not keep.all():
                alive, score = alive[keep], np.ascontiguousarray(score[:, keep])
    score[q_ids[:, None] == c_ids[alive][None, :]] = -np.inf
    by_id = np.argsort(c_ids[alive], kind="stable")
    alive, score = alive[by_id], score[:, by_id]
    positions, ids, scores = [], [], []
    for i in range(len(q_ids)):
        own = score[i]
        if len(own) > k:
            bound = max(np.partition(own, len(own) - k)[len(own) - k], floor[i])
        else:
            bound = floor[i]
        hit = np.flatnonzero((own >= bound) & (own > -np.inf))
        hit = hit[np.argsort(-own[hit], kind="stable")][:k]
        if len(hit) == k:
            floor[i] = max(floor[i], own[hit[-1]])
        positions += [i] * len(hit)
        ids.append(c_ids[alive[hit]])
        scores += own[hit].astype(np.int64).tolist()
    return np.array(positions, dtype=np.int64), np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64), scores


def _wide(q_ids, q, c_ids, c, k, mass):
    """The same without bounds, for components too large for exact doubles."""
    kind = np.int64 if mass < 2.0**62 else object
    score = q.astype(kind).T @ c.astype(kind)
    positions, ids, scores = [], [], []
    for i in range(len(q_ids)):
        own = [(-int(s), int(x)) for s, x in zip(score[i], c_ids) if x != q_ids[i]]
        for s, x in sorted(own)[:k]:
            positions.append(i)
            ids.append(x)
            scores.append(-s)
    return np.array(positions, dtype=np.int64), np.array(ids, dtype=np.int64), scores


def top_k(
    vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0
) -> DataFrame:
    """query_id, rank (from 1), id and score of the best ``k`` rows for each row for which ``is_query`` holds."""
    rows = quantized(vectors, id_column, vector_column, scale)
    asked = quantized(vectors.filter(is_query), id_column, vector_column, scale)
    total = rows.agg(F.count(F.lit(1)).alias("n")).first().n
    asking = asked.agg(F.count(F.lit(1)).alias("n")).first().n
    # rows are dealt into as many shares as fill a few blocks each, so that few rows in many files do not make many small blocks
    shares = max(1, total // (2 * CANDIDATE_BLOCK))
    candidate_rows = rows.repartition(shares)
    query_rows = asked.dropDuplicates(["id", "x"]).repartition(max(1, asking // (2 * QUERY_BLOCK)))
    groups = min(4096, -(-total // CANDIDATE_BLOCK) or 1)
    c = _blocks(candidate_rows, CANDIDATE_BLOCK, 1)
    q = _blocks(query_rows, QUERY_BLOCK, 2)
    q = q.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "dim", F.col("n").alias("q_n"),
        F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.col("block").alias("q_block"),
    )
    c = c.select(
        F.pmod("block", F.lit(groups)).cast("int").alias("group"), "dim", F.col("n").alias("c_n"),
        F.col("ids").alias("c_ids"), F.col("cells").alias("c_cells"),
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r].as_py() for i, name in enumerate(batch.schema.names)}
                q_ids, q_grid = _grid(row["q_n"], row["q_ids"], row["q_cells"])
                c_ids, c_grid = _grid(row["c_n"], row["c_ids"], row["c_cells"])
                if len(floors) > 1000:
                    floors.clear()
                floor = floors.setdefault(row["q_block"], np.full(len(q_ids), -np.inf))
                at, ids, scores = best_of_blocks(q_ids, q_grid, c_ids, c_grid, k, floor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[at]), pa.array(ids), pa.array(scores, pa.int64())], ["query_id", "id", "score"]
                )

    # always shuffled: Spark takes the exploded blocks for as small as they were before, and would send them through the driver
    found = q.hint("merge").join(c, ["group", "dim"]).select("q_n", "q_ids", "q_cells", "q_block", "c_n", "c_ids", "c_cells")
    best = found.mapInArrow(search, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
