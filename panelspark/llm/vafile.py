"""Exact nearest vectors by inner product with a vector-approximation file.

The file holds blocks of vectors twice: as 4-bit cells, one for each component, and
exactly. Cells bound every inner product from both sides.

1. The cells alone are scanned. In each block the k-th largest lower bound of a query
   is a score that k vectors reach, so the largest of these over all blocks is a
   threshold for it.
2. In each block the vectors whose upper bound reaches the threshold are read exactly,
   in order of that bound, until the k-th result found beats the next bound.
3. The blocks' results are ranked; equal scores go to the smaller id.

Every block of queries meets every block of vectors: the work is the stated query set
against all rows. Queries go to the blocks; a block of vectors is moved once, whatever
the number of queries. Blocks have a bounded size, a task bounds ``SLICE`` queries at a
time, and nothing is broadcast. Whole numbers are held in the fewest bytes that fit.

Components are taken as floor(256 x) in whole numbers. Vectors that are null or empty
or hold null or non-finite components take no part, nor do rows without an id. Vectors
of different lengths do not meet. A row is no answer to a query with its own id; other
repeated rows are answers like any other. Only vec_id and embedding are read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.vectors import matrix, packed, usable
from panelspark.session import land

SCALE = 256
BLOCK, QUERY_BLOCK, SLICE = 8192, 1024, 256
CELLS = 16
EXACT = float(1 << 53)


def _cells(x: np.ndarray):
    """4-bit cells of each component, two to a byte, and each component's lowest value and cell width."""
    low = x.min(axis=0)
    width = np.maximum((x.max(axis=0) - low + 1) / CELLS, 1e-9)
    code = np.clip(((x - low) / width).astype(np.int64), 0, CELLS - 1).astype(np.uint8)
    if code.shape[1] % 2:
        code = np.pad(code, ((0, 0), (0, 1)))
    return code[:, 0::2] << 4 | code[:, 1::2], low, width


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in two or four bytes each where all fit, else as they are."""
    top = np.abs(x).max(initial=0)
    return packed(next((x.astype(kind) for kind in (np.int16, np.int32) if top <= np.iinfo(kind).max), x))


def _wide(data: bytes, n: int, dim: int) -> np.ndarray:
    """The ``n`` rows that ``_narrow`` made, as doubles."""
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(data) // (n * dim)]
    return np.frombuffer(data, dtype=kind).reshape(n, dim).astype(np.float64)


def _queries(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["query_ids"], dtype=np.int64)
    return ids, _wide(row["queries"], len(ids), row["dim"])


def _bounds(q: np.ndarray, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of all queries with all vectors of a block."""
    n, d = row["n"], q.shape[1]
    code = np.frombuffer(row["cells"], dtype=np.uint8).reshape(n, -1)
    cells = np.empty((n, 2 * code.shape[1]))
    cells[:, 0::2], cells[:, 1::2] = code >> 4, code & 15
    low, width = np.frombuffer(row["low"]), np.frombuffer(row["width"])
    middle = q @ (low + (cells[:, :d] + 0.5) * width).T
    reach = np.abs(q) @ (width / 2)
    # room for the rounding of the cells' edges and of the sums
    reach = (reach * (1 + 1e-9) + 1e-9 * np.abs(middle).max(initial=0) + 1e-3)[:, None]
    return middle - reach, middle + reach


def _block_file(table: pa.Table) -> pa.Table:
    ids = np.asarray(table.column("vec_id"), dtype=np.int64)
    x = np.floor(SCALE * matrix(table.column("embedding").combine_chunks()))
    cells, low, width = _cells(x)
    return pa.table({
        "dim": table.column("dim")[:1], "block": table.column("block")[:1], "n": pa.array([len(ids)], pa.int32()),
        "ids": [packed(ids)], "cells": [packed(cells)], "low": [packed(low)], "width": [packed(width)], "exact": [_narrow(x)],
    })


def _query_file(table: pa.Table) -> pa.Table:
    ids = np.asarray(table.column("vec_id"), dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    x = np.floor(SCALE * matrix(table.column("embedding").combine_chunks()))
    limit = np.asarray(table.column("limit"), dtype=np.float64)
    return pa.table({
        "dim": table.column("dim")[:1], "query_block": table.column("query_block")[:1],
        "query_ids": [packed(ids[order])], "queries": [_narrow(x[order])], "limits": [packed(limit[order])],
    })


def _lower_limits(k):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                all_ids, all_q = _queries(row)
                ids = np.frombuffer(row["ids"], dtype=np.int64)
                for a in range(0, len(all_ids), SLICE):
                    query_ids, q = all_ids[a : a + SLICE], all_q[a : a + SLICE]
                    lower, _ = _bounds(q, row)
                    lower[query_ids[:, None] == ids[None, :]] = -np.inf
                    if enough := lower.shape[1] >= k:
                        lower.partition(lower.shape[1] - k, axis=1)
                    limit = lower[:, -k] if enough else np.full(len(q), -np.inf)
                    yield pa.RecordBatch.from_pydict({"query_id": query_ids, "limit": limit})

    return run


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * len(q) < EXACT:
        return (x @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(v, q)) for v in x], dtype=np.int64)


def _nearest(k, step=64):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, q = _queries(row)
                ids = np.frombuffer(row["ids"], dtype=np.int64)
                exact = _wide(row["exact"], row["n"], row["dim"])
                limits = np.frombuffer(row["limits"])
                out = ([], [], [])
                for at_query, query_id in enumerate(query_ids):
                    i = at_query % SLICE
                    if i == 0:
                        _, upper = _bounds(q[at_query : at_query + SLICE], row)
                    near = np.flatnonzero((upper[i] >= limits[at_query]) & (ids != query_id))
                    near = near[np.argsort(-upper[i][near], kind="stable")]
                    best_ids, best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
                    for at in range(0, len(near), step):
                        if len(best) == k and upper[i][near[at]] < best[-1]:
                            break
                        some = near[at : at + step]
                        best_ids, best = np.append(best_ids, ids[some]), np.append(best, _exact(exact[some], q[at_query]))
                        order = np.lexsort((best_ids, -best))[:k]
                        best_ids, best = best_ids[order], best[order]
                    out[0].append(np.full(len(best), query_id)), out[1].append(best_ids), out[2].append(best)
                if out[0]:
                    yield pa.RecordBatch.from_pydict({name: np.concatenate(v) for name, v in zip(("query_id", "vec_id", "score"), out)})

    return run


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the largest inner product for each query row."""
    embedding = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", embedding.alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.withColumn("dim", F.size("embedding"))
    asked = rows.where(is_query).dropDuplicates(["vec_id"])
    n, n_queries = rows.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    file = land(
        rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("dim", "block")
        .applyInArrow(_block_file, "dim int, block int, n int, ids binary, cells binary, low binary, width binary, exact binary"),
        spark, "va-file",
    )
    numbered = asked.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))

    def meet(blocks_side, queries_side):
        # the queries are copied for each block, a block is never
        right = queries_side.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return blocks_side.join(right, ["dim", "block"])

    query_type = "dim int, query_block int, query_ids binary, queries binary, limits binary"

    def query_file(limited):
        return limited.groupBy("dim", "query_block").applyInArrow(_query_file, query_type)

    cells = file.select("dim", "block", "n", "ids", "cells", "low", "width")
    first = query_file(numbered.withColumn("limit", F.lit(float("-inf"))))
    limits = (
        meet(cells, first).mapInArrow(_lower_limits(k), "query_id long, limit double")
        .groupBy("query_id").agg(F.max("limit").alias("limit"))
    )
    second = query_file(numbered.join(limits, numbered["vec_id"] == limits["query_id"]).drop("query_id"))
    found = meet(file, second).mapInArrow(_nearest(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 50, k: int = 5) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.x, v.x) DESC, v.vec_id) AS INTEGER) AS rank,
 v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % {every} = 0 QUALIFY rank <= {k}"""
