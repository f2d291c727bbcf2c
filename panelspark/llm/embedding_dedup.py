"""Near-duplicate vectors within a label: spherical k-means cells and blocked cosine products.

Unit vectors get the cell of the nearest centroid. Two vectors of different cells that
are similar enough lie on two sides of the plane midway between their centroids, and
one of them is at most half their distance from it. A vector therefore also visits
every cell whose plane is that near: no link across cells is lost, whatever the
centroids are. They are fitted on a bounded sample of ``SAMPLE`` rows.

The rows of a label and cell are cut into blocks of bounded size; every two blocks
meet in one task, which multiplies them and keeps each vector's number of links and a
spanning forest, never the pairs. A pair that two cells see counts in the lower one.
Connected components of the forests name each group by its smallest id, which stays.

Vectors without an id or label, and those that are null, empty or zero or hold null or
non-finite components, link with nothing; so do vectors of different lengths. Rows that
share an id do not link with each other, and their links add up. Each row of the input
gives a row. Only vec_id, embedding and label are read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.components import components
from panelspark.llm.vectors import matrix, packed, usable
from panelspark.session import land

SIMILAR = 0.93
CELLS = 16  # at most 64: a row names the cells it visits in one number
SAMPLE = 8192
ROUNDS = 8
BLOCK = 2048


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors; an empty cell takes the vector farthest from its own centroid."""
    if not len(x):
        return np.zeros((1, max(1, x.shape[1])))
    centroids = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = x @ centroids.T
        own = near.argmax(axis=1)
        for c in range(len(centroids)):
            mine = own == c
            centroids[c] = x[mine].sum(axis=0) if mine.any() else x[near.max(axis=1).argmin()]
        centroids = unit(centroids)
    return centroids


def _placed(centroids: np.ndarray, similar: float):
    """Each vector once for its own cell and once for every cell that it visits."""
    half = np.sqrt(max(0.0, 2 - 2 * similar)) / 2 + 1e-9
    apart = np.linalg.norm(centroids[:, None] - centroids[None], axis=2)

    def run(batches):
        for batch in batches:
            vec_id, label = np.asarray(batch.column("vec_id")), np.asarray(batch.column("label"))
            for dim in np.unique(np.asarray(batch.column("dim"))):
                rows = np.flatnonzero(np.asarray(batch.column("dim")) == dim)
                x = unit(matrix(batch.column("embedding").take(pa.array(rows))))
                some = np.abs(x).sum(axis=1) > 0
                rows, x = rows[some], x[some]
                if dim == centroids.shape[1]:
                    near = x @ centroids.T
                    home = near.argmax(axis=1)
                    margin = near[np.arange(len(x)), home][:, None] - near
                    goes = margin <= half * apart[home]
                else:  # a length of its own: one cell
                    home, goes = np.zeros(len(x), dtype=np.int64), np.ones((len(x), 1), dtype=bool)
                goes[np.arange(len(x)), home] = True
                visits = (goes.astype(np.uint64) << np.arange(goes.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                at, cell = np.nonzero(goes)
                yield pa.RecordBatch.from_pydict({
                    "label": pa.array(label[rows[at]], pa.int64()), "dim": pa.array(np.full(len(at), dim), pa.int32()), "cell": pa.array(cell, pa.int32()),
                    "home": pa.array(home[at], pa.int32()), "visits": visits[at].view(np.int64), "vec_id": pa.array(vec_id[rows[at]], pa.int64()),
                    "x": pa.array([packed(v) for v in x[at]], pa.binary()),
                })

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n places, the smallest id that links lead to."""
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (root == before).all():
            return root


def _compare(similar):
    def run(table: pa.Table) -> pa.Table:
        cell, one, two = (table.column(c)[0].as_py() for c in ("cell", "one", "two"))
        block, home, ids = (np.asarray(table.column(c)) for c in ("block", "home", "vec_id"))
        visits = np.asarray(table.column("visits")).view(np.uint64)
        x = np.frombuffer(b"".join(v.as_py() for v in table.column("x"))).reshape(len(ids), -1)
        a, b = np.flatnonzero(block == one), np.flatnonzero(block == two)
        close = x[a] @ x[b].T >= similar
        if one == two:
            close = np.triu(close, 1)
        i, j = np.nonzero(close)
        i, j = a[i], b[j]
        same = ids[i] != ids[j]
        i, j = i[same], j[same]
        local = home == cell
        other = np.where(local[i], home[j], home[i]).astype(np.uint64)  # the other one's own cell
        mutual = (np.where(local[i], visits[i], visits[j]) >> other & np.uint64(1)).astype(bool)
        counts = (local[i] & local[j]) | ((local[i] ^ local[j]) & (~mutual | (cell < other.astype(np.int64))))
        i, j = i[counts], j[counts]
        links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        root = _roots(len(ids), i, j, ids)
        some = links > 0
        return pa.table({"vec_id": ids[some], "links": links[some].astype(np.int64), "root": root[some]})

    return run


def groups(spark: SparkSession, vectors: DataFrame, similar: float = SIMILAR, cells: int = CELLS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors."""
    embedding = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), embedding.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    ).withColumn("dim", F.size("embedding"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding", "dim").toArrow()
    dims = np.asarray(sample.column("dim").combine_chunks())
    common = int(np.bincount(dims).argmax()) if len(dims) else 1
    chosen = sample.filter(pa.array(dims == common)).column("embedding").combine_chunks()
    centroids = spherical_kmeans(unit(matrix(chosen)) if len(chosen) else np.zeros((0, common)), cells)
    key = ["label", "dim", "cell"]
    placed = land(
        rows.mapInArrow(_placed(centroids, similar), "label long, dim int, cell int, home int, visits long, vec_id long, x binary"), spark, "cells"
    )
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    blocked = (
        placed.join(sizes, key)
        .select(*key, "home", "visits", "vec_id", "x", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), other)
        .select("*", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    )
    found = land(blocked.groupBy(*key, "one", "two").applyInArrow(_compare(similar), "vec_id long, links long, root long"), spark, "vector-links")
    linked = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    named = components(spark, found.select("vec_id", "root")).withColumnRenamed("node", "vec_id")
    component = F.coalesce("component", "vec_id")
    return (
        vectors.select("vec_id").join(linked, "vec_id", "left").join(named, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
    )


def oracle(similar: float = SIMILAR) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= {similar}),
r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT node, min(reached) AS component FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component, d.vec_id) AS component_id, coalesce(c.component, d.vec_id) = d.vec_id AS kept
FROM embeddings d LEFT JOIN n ON n.a = d.vec_id LEFT JOIN c ON c.node = d.vec_id"""
