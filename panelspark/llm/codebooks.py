"""Vector codes: each part of a vector is replaced by the nearest entry of a codebook.

Components are taken as floor(1024 x) in whole numbers. A vector is cut into four equal
consecutive parts (of a length that four does not divide, into parts that differ by one
component at most). The codebook of a part position starts as that part of the 256
smallest ids and moves through four rounds: every part goes to its nearest entry, and an
entry becomes the componentwise floored mean of what went to it.

Distances come from a lexicographic trie over the distinct parts. A node is a prefix of
parts and has one vector: the squared distances, accumulated over the prefix's
dimensions, to all entries. It is its parent's vector plus one dimension, so parts with a
common prefix share the work on it. The traversal is depth-first, some hundred leaves at
a stride, whose nodes of one depth are worked on together; the path to the last leaf is
carried to the next stride. A leaf takes the argmin (ties to the lower index) and adds
its part to that entry's sum as often as vectors have it.

1. Tasks sort the parts of some ten thousand vectors into tries and write these once.
2. A round reads the tries and returns the sums of every entry, added up by Spark;
   only these, 256 times the length of a vector, reach the driver.
3. The last pass gives each vector its codes. Errors are added up by label before they
   are joined; a label with very many rows is spread over several tasks.

Nothing is sampled and no vector moves between tasks. Vectors that are null or hold null
or non-finite components are dropped. A vector without components has code 00 in every
part and no error. Vectors of each length have codebooks of their own. Rows without an
id are coded and come last in the order of ids; of rows that share an id the smaller
vector comes first. With fewer than 256 vectors there are as many entries as vectors.
An empty table gives no rows. Components of 16384 or more raise an error, so that all
sums are exact in 64 bits. Only vec_id, embedding and label are read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.vectors import packed
from panelspark.operators.align import hot_keys, left_join_unique
from panelspark.session import land

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LARGEST = 1 << 24
STRIDE = 512
COMPONENTS = 1 << 20  # of the vectors whose parts are sorted together


def cuts(dim: int) -> list[int]:
    return [dim * p // PARTS for p in range(PARTS + 1)]


def whole(vectors: np.ndarray) -> np.ndarray:
    x = np.floor(SCALE * vectors)
    if np.abs(x).max(initial=0) >= LARGEST:
        raise ValueError(f"a component of {LARGEST // SCALE} or more")
    return x.astype(np.int64)


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, how often each occurs, and the place of each row among them."""
    n, d = parts.shape
    if not d:
        return parts[: min(n, 1)], np.array([n] if n else [], dtype=np.int64), np.zeros(n, dtype=np.int64)
    # as unsigned big-endian bytes, rows sort in the order of their numbers
    raw = np.ascontiguousarray((parts + LARGEST).astype(">u4")).view(f"V{4 * d}").ravel()
    order = np.argsort(raw, kind="stable")
    rows = parts[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return rows[at], np.diff(np.append(at, n)), place


def leaf_distances(leaves: np.ndarray, entries: np.ndarray, stride: int = STRIDE):
    """(first leaf, squared distances of a stride of leaves to all entries), leaves distinct and in order."""
    n, d = leaves.shape
    largest = max(np.abs(leaves).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.int32 if 4 * int(largest) ** 2 * max(d, 1) < 1 << 31 else np.int64
    leaves, entries = leaves.astype(kind), np.ascontiguousarray(entries.astype(kind).T)
    k = entries.shape[1]
    # how many dimensions each leaf shares with the one before it; the first has no path to share
    shared = np.zeros(n, dtype=np.int64)
    if n > 1 and d:
        shared[1:] = np.argmax(leaves[1:] != leaves[:-1], axis=1)
    path = [np.zeros(k, dtype=kind) for _ in range(d + 1)]
    for low in range(0, n, stride):
        rows, depth = leaves[low : low + stride], shared[low : low + stride]
        node, grown = np.zeros(len(rows), dtype=np.int64), path[0][None, :]
        for t in range(d):
            opens = depth <= t
            opens[0] = True
            at = np.flatnonzero(opens)
            kept = low > 0 and depth[0] > t  # the first node goes on from the stride before
            at_new = at[1:] if kept else at
            step = rows[at_new, t][:, None] - entries[t][None, :]
            step *= step
            step += grown[node[at_new]]
            grown = np.concatenate((path[t + 1][None, :], step)) if kept else step
            node = np.cumsum(opens) - 1
            path[t + 1] = grown[-1].copy()
        yield low, grown


def nearest(leaves: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each leaf, the lower one on ties, and its squared distance."""
    index, error = np.zeros(len(leaves), dtype=np.int64), np.zeros(len(leaves), dtype=np.int64)
    for low, distances in leaf_distances(leaves, entries):
        best = np.argmin(distances, axis=1)
        index[low : low + len(best)] = best
        error[low : low + len(best)] = distances[np.arange(len(best)), best]
    return index, error


def _trie_row(dim: int, held: list) -> pa.RecordBatch:
    ids, labels = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
    x = np.concatenate([h[2] for h in held])
    ends = cuts(dim)
    tries = [distinct(x[:, a:b]) for a, b in zip(ends, ends[1:])]
    return pa.RecordBatch.from_pydict({
        "dim": pa.array([dim], pa.int32()),
        "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        "labels": pa.ListArray.from_arrays(pa.array([0, len(labels)], pa.int32()), labels),
        "leaves": pa.array([[packed(t[0].astype(np.int32)) for t in tries]], pa.list_(pa.binary())),
        "weights": pa.array([[packed(t[1].astype(np.int64)) for t in tries]], pa.list_(pa.binary())),
        "places": pa.array([[packed(t[2].astype(np.int32)) for t in tries]], pa.list_(pa.binary())),
    })


def _tries(batches):
    """Vectors as rows of tries: of each part position the distinct parts, their weights, and each vector's place."""
    held, size = {}, {}
    for batch in batches:
        lists = batch.column("embedding")
        sizes = np.asarray(lists.value_lengths())
        for dim in np.unique(sizes).tolist():
            at = pa.array(np.flatnonzero(sizes == dim))
            x = whole(np.asarray(lists.take(at).flatten(), dtype=np.float64).reshape(len(at), dim))
            held.setdefault(dim, []).append((batch.column("vec_id").take(at), batch.column("label").take(at), x))
            size[dim] = size.get(dim, 0) + len(at) * max(dim, 1)
            if size[dim] >= COMPONENTS:
                yield _trie_row(dim, held.pop(dim))
                size[dim] = 0
    for dim, some in held.items():
        yield _trie_row(dim, some)


def _tables(row: dict):
    """Per part position: distinct parts as a matrix, weights, and each vector's place among them."""
    ends = cuts(row["dim"])
    for p in range(PARTS):
        weights = np.frombuffer(row["weights"][p], dtype=np.int64)
        leaves = np.frombuffer(row["leaves"][p], dtype=np.int32).reshape(len(weights), ends[p + 1] - ends[p])
        yield leaves.astype(np.int64), weights, row.get("places") and np.frombuffer(row["places"][p], dtype=np.int32)


def _sums(books: dict):
    """The weighted sum of the parts nearest to each entry, and their number as position -1."""
    def run(batches):
        total = {}
        for batch in batches:
            for row in batch.to_pylist():
                for p, (leaves, weights, _) in enumerate(_tables(row)):
                    entries = books[row["dim"]][p]
                    key = (row["dim"], p)
                    if key not in total:
                        total[key] = np.zeros((len(entries), entries.shape[1] + 1), dtype=np.int64)
                    index, _ = nearest(leaves, entries)
                    weighted = np.concatenate((weights[:, None], leaves * weights[:, None]), axis=1)
                    np.add.at(total[key], index, weighted)
        for (dim, p), sums in total.items():
            entry, position = np.nonzero(sums[:, :1] * np.ones_like(sums))
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array(np.full(len(entry), dim), pa.int32()), "part": pa.array(np.full(len(entry), p), pa.int32()),
                "entry": pa.array(entry, pa.int32()), "position": pa.array(position - 1, pa.int32()),
                "total": pa.array(sums[entry, position], pa.int64()),
            })

    return run


def _codes(books: dict):
    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["dim", "leaves", "weights", "places"]).to_pylist()):
                index, error = [], 0
                for p, (leaves, _, places) in enumerate(_tables(row)):
                    best, squared = nearest(leaves, books[row["dim"]][p])
                    index.append(best[places])
                    error = error + squared[places]
                code = np.stack(index, axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("ids").slice(i, 1).flatten(), "label": batch.column("labels").slice(i, 1).flatten(),
                    "dim": pa.array(np.full(len(code), row["dim"]), pa.int32()),
                    "code": pa.array([c.tobytes().hex() for c in code], pa.string()), "error": pa.array(error, pa.int64()),
                })

    return run


def first_books(vectors: DataFrame) -> dict:
    """Of each length of vector, the parts of the 256 smallest ids."""
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    smallest = vectors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ENTRIES)
    by_dim = {}
    for row in smallest.select("dim", "rank", "embedding").orderBy("dim", "rank").collect():
        by_dim.setdefault(row["dim"], []).append(row["embedding"])
    return {
        dim: [whole(np.array(rows, dtype=np.float64).reshape(len(rows), dim))[:, a:b] for a, b in zip(cuts(dim), cuts(dim)[1:])]
        for dim, rows in by_dim.items()
    }


def moved(books: dict, sums: list) -> dict:
    """The books with every used entry at the floored mean of its parts."""
    count = {(r["dim"], r["part"], r["entry"]): r["total"] for r in sums if r["position"] < 0}
    after = {dim: [b.copy() for b in parts] for dim, parts in books.items()}
    for r in sums:
        if r["position"] >= 0:
            key = (r["dim"], r["part"], r["entry"])
            after[key[0]][key[1]][key[2], r["position"]] = r["total"] // count[key]
    return after


def digest(parts: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for entries in parts for x in entries.ravel().tolist()).encode()).hexdigest()


def coded(spark: SparkSession, vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """(vec_id, label, dim, code, error) of every vector, and the codebooks by length of vector."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    books = first_books(rows.withColumn("dim", F.size("embedding")))
    kinds = {name: rows.schema[name].dataType for name in ("vec_id", "label")}
    binary = T.ArrayType(T.BinaryType())
    tries = T.StructType([
        T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(kinds["vec_id"])),
        T.StructField("labels", T.ArrayType(kinds["label"])), T.StructField("leaves", binary),
        T.StructField("weights", binary), T.StructField("places", binary),
    ])
    file = land(rows.mapInArrow(_tries, tries), spark, "part-tries")
    light = file.select("dim", "leaves", "weights")
    for _ in range(rounds):
        sums = light.mapInArrow(_sums(books), "dim int, part int, entry int, position int, total long")
        books = moved(books, sums.groupBy("dim", "part", "entry", "position").agg(F.sum("total").alias("total")).collect())
    out = T.StructType([
        T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"]),
        T.StructField("dim", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
    ])
    return land(file.mapInArrow(_codes(books), out), spark, "codes"), books


def codes(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (error of all rows of the label), codebooks_sha256."""
    rows, books = coded(spark, vectors)
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = left_join_unique(rows, by_label, ["label"], null_safe=True, hot=hot_keys(rows, ["label"]))
    digests = F.lit(None).cast("string")
    for dim, parts in books.items():
        digests = F.when(F.col("dim") == dim, F.lit(digest(parts))).otherwise(digests)
    return joined.select("vec_id", "code", "error", "label_error", digests.alias("codebooks_sha256"))


def oracle() -> str:
    """The same in SQL, for vectors of one length that four divides."""
    def assigned(book):
        # the least of distance * 256 + index is the nearest entry, the lower one on ties
        distance = "list_inner_product(p.part, p.part) - 2 * list_inner_product(p.part, b.e) + list_inner_product(b.e, b.e)"
        return f"SELECT p.row, p.pos, min(CAST({distance} AS BIGINT) * {ENTRIES} + b.entry) AS best FROM p JOIN {book} AS b ON b.pos = p.pos GROUP BY ALL"

    steps = []
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({assigned(f'b{r}')})")
        steps.append(f"""m{r} AS (SELECT pos, entry, list(c ORDER BY i) AS e FROM (SELECT p.pos, a.best % {ENTRIES} AS entry, i, floor(sum(p.part[i]) / count(*)) AS c
 FROM a{r} AS a JOIN p ON p.row = a.row AND p.pos = a.pos, unnest(range(1, len(p.part) + 1)) AS t(i) GROUP BY ALL) GROUP BY ALL)""")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.e, b.e) AS e FROM b{r} AS b LEFT JOIN m{r} AS m ON m.pos = b.pos AND m.entry = b.entry)")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, pos, x[pos * len(x) // {PARTS} + 1 : (pos + 1) * len(x) // {PARTS}] AS part FROM v, range(0, {PARTS}) AS t(pos)),
b0 AS MATERIALIZED (SELECT pos, row AS entry, part AS e FROM p WHERE row < {ENTRIES}),
{", ".join(steps)},
f AS MATERIALIZED ({assigned(f"b{ROUNDS}")}),
c AS (SELECT row, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY pos) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM f GROUP BY row),
s AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY pos, entry, i)) AS digest FROM (SELECT pos, entry, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM b{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM c JOIN v USING (row), s"""
