"""Near-duplicate texts by min-max hashing, with links confirmed on full sets.

A text's set is its distinct word shingles, lower-cased from A to Z. Every
permutation of the hash space gives two signature values, the smallest and the
largest hash of the set, so half as many hash evaluations do. Runs of signature
values are bands; texts that agree on a band are candidates. The values of a band
follow from the limit, so that a pair at the limit is missed once in five million
cases: 7 values in each of 40 bands at 0.85, 5 at 0.80.

1. Texts with equal word sequences are one class, known by its smallest id.
2. Classes that share a band hang on the band's smallest class; components of these
   proposed links are clusters.
3. A cluster is cut into blocks of bounded size, and every two blocks meet in one
   task. There each set is compared with all others of fitting size, and of the
   confirmed links a spanning forest is kept. Links between all pairs of a group are
   never made.
4. Components of the confirmed links are the result.

Work within a cluster of different, mutually similar texts grows with the square of
its size; copies cost nothing. Null and empty texts, and those without words, have
empty sets and no links; neither have rows without an id, whose component is null.
Rows that share an id count as one document that has each of their texts. Other
columns are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.components import components
from panelspark.llm.hashing import mix, pieces, sequence_hash, shingle_sets, word_keys
from panelspark.llm.membership import Members
from panelspark.session import land

WIDTH = 5
SIMILAR = 85  # hundredths
BANDS, ROWS = 40, 7  # at least, and at most
PERMUTATIONS = BANDS * ROWS // 2
MISSED = 2e-7  # of the pairs whose similarity is the limit
BLOCK = 128
PIECE = 1 << 15  # hashes that are permuted at a time, so that they stay in the processor's cache

SIGNATURE = "n_shingles long, high long, low long, bands array<long>"


def banding(similar: int) -> tuple[int, int]:
    """How many bands of how many values: the longest bands that miss few enough pairs, and more than BANDS of one value at low limits."""
    if not 1 <= similar <= 100:
        raise ValueError(f"similar is in hundredths from 1 to 100: {similar}")
    s = similar / 100
    for values in range(ROWS, 0, -1):
        if (1 - s**values) ** BANDS <= MISSED:
            return BANDS, values
    return math.ceil(math.log(MISSED) / math.log(1 - s)), 1


def _multipliers(permutations: int = PERMUTATIONS) -> np.ndarray:
    return mix(np.arange(1, permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(hashes: np.ndarray, cut: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """A row of least and greatest permuted hashes for each non-empty set."""
    out = np.empty((len(cut) - 1, 2 * permutations), dtype=np.uint64)
    out[:, 0::2], out[:, 1::2] = np.uint64(0xFFFFFFFFFFFFFFFF), 0
    factors = _multipliers(permutations)
    for low in range(0, len(hashes), PIECE):
        high = min(low + PIECE, len(hashes))
        first = int(np.searchsorted(cut, low, side="right")) - 1
        last = int(np.searchsorted(cut, high, side="left"))
        at = np.maximum(cut[first:last] - low, 0)
        piece = hashes[low:high]
        for k, factor in enumerate(factors):
            moved = piece * factor
            np.minimum(out[first:last, 2 * k], np.minimum.reduceat(moved, at), out=out[first:last, 2 * k])
            np.maximum(out[first:last, 2 * k + 1], np.maximum.reduceat(moved, at), out=out[first:last, 2 * k + 1])
    return out


def band_keys(signature: np.ndarray, bands: int, values: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    n = len(signature)
    parts = signature[:, : bands * values].reshape(n, bands, values)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
    for k in range(values):
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return keys


def _described(texts: pa.Array, similar: int) -> list[pa.Array]:
    n_bands, values = banding(similar)
    words, first = word_keys(texts, lower=True)
    high, low = sequence_hash(words, first, 1), sequence_hash(words, first, 2)
    hashes, cut = shingle_sets(texts, WIDTH)
    size = np.diff(cut)
    full = np.flatnonzero(size)
    sets = cut[np.append(full, len(size))] if len(full) else np.zeros(1, dtype=np.int64)
    permutations = -(-n_bands * values // 2)
    keys = band_keys(signatures(hashes, sets, permutations), n_bands, values) if len(full) else np.empty((0, n_bands), dtype=np.uint64)
    ends = np.concatenate(([0], np.cumsum((size > 0) * n_bands))).astype(np.int32)
    bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
    return [pa.array(size.astype(np.int64)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), bands]


def describe(text, similar: int = SIMILAR):
    """Set size, 128-bit hash of the word sequence, and band keys of each text."""
    banding(similar)

    @F.arrow_udf(f"struct<{SIGNATURE.replace(' ', ':').replace(',:', ',')}>")
    def described(texts: pa.Array) -> pa.Array:
        parts = [_described(p, similar) for p in pieces(texts)]
        names = ["n_shingles", "high", "low", "bands"]
        if not parts:
            parts = [_described(texts, similar)]
        return pa.StructArray.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], names)

    return described(text)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def union(self, i: int, j: int) -> bool:
        a, b = int(i), int(j)
        while self.parent[a] != a:
            a = int(self.parent[a])
        while self.parent[b] != b:
            b = int(self.parent[b])
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def confirmed(hashes: np.ndarray, cut: np.ndarray, side: np.ndarray | None, similar: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; with sides, only of links from one side to the other."""
    order = np.argsort(np.diff(cut), kind="stable")
    size = np.diff(cut)[order]
    _, name, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times[name] > 1
    parts = [name[cut[i] : cut[i + 1]][shared[cut[i] : cut[i + 1]]] for i in order]
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    mark = np.zeros(len(times) + 1, dtype=np.int32)
    forest, links = Forest(len(order)), []
    for i in range(len(order) - 1):
        high = int(np.searchsorted(size, size[i] * 100 // similar, side="right"))
        if high <= i + 1 or at[i] == at[i + 1]:
            continue
        roots = forest.roots()
        others = np.arange(i + 1, high)
        others = others[roots[others] != roots[i]]
        if side is not None:
            others = others[side[order[others]] != side[order[i]]]
        if not len(others):
            continue
        mark[parts[i]] = 1
        total = np.concatenate(([0], np.cumsum(mark[flat[at[i + 1] : at[high]]])))
        both = (total[at[others + 1] - at[i + 1]] - total[at[others] - at[i + 1]]).astype(np.int64)
        mark[parts[i]] = 0
        for j in others[(100 + similar) * both >= similar * (size[i] + size[others])]:
            if forest.union(i, j):
                links.append((int(order[i]), int(order[j])))
    return links


def _compare(similar):
    def run(table: pa.Table) -> pa.Table:
        texts = table.column("text").combine_chunks()
        nodes = np.asarray(table.column("node"))
        side = np.asarray(table.column("block"))
        hashes, cut = shingle_sets(texts, WIDTH)
        links = confirmed(hashes, cut, side if side.min() != side.max() else None, similar)
        pairs = np.array(links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[pairs[:, 0]], "b": nodes[pairs[:, 1]]})

    return run


def _clusters_in_blocks(clusters: DataFrame, block: int) -> DataFrame:
    """Each member of a cluster once for every pair of blocks that its own block belongs to."""
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        # with an exchange of its own on either side, the optimizer can split the tasks of a large cluster
        clusters.join(sizes.repartition(F.xxhash64("component")), "component")
        .select("node", "component", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), other.alias("other"))
        .select("node", "component", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    )


def classes(spark: SparkSession, documents: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of documents."""
    rows = documents.select("doc_id", describe(F.col("text"), similar).alias("d")).select("doc_id", "d.*")
    rows = land(rows, spark, "minhash-rows")
    linked = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    distinct = land(linked.groupBy("high", "low").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")), spark, "minhash-classes")
    banded = distinct.select("node", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most")
    proposed = banded.join(least, "band").where("node <> least").select("node", "least").distinct()
    clusters = components(spark, proposed)
    # only texts that may be of a cluster's members move
    texts = Members(clusters.select("node")).possible(documents.select(F.col("doc_id").alias("node"), "text"), "node")
    links = (
        _clusters_in_blocks(clusters, BLOCK).join(texts, "node")
        .groupBy("component", "one", "two").applyInArrow(_compare(similar), "a long, b long")
    )
    found = components(spark, links)
    named = distinct.select("high", "low", "node").join(found, "node", "left").select("high", "low", F.coalesce("component", "node").alias("class_id"))
    in_class = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    key = [F.when(in_class, F.col(c)).alias(f"{c}_key") for c in ("high", "low")]
    component = F.coalesce("class_id", "doc_id")
    return (
        rows.select("doc_id", "n_shingles", *key)
        .join(named, (F.col("high_key") == F.col("high")) & (F.col("low_key") == F.col("low")), "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    )


def deduplicated(spark: SparkSession, documents: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The rows of documents of which their component keeps the id, with all their columns."""
    dropped = land(classes(spark, documents, similar).where("NOT kept").select("doc_id").distinct(), spark, "minhash-dropped")
    members = Members(dropped)
    # most rows are none of the dropped for sure and stay where they are; the ids of the others are compared
    unsure = members.possible(documents, "doc_id").join(dropped.hint("shuffle_hash"), "doc_id", "left_anti")
    return members.impossible(documents, "doc_id").unionByName(unsure.select(documents.columns))


def oracle(similar: int = SIMILAR) -> str:
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + {WIDTH - 1}], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WIDTH - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * common >= {similar} * (x.n + y.n - common)),
r AS (SELECT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT node, min(reached) AS component FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id, coalesce(c.component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id"""
