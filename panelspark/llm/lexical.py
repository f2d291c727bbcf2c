"""Exact ranked lexical search with per-term geometric blocks.

Each test item is a query. A document's score is the sum over the item's terms of the
term's weight times a saturated, length-adjusted frequency, all in whole numbers:
w = floor(1000 ln((2N+2)/(2df+1))) and w * ((10^9 tf) div (1000 tf + 20 m)), where
m = 50 + (50 n N) div L.

1. One pass over the documents counts N, L and the document frequencies, and writes each
   document's terms as far as any item has them (the forward file).
2. A task indexes some ten thousand documents of the forward file at a time. A term's
   posting list is clustered by document similarity: spread pivots of the list are
   chosen, each document goes to the nearest by a projection of its weighted terms, and
   clusters are cut into blocks. A block's summary is the coordinatewise maximum of its
   documents' contributions, exact whole numbers, kept for the terms that occur in an
   item together with the list's term.
3. An item walks the lists of its terms from the largest possible contribution down. The
   inner product of its weights with a block's summary bounds the score of every
   document in it that no earlier list had. A block is skipped only if that bound is
   below the item's threshold, the k-th best score known; a list is left, with all
   that follow, only if the largest contributions of the remaining lists together are
   below it. Every other document is scored on all its terms.
4. One sixteenth of the documents is searched first. The k-th best scores found there are
   thresholds for the rest, and its results stay: no document is searched twice.

Only an item's best k of each task move between tasks. Items are taken in chunks of a
bounded amount of text by a hash of their id, so they may grow without bound; a chunk's
vocabulary, its document frequencies and thresholds are what the driver holds.

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Null
and empty texts have no terms and do not count in N. Items without an id, or without a
term that any document has, have no results; items that share an id are one item with
the terms of all. Documents without an id take no part; repeated ones are documents of
their own. Equal scores are ranked by doc_id. Without documents or items there are no
rows. Only doc_id, text and item_id, text are read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.hashing import pieces
from panelspark.llm.terms import Terms, positions
from panelspark.session import land

CHUNK_BYTES = 2 << 20
FIRST_OF = 16  # one of so many documents is searched first
SHARD_ENTRIES, SHARD_DOCUMENTS = 1 << 21, 1 << 15
BLOCK, AT_ONCE = 64, 8
SKETCH = 16
FILTER_BITS = 18


class Vocabulary:
    """The distinct terms of a chunk of items, and the terms of each item."""

    def __init__(self, items: list[tuple[str, str]]):
        texts = Terms(pa.array([t for _, t in items], pa.large_string()))
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        words = sorted({texts.text(i) for i in range(len(texts))})
        number = {w: i for i, w in enumerate(words)}
        of_item = [set() for _ in self.names]
        for (name, _), low, high in zip(items, texts.first, texts.first[1:]):
            of_item[place[name]].update(number[texts.text(i)] for i in range(low, high))
        self.items = [np.array(sorted(s), dtype=np.int64) for s in of_item]
        self.words = words
        self._looked_up = None

    def __len__(self):
        return len(self.words)

    def __getstate__(self):
        return {"names": self.names, "items": self.items, "words": self.words, "_looked_up": None}

    def number(self, text: Terms) -> np.ndarray:
        """The number of each term of the texts, -1 for one that no item has."""
        if self._looked_up is None:
            terms = Terms(pa.array([w.decode() for w in self.words], pa.large_string()))
            seed = 0
            while True:
                keys = terms.keys(seed=seed)
                if len(np.unique(keys)) == len(keys):
                    break
                seed += 1
            order = np.argsort(keys)
            maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
            maybe[keys >> np.uint64(64 - FILTER_BITS)] = True
            self._looked_up = terms, seed, keys[order], order, maybe
        terms, seed, keys, order, maybe = self._looked_up
        out = np.full(len(text), -1, dtype=np.int64)
        if not len(terms) or not len(text):
            return out
        mine = text.keys(seed=seed)
        some = np.flatnonzero(maybe[mine >> np.uint64(64 - FILTER_BITS)])
        at = np.minimum(np.searchsorted(keys, mine[some]), len(keys) - 1)
        alike = keys[at] == mine[some]
        some, at = some[alike], order[at[alike]]
        same = text.equal(some, terms, at)
        out[some[same]] = at[same]
        return out


def _forward(vocabulary: Vocabulary):
    """doc_id, number of terms, and the items' terms among them with their counts, of each document that has a term."""
    def run(batches):
        for batch in batches:
            low = 0
            for some in pieces(batch.column("text")):
                ids = batch.column("doc_id").slice(low, len(some))
                low += len(some)
                text = Terms(some)
                number = vocabulary.number(text)
                known = np.flatnonzero(number >= 0)
                doc = np.searchsorted(text.first, known, side="right") - 1
                pair, count = np.unique(doc * max(len(vocabulary), 1) + number[known], return_counts=True)
                n = np.diff(text.first)
                at = np.searchsorted(pair, np.arange(len(n) + 1) * max(len(vocabulary), 1))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32()))
                         for v in (pair % max(len(vocabulary), 1), count)]
                out = pa.RecordBatch.from_pydict({"doc_id": ids, "n": pa.array(n, pa.int64()), "terms": lists[0], "counts": lists[1]})
                yield out.filter(pa.array(n > 0))

    return run


class Blocks:
    """The posting list of one term in blocks of similar documents, with their summaries."""

    def __init__(self, shard: "Shard", term: int, relevant: np.ndarray):
        docs = shard.docs_of(term)
        k = -(-len(docs) // BLOCK)
        if k > 1:
            pivots = docs[np.arange(k) * len(docs) // k]
            nearest = np.argmax(shard.sketch[docs] @ shard.sketch[pivots].T, axis=1)
            order = np.argsort(nearest, kind="stable")
            docs, nearest = docs[order], nearest[order]
            into = np.arange(len(docs)) - np.searchsorted(nearest, nearest)
            new = np.concatenate(([True], (nearest[1:] != nearest[:-1]) | (into[1:] % BLOCK == 0)))
            block = np.cumsum(new) - 1
        else:
            block = np.zeros(len(docs), dtype=np.int64)
        self.docs, self.n = docs, int(block[-1]) + 1
        self.cut = np.searchsorted(block, np.arange(self.n + 1))
        # coordinatewise maxima, by term and block
        entry, which = positions(np.diff(shard.cut)[docs], shard.cut[docs])
        kept = relevant[shard.terms[entry]]
        entry, which = entry[kept], block[which[kept]]
        cell = shard.terms[entry] * self.n + which
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, dtype=np.int64)
        self.most = np.maximum.reduceat(shard.gain[entry][order], at) if len(at) else np.empty(0, dtype=np.int64)
        self.of_block = cell[at] % self.n
        self.terms, self.term_from = np.unique(cell[at] // self.n, return_index=True)
        self.term_from = np.append(self.term_from, len(at))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The inner product of the weights with each block's summary."""
        out = np.zeros(self.n, dtype=np.int64)
        at = np.searchsorted(self.terms, terms)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == terms[there]
        at = at[there]
        cell, which = positions(np.diff(self.term_from)[at], self.term_from[at])
        np.add.at(out, self.of_block[cell], self.most[cell] * weights[there][which])
        return out


class Shard:
    """Some documents with their terms' contributions, and posting lists blocked when first walked."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, stats: dict):
        self.ids, self.terms = ids, terms
        self.cut = np.concatenate(([0], np.cumsum(sizes)))
        self.doc = np.repeat(np.arange(len(ids)), sizes)
        m = 50 + (50 * n * stats["N"]) // stats["L"]
        self.gain = (1_000_000_000 * counts) // (1000 * counts + 20 * m[self.doc])
        order = np.argsort(terms, kind="stable")
        self.posting = self.doc[order]
        self.posting_from = np.searchsorted(terms[order], np.arange(len(stats["weights"]) + 1))
        self.most = np.zeros(len(stats["weights"]), dtype=np.int64)
        np.maximum.at(self.most, terms, self.gain)
        self.weights, self.beside = stats["weights"], stats["beside"]
        self.sketch = self._sketch()
        self.blocked, self.seen, self.asked = {}, np.zeros(len(ids), dtype=bool), np.zeros(len(stats["weights"]), dtype=np.int64)

    def _sketch(self) -> np.ndarray:
        """A projection of the weighted contributions on a few directions, of length one."""
        directions = np.random.default_rng(11).standard_normal((len(self.weights), SKETCH)).astype(np.float32)
        value = (self.gain * self.weights[self.terms]).astype(np.float32)
        out = np.zeros((len(self.ids), SKETCH), dtype=np.float32)
        full = np.flatnonzero(np.diff(self.cut))
        for d in range(SKETCH if len(full) else 0):
            out[full, d] = np.add.reduceat(value * directions[self.terms, d], self.cut[full])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def docs_of(self, term: int) -> np.ndarray:
        return self.posting[self.posting_from[term] : self.posting_from[term + 1]]

    def blocks(self, term: int) -> Blocks:
        if term not in self.blocked:
            self.blocked[term] = Blocks(self, term, self.beside(term))
        return self.blocked[term]

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Full scores of documents that have a term, for the weights in ``asked``."""
        sizes = np.diff(self.cut)[docs]
        entry, _ = positions(sizes, self.cut[docs])
        return np.add.reduceat(self.gain[entry] * self.asked[self.terms[entry]], np.cumsum(sizes) - sizes)

    def search(self, terms: np.ndarray, best: "Best") -> None:
        """Every document that can be among the item's best joins ``best``."""
        weights = self.weights[terms]
        most = self.most[terms] * weights
        order = np.argsort(-most, kind="stable")
        order = order[most[order] > 0]
        terms, weights, most = terms[order], weights[order], most[order]
        remaining = np.cumsum(most[::-1])[::-1]
        self.asked[terms] = weights
        touched = []
        for i, term in enumerate(terms):
            if remaining[i] < best.threshold:
                break
            blocks = self.blocks(int(term))
            # documents that an earlier list has were decided there: the bound leaves its term out
            bound = blocks.bounds(terms[i:], weights[i:])
            by_bound = np.argsort(-bound, kind="stable")
            for at in range(0, len(by_bound), AT_ONCE):
                some = by_bound[at : at + AT_ONCE]
                some = some[bound[some] >= best.threshold]
                if not len(some):
                    break
                cell, _ = positions(np.diff(blocks.cut)[some], blocks.cut[some])
                docs = blocks.docs[cell]
                docs = docs[~self.seen[docs]]
                if len(docs):
                    self.seen[docs] = True
                    touched.append(docs)
                    best.add(self.ids[docs], self.scores(docs))
        for docs in touched:
            self.seen[docs] = False
        self.asked[terms] = 0


class Best:
    """The k best results of an item so far; what scores below the threshold is not among them."""

    def __init__(self, k: int, threshold: int):
        self.k, self.threshold = k, max(threshold, 1)
        self.ids, self.scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.threshold
        if good.any():
            ids, scores = np.append(self.ids, ids[good]), np.append(self.scores, scores[good])
            order = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[order], scores[order]
            if len(order) == self.k:
                self.threshold = max(self.threshold, int(self.scores[-1]))


def _search(items: list[np.ndarray], names: list[str], stats: dict, thresholds: list[int], k: int):
    """The k best documents of each item among a task's, as far as they reach the thresholds."""
    def run(batches):
        inside = np.concatenate([np.full(len(t), i) for i, t in enumerate(items)]) if items else np.empty(0, dtype=np.int64)
        flat = np.concatenate(items) if items else np.empty(0, dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        inside, term_from = inside[order], np.searchsorted(flat[order], np.arange(len(stats["weights"]) + 1))

        def beside(term):
            """Which terms occur in an item together with this one."""
            out = np.zeros(len(stats["weights"]), dtype=bool)
            for i in inside[term_from[term] : term_from[term + 1]]:
                out[items[i]] = True
            return out

        best = [Best(k, t) for t in thresholds]
        held, entries, documents = [], 0, 0

        def searched():
            ids = np.concatenate([h[0] for h in held])
            shard = Shard(ids, *[np.concatenate([h[i] for h in held]) for i in (1, 2, 3, 4)], stats | {"beside": beside})
            for terms, so_far in zip(items, best):
                shard.search(terms, so_far)

        for batch in batches:
            for low in range(0, batch.num_rows, SHARD_DOCUMENTS // 8):
                rows = batch.slice(low, SHARD_DOCUMENTS // 8)
                terms = rows.column("terms")
                held.append((
                    np.asarray(rows.column("doc_id"), dtype=np.int64), np.asarray(rows.column("n"), dtype=np.int64),
                    np.asarray(terms.value_lengths(), dtype=np.int64), np.asarray(terms.flatten(), dtype=np.int64),
                    np.asarray(rows.column("counts").flatten(), dtype=np.int64),
                ))
                entries, documents = entries + len(held[-1][3]), documents + rows.num_rows
                if entries >= SHARD_ENTRIES or documents >= SHARD_DOCUMENTS:
                    searched()
                    held, entries, documents = [], 0, 0
        if held:
            searched()
        for name, found in zip(names, best):
            if len(found.ids):
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array([name] * len(found.ids), pa.string()), "doc_id": found.ids, "score": found.scores,
                })

    return run


def _chunk(spark: SparkSession, documents: DataFrame, items: list[tuple[str, str]], k: int) -> DataFrame:
    vocabulary = Vocabulary(items)
    kind = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
    ])
    forward = land(documents.mapInArrow(_forward(vocabulary), kind), spark, "forward")
    totals = forward.agg(F.count("*").alias("N"), F.sum("n").alias("L"), F.sum(F.size("terms")).alias("entries")).first()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for row in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[row["term"]] = math.floor(1000 * math.log((2 * totals["N"] + 2) / (2 * row["count"] + 1)))
    stats = {"N": totals["N"], "L": totals["L"] or 1, "weights": weights}

    first = F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_OF)) == 0
    some = forward.where(F.size("terms") > 0)
    tasks = -(-(totals["entries"] or 0) // (FIRST_OF * SHARD_ENTRIES)) or 1
    out = "item_id string, doc_id long, score long"
    asked = _search(vocabulary.items, vocabulary.names, stats, [1] * len(vocabulary.names), k)
    found = land(some.where(first).repartition(tasks).mapInArrow(asked, out), spark, "first-results")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    kth = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("item_id", "score").collect()
    at_least = {r["item_id"]: r["score"] for r in kth}
    asked = _search(vocabulary.items, vocabulary.names, stats, [at_least.get(n, 1) for n in vocabulary.names], k)
    rest = some.where(~first).mapInArrow(asked, out)
    return found.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, k: int = 50, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above zero for each item."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = -(-size // chunk_bytes) or 1
    out = None
    for c in range(chunks):
        # a chunk of bounded text: its share of the ids by hash
        chunk = items.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c).orderBy("item_id", "text").collect()
        found = _chunk(spark, texts, [(r["item_id"], r["text"]) for r in chunk], k)
        if chunks > 1:
            found = land(found, spark, "ranked")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item_id").cast(benchmark.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score")


def oracle(k: int = 50) -> str:
    def terms(table):
        lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM {table}"

    return f"""WITH d AS MATERIALIZED (SELECT doc_id, {terms("documents")} WHERE doc_id IS NOT NULL),
c AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
f AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
i AS (SELECT DISTINCT item_id, unnest(ts) AS term FROM (SELECT item_id, {terms("benchmark")}) WHERE item_id IS NOT NULL),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
 FROM i JOIN w USING (term) JOIN f USING (term), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {k}"""
