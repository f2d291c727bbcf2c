"""Documents that hold passages of test items, found by Wu-Manber multi-pattern search over words.

A passage is a run of ten words of an item; an item of fewer words is one passage.
Passages of one length are searched together:

* A block is two consecutive words (one, for passages of a single word). The shift table
  says for each block how far a passage's end lies beyond its last occurrence in any
  passage. The scan reads the block that ends at its position and moves on by the shift:
  over a block that no passage has, by the whole passage but one word.
* Where the shift is none, the passage's last block selects a bucket; its first block,
  the prefix of that bucket's passages, is compared by hash.
* What is left is compared word by word on the bytes, so hashes never decide.

Long documents are cut into lanes of consecutive positions, and all lanes of a batch of
texts are scanned side by side, each moving by its own shifts. Only blocks that the scan
stops at are hashed.

Documents are neither shuffled nor collected. The items are read in chunks of some two
megabytes of text, by a hash of their id; each chunk's tables go to the tasks in turn,
and documents carry what earlier chunks found, so the items may grow without bound.

Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased.
Null and empty texts have no words. Items without an id or a word take no part; items
that repeat with the same id count once. Repeated documents are judged each on its own;
without documents there are no rows, without items nothing is hit. Of the documents
only doc_id and text are read, of the items item_id and text.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.hashing import mix, pieces
from panelspark.llm.terms import Terms, positions
from panelspark.session import discard, scratch_dir

WIDTH = 10
CHUNK_BYTES = 2 << 20
LANE = 64
SLOT_BITS = 18
CONFIRM = 1 << 16


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) ^ b)


class Passages:
    """Shift table and buckets of the distinct passages of one length."""

    def __init__(self, terms: Terms, length: int, starts: np.ndarray, items: np.ndarray):
        self.length, self.terms = length, terms
        self.block = min(2, length)
        # equal passages are one, with all items that have it
        at, words = {}, [terms.text(i) for i in range(len(terms))]
        number = np.array([at.setdefault(b" ".join(words[s : s + length]), len(at)) for s in starts.tolist()], dtype=np.int64)
        _, one = np.unique(number, return_index=True)
        self.starts = starts[one]
        who = np.unique(np.stack((number, items), axis=1), axis=0)
        self.items, self.item_from = who[:, 1], np.searchsorted(who[:, 0], np.arange(len(at) + 1))

        keys = terms.keys()
        blocks = keys if self.block == 1 else np.concatenate((keys[:1], _joined(keys[:-1], keys[1:])))
        self.shift = np.full(1 << SLOT_BITS, length - self.block + 1, dtype=np.int16)
        for end in range(self.block - 1, length):
            np.minimum.at(self.shift, self.slot(blocks[self.starts + end]), length - 1 - end)
        bucket = _joined(blocks[self.starts + length - 1], blocks[self.starts + self.block - 1])
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.member = bucket[order], order

    @staticmethod
    def slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def blocks_at(self, text: Terms, ends: np.ndarray) -> np.ndarray:
        if self.block == 1:
            return text.keys(ends)
        return _joined(text.keys(ends - 1), text.keys(ends))

    def occurrences(self, text: Terms) -> tuple[np.ndarray, np.ndarray]:
        """First word and passage of every occurrence in the texts."""
        last = self.length - 1
        ends = np.maximum(np.diff(text.first) - last, 0)
        lanes = -(-ends // LANE)
        at, doc = positions(lanes, np.zeros(len(lanes), dtype=np.int64))
        pos = text.first[:-1][doc] + last + at * LANE
        until = np.minimum(pos + LANE, text.first[1:][doc])
        stops, stopped_on = [], []
        while len(pos):
            blocks = self.blocks_at(text, pos)
            shift = self.shift[self.slot(blocks)]
            found = shift == 0
            stops.append(pos[found]), stopped_on.append(blocks[found])
            pos = pos + np.maximum(shift, 1)
            inside = pos < until
            pos, until = pos[inside], until[inside]
        if not stops:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return self._confirmed(text, np.concatenate(stops) - last, np.concatenate(stopped_on))

    def _confirmed(self, text: Terms, first: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = _joined(blocks, self.blocks_at(text, first + self.block - 1))
        low, high = np.searchsorted(self.bucket, bucket, side="left"), np.searchsorted(self.bucket, bucket, side="right")
        member, which = positions(high - low, low)
        first, passage = first[which], self.member[member]
        same = np.empty(len(first), dtype=bool)
        words = np.arange(self.length)
        for at in range(0, len(first), CONFIRM // self.length + 1):
            some = slice(at, at + CONFIRM // self.length + 1)
            mine = (first[some][:, None] + words).ravel()
            theirs = (self.starts[passage[some]][:, None] + words).ravel()
            same[some] = text.equal(mine, self.terms, theirs).reshape(-1, self.length).all(axis=1)
        return first[same], passage[same]


def tables(texts: list[str], width: int = WIDTH) -> list[Passages]:
    """The passages of some items, by length; items are numbered in the order given."""
    terms = Terms(pa.array(texts, pa.large_string()))
    sizes = np.diff(terms.first)
    out = []
    for length in np.unique(np.minimum(sizes, width)):
        if length:
            items = np.flatnonzero(np.minimum(sizes, width) == length)
            at, which = positions(sizes[items] - length + 1, terms.first[items])
            out.append(Passages(terms, int(length), at, items[which]))
    return out


_built = {}


def _tables_once(key: str, texts: list[str], width: int) -> list[Passages]:
    """Built once in a worker for each chunk; only the last chunk is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = tables(texts, width)
    return _built[key]


def hits(texts: pa.Array, searched: list[Passages], names: np.ndarray):
    """Number of words of each text, which words are hit (all texts in a row), and the items found as (text, name) pairs."""
    text = Terms(texts)
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    pairs = [np.empty((0, 2), dtype=np.int64)]
    for passages in searched:
        first, passage = passages.occurrences(text)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + passages.length, -1)
        doc = np.searchsorted(text.first, first, side="right") - 1
        seen = np.unique(np.stack((doc, passage), axis=1), axis=0)
        at, which = positions(np.diff(passages.item_from)[seen[:, 1]], passages.item_from[seen[:, 1]])
        pairs.append(np.stack((seen[which, 0], names[passages.items[at]]), axis=1))
    return text.first, np.cumsum(edge[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def _runs(first: np.ndarray, hit: np.ndarray) -> pa.Array:
    """Runs of hit words of each text, as first and last word."""
    start = np.zeros(len(hit) + 1, dtype=bool)
    start[first] = True
    before = np.concatenate(([False], hit[:-1])) if len(hit) else hit
    after = np.concatenate((hit[1:], [False])) if len(hit) else hit
    opens = np.flatnonzero(hit & (~before | start[:-1]))
    closes = np.flatnonzero(hit & (~after | start[1:]))
    cut = np.searchsorted(opens, first)
    base = first[np.searchsorted(first, opens, side="right") - 1]
    run = pa.StructArray.from_arrays([pa.array(opens - base, pa.int64()), pa.array(closes - base, pa.int64())], ["first", "last"])
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), run)


def _scan(key: str, texts: list[str], ids: list[str], width: int, keep_text: bool):
    """One chunk of items against every document; what earlier chunks found is carried on."""
    def run(batches):
        distinct = sorted(set(ids))
        place = {name: i for i, name in enumerate(distinct)}
        names = np.array([place[i] for i in ids], dtype=np.int64)
        searched = _tables_once(key, texts, width)
        for batch in batches:
            low = 0
            for some in pieces(batch.column("text")):
                rows = batch.slice(low, len(some))
                low += len(some)
                first, hit, pairs = hits(some, searched, names)
                known = rows.column("hit").to_pylist()
                before = rows.column("items").to_pylist()
                found = np.searchsorted(pairs[:, 0], np.arange(len(some) + 1))
                packed = []
                for i, earlier in enumerate(known):
                    mine = hit[first[i] : first[i + 1]]
                    if earlier:
                        mine |= np.unpackbits(np.frombuffer(earlier, dtype=np.uint8), count=len(mine)).astype(bool)
                    packed.append(np.packbits(mine).tobytes() if keep_text else None)
                items = [b + [distinct[p] for p in pairs[found[i] : found[i + 1], 1]] for i, b in enumerate(before)]
                totals = np.concatenate(([0], np.cumsum(hit)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "text": some if keep_text else pa.nulls(len(some), pa.string()),
                    "n_words": pa.array(np.diff(first), pa.int64()), "n_hit": pa.array(np.diff(totals[first]), pa.int64()),
                    "hit": pa.array(packed, pa.binary()), "items": pa.array(items, pa.list_(pa.string())), "runs": _runs(first, hit),
                })

    return run


def contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids found, as sorted strings) and runs (first and last word of each hit run)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = -(-size // chunk_bytes) or 1
    state = documents.select(
        "doc_id", F.col("text").cast("string").alias("text"),
        F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"),
    )
    run = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    out = T.StructType([
        T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("text", T.StringType()),
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit", T.BinaryType()),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", run),
    ])
    written = None
    for c in range(chunks):
        # a chunk of bounded text: its share of the ids by hash
        chunk = items.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == c).orderBy("item_id", "text").collect()
        last = c == chunks - 1
        key = f"{spark.sparkContext.applicationId}-{id(state)}-{c}"
        found = state.mapInArrow(_scan(key, [r["text"] for r in chunk], [r["item_id"] for r in chunk], width, not last), out)
        if last:
            state = found
            break
        carried, before, written = found.select("doc_id", "text", "hit", "items"), written, scratch_dir(spark, "decontaminated")
        carried.write.parquet(written)
        if before:
            discard(spark, before)
        state = spark.read.schema(carried.schema).parquet(written)
    return state.select("doc_id", "n_words", "n_hit", F.array_sort(F.array_distinct("items")).alias("items"), "runs")


def oracle(width: int = WIDTH) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH b AS (SELECT item_id, {words} AS ws FROM benchmark WHERE item_id IS NOT NULL),
p AS MATERIALIZED (SELECT DISTINCT item_id, least(len(ws), {width}) AS n, ws[i : i + least(len(ws), {width}) - 1] AS passage
 FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), {width}) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {words} AS ws FROM documents),
w AS (SELECT row, i, n, ws[i : i + n - 1] AS passage FROM (SELECT row, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)),
o AS MATERIALIZED (SELECT row, i, n, item_id FROM w JOIN p USING (n, passage)),
h AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(i, i + n)) AS at FROM o) GROUP BY row),
f AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM o) GROUP BY row)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN f USING (row)"""
