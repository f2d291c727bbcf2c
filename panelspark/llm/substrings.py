"""Removal of word sequences that an earlier document has, by difference-cover anchors.

A window is a run of 13 words. The residues 1, 2 and 4 modulo 7 are a difference
cover: for any two positions there is a shift below 7 that takes both to such
residues. Two equal windows therefore share, at one of their first seven words, an
anchor: a run of seven words that begins at a cover position in both documents. Only
anchors (three of seven positions) are compared across the corpus; where an anchor
is shared, it is extended to the windows that hold it, and these are compared whole.

1. Documents are cut into blocks by ranges of their ids, so that a smaller id is in an
   earlier block or in the same one.
2. Each block sends its distinct anchors to buckets by hash, sorted and delta-coded.
   A bucket answers with one bit for each: whether another block has it too.
3. Each block sends the hashes (96 bits) of its distinct windows that hold a shared
   anchor. A bucket answers with one bit for each: whether an earlier block has it.
4. Each block removes what these bits and its own documents' windows cover.

A bucket gets a passage once from each block at most, however many documents have it.
The number of blocks and buckets is the number of shuffle partitions, so a task holds
a block as it would hold any other shuffle partition.

Null and empty texts have no words. Documents of fewer than 13 words lose none. Rows
that share an id are not smaller than each other. Rows without an id neither lose
words nor make others lose any. Only doc_id and text are read.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.hashing import text_bytes, window_hashes, windows_by_text, word_keys, word_spans

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
ANCHOR_BITS = 48

_MESSAGE = "kind string, bucket int, block int, n long, data binary"


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, byte plane by byte plane: most planes are zeros and compress away."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _cuts(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending numbers of so many bits."""
    limits = [(i << bits) // buckets for i in range(buckets)]
    return np.append(np.searchsorted(values, np.array(limits, dtype=np.uint64)), len(values))


class Block:
    """The documents of one block in order of their ids and texts, with their words' hashes.

    Every step sees a block's rows in an order of its own, as they happen to arrive;
    bits that stand for places need this one order.
    """

    def __init__(self, table: pa.Table):
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))
        ids = table.column("doc_id").combine_chunks()
        texts = table.column("text").combine_chunks()
        self.row_ids, self.texts = ids, texts
        known = ~np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0), dtype=np.int64)
        self.words, self.first = word_keys(texts)
        self.size = np.diff(self.first) * known  # rows without an id have no windows

    def _whole(self, width: int):
        """Windows of so many words in documents that have a whole 13-word window: starts and document numbers."""
        at, count = windows_by_text(self.first, width)
        doc = np.repeat(np.arange(len(self.size)), count)
        keep = self.size[doc] >= WINDOW
        return at[keep], doc[keep]

    def anchors(self):
        """Hash, first word and document number of each anchor."""
        at, doc = self._whole(ANCHOR)
        residue = (at - self.first[:-1][doc]) % PERIOD
        cover = np.zeros(PERIOD, dtype=bool)
        cover[list(COVER)] = True
        at, doc = at[cover[residue]], doc[cover[residue]]
        return window_hashes(self.words, ANCHOR)[at] >> np.uint64(64 - ANCHOR_BITS), at, doc

    def windows_with(self, anchored: np.ndarray) -> np.ndarray:
        """First words of the windows that hold, at their first seven words, one of the anchors that begin at these."""
        mark = np.zeros(len(self.words) + 1, dtype=np.int32)
        mark[anchored + 1] = 1
        total = np.cumsum(mark)
        at, _ = self._whole(WINDOW)
        return at[total[np.minimum(at + PERIOD, len(self.words))] > total[at]]

    def window_keys(self, at: np.ndarray):
        """Two hashes, of 64 and 32 bits, of the windows that begin at these words."""
        high = window_hashes(self.words, WINDOW, 1)[at]
        low = window_hashes(self.words, WINDOW, 2)[at] >> np.uint64(32)
        return high, low

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def _messages(kind, rows, block) -> pa.Table:
    """rows: (bucket, n, data)."""
    return pa.table({
        "kind": pa.array([kind] * len(rows), pa.string()),
        "bucket": pa.array([r[0] for r in rows], pa.int32()),
        "block": pa.array([block] * len(rows), pa.int32()),
        "n": pa.array([r[1] for r in rows], pa.int64()),
        "data": pa.array([r[2] for r in rows], pa.binary()),
    })


def _send_anchors(buckets):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        hashes = np.unique(Block(table).anchors()[0])
        cut = _cuts(hashes, ANCHOR_BITS, buckets)
        return _messages("anchors", [(b, int(cut[b + 1] - cut[b]), pack_sorted(hashes[cut[b] : cut[b + 1]])) for b in range(buckets) if cut[b + 1] > cut[b]], block)

    return run


def _answers(table: pa.Table, flags: list[np.ndarray], kind: str) -> pa.Table:
    return pa.table({
        "kind": pa.array([kind] * table.num_rows, pa.string()),
        "bucket": table.column("bucket"),
        "block": table.column("block"),
        "n": table.column("n"),
        "data": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary()),
    })


def _answer_anchors(table: pa.Table) -> pa.Table:
    parts = [unpack_sorted(d.as_py()) for d in table.column("data")]
    values, times = np.unique(np.concatenate(parts), return_counts=True)
    shared = values[times > 1]
    return _answers(table, [np.isin(p, shared, assume_unique=True) for p in parts], "shared")


def _gathered(table: pa.Table, kind: str) -> np.ndarray:
    """The bits of all buckets in the buckets' order."""
    rows = sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    bits = [np.unpackbits(np.frombuffer(r["data"], dtype=np.uint8), count=r["n"]) for r in rows]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, dtype=bool)


def _distinct_keys(high: np.ndarray, low: np.ndarray):
    """Order, number of each key's group in ascending order, and the first place of each group in that order."""
    order = np.lexsort((low, high))
    h, w = high[order], low[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    return order, group, order[new]


def _send_windows(buckets):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _messages("windows", [], 0)
        block_id, block = texts.column("block")[0].as_py(), Block(texts)
        hashes, at, doc = block.anchors()
        values, name = np.unique(hashes, return_inverse=True)
        across = _gathered(answers, "shared")[name] if answers.num_rows else np.zeros(len(at), dtype=bool)
        least, most = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), np.iinfo(np.int64).min)
        np.minimum.at(least, name, block.ids[doc])
        np.maximum.at(most, name, block.ids[doc])
        within = (least < most)[name]
        far, near = block.windows_with(at[across]), block.windows_with(at[within])
        marks = np.zeros((2, len(block.words)), dtype=bool)
        marks[0, far], marks[1, near] = True, True
        high, low = block.window_keys(far)
        _, _, chosen = _distinct_keys(high, low)
        high, low = high[chosen], low[chosen]
        cut = _cuts(high, 64, buckets)
        rows = [(b, int(j - i), pack_sorted(high[i:j]) + low[i:j].astype("<u4").tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]
        carried = [(block_id % buckets, len(block.words), np.packbits(marks).tobytes())]
        return pa.concat_tables([_messages("windows", rows, block_id), _messages("marks", carried, block_id)])

    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    asked = table.filter(pc.equal(table.column("kind"), "windows"))
    rest = table.filter(pc.equal(table.column("kind"), "marks"))
    if not asked.num_rows:
        return rest
    sizes = np.asarray(asked.column("n"))
    data = [d.as_py() for d in asked.column("data")]
    high = np.concatenate([unpack_sorted(d[: 8 * n]) for d, n in zip(data, sizes)])
    low = np.concatenate([np.frombuffer(d, dtype="<u4", offset=8 * n) for d, n in zip(data, sizes)])
    block = np.repeat(np.asarray(asked.column("block")), sizes)
    _, group, first = _distinct_keys(high, low)
    least = block[first]
    np.minimum.at(least, group, block)
    flags = np.split(block > least[group], np.cumsum(sizes)[:-1])
    return pa.concat_tables([_answers(asked, flags, "earlier"), rest]).combine_chunks()


def _join_kept(texts: pa.Array, kept: np.ndarray) -> pa.Array:
    """The kept words of each text with one blank between each two."""
    raw, at = text_bytes(texts)
    starts, ends, first = word_spans(raw, at)
    out = np.array(raw)
    doc = np.searchsorted(first, np.flatnonzero(kept), side="right") - 1
    starts, ends = starts[kept], ends[kept]
    inner = np.zeros(len(starts), dtype=bool)
    inner[:-1] = doc[:-1] == doc[1:]
    out[ends[inner]] = 32  # what parted a word from the next one
    mark = np.zeros(len(raw) + 2, dtype=np.int8)
    np.add.at(mark, starts, 1)
    np.add.at(mark, ends + inner, -1)
    inside = np.cumsum(mark, dtype=np.int8)[: len(raw)] > 0
    total = np.concatenate(([0], np.cumsum(inside)))[at]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(total.astype(np.int64).tobytes()), pa.py_buffer(out[inside].tobytes())])


def _remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
    block = Block(texts)
    n = len(block.words)
    marks = [r for r in answers.to_pylist() if r["kind"] == "marks"] if answers.num_rows else []
    flagged = np.empty(0, dtype=np.int64)
    if marks and n:
        bits = np.unpackbits(np.frombuffer(marks[0]["data"], dtype=np.uint8), count=2 * n).reshape(2, n).astype(bool)
        far, near = np.flatnonzero(bits[0]), np.flatnonzero(bits[1])
        _, group, _ = _distinct_keys(*block.window_keys(far))
        earlier = far[_gathered(answers, "earlier")[group]] if len(far) else far
        _, group, first = _distinct_keys(*block.window_keys(near))
        ids = block.ids[block.document(near)]
        least = ids[first]
        np.minimum.at(least, group, ids)
        flagged = np.concatenate((earlier, near[ids > least[group]]))
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, flagged, 1)
    np.add.at(cover, flagged + WINDOW, -1)
    removed = np.cumsum(cover)[:n] > 0
    total = np.concatenate(([0], np.cumsum(removed)))[block.first]
    return pa.table({
        "doc_id": block.row_ids,
        "n_words": np.diff(block.first).astype(np.int64),
        "n_removed": np.diff(total).astype(np.int64),
        "kept": _join_kept(block.texts, ~removed).cast(pa.string()),
    })


def block_bounds(documents: DataFrame, blocks: int) -> np.ndarray:
    """At most ``blocks`` - 1 ids at which a new block begins."""
    shares = [F.lit(i / blocks) for i in range(1, blocks)]
    if not shares:
        return np.empty(0, dtype=np.int64)
    found = documents.agg(F.percentile_approx("doc_id", F.array(*shares), F.lit(max(1000, 20 * blocks)))).first()[0]
    return np.unique(np.array(found or [], dtype=np.int64))


def remove_repeats(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), a row for each row of documents."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = block_bounds(documents, parts)

    @F.arrow_udf("int")
    def block_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, np.asarray(ids), side="right").astype(np.int32))

    key = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    texts = documents.select("doc_id", "text", block_of(key).alias("block")).repartition(parts, "block")
    by_block = texts.groupBy("block")
    anchors = by_block.applyInArrow(_send_anchors(parts), _MESSAGE)
    shared = anchors.groupBy("bucket").applyInArrow(_answer_anchors, _MESSAGE)
    windows = by_block.cogroup(shared.groupBy("block")).applyInArrow(_send_windows(parts), _MESSAGE)
    earlier = windows.groupBy("bucket").applyInArrow(_answer_windows, _MESSAGE)
    return by_block.cogroup(earlier.groupBy("block")).applyInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string")


def oracle() -> str:
    return rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM g JOIN m USING (k) WHERE doc_id > least),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT p.doc_id, count(r.p) AS n_removed, string_agg(word, ' ' ORDER BY p.p) FILTER (r.p IS NULL) AS kept FROM p LEFT JOIN r USING (doc_id, p) GROUP BY p.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""
