"""Token files: one wavelet matrix for each shard of documents in order of their ids.

A wavelet matrix keeps a sequence of ids as bit planes, from the highest bit down.
Each plane holds that bit of every id, in an order in which the plane above has put
all its zeros before all its ones. Ranks counted at fixed steps make access to a
token, counting an id in a prefix and finding its occurrences take one step a plane.

A shard is one row of a compressed Parquet file, written and committed by Spark:
number of documents and tokens, document ids and ends, planes, ranks, and each
plane's number of zeros. A shard has at most ``SHARD_TOKENS`` ids or one document.

Texts get the ids of the tokenizers library, each different piece of a slice once,
and an end id follows each document. Null and empty texts have the
end id alone. Rows without an id come first; rows that share an id follow each other
by text. An empty table gives files without shards. Only doc_id and text are read.
"""

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm.bpe import byte_symbols
from panelspark.llm.byte_pieces import Merges, newer_characters, piece_starts  # noqa: F401
from panelspark.llm.hashing import distinct_spans, pieces, text_bytes
from panelspark.llm.substrings import block_bounds
from panelspark.session import scratch_dir

END_ID = 0
SHARD_TOKENS = 1 << 22
STEP = 512  # bits between two stored ranks
TEXT_BYTES = 1 << 21  # encoded together, so that the arrays of a block of long texts stay small

FILE_SCHEMA = (
    "block int, part int, n_docs long, n_tokens long, doc_ids binary, known binary, ends binary, "
    "planes array<binary>, ranks array<binary>, zeros array<long>"
)


class WaveletMatrix:
    """Succinct access to a sequence of non-negative whole numbers."""

    def __init__(self, n: int, planes: list[bytes], ranks: list[bytes], zeros: list[int]):
        self.n, self.zeros = n, list(zeros)
        self.planes = [np.frombuffer(p, dtype=np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, dtype="<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        planes, ranks, zeros = [], [], []
        now = np.asarray(ids)
        for b in range(bits - 1, -1, -1):
            one = (now >> now.dtype.type(b) & now.dtype.type(1)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), STEP // 8), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate(([0], np.cumsum(counts))).astype("<u4").tobytes())
            zeros.append(int(len(now) - one.sum()))
            now = np.concatenate((now[~one], now[one]))
        return cls(len(ids), planes, ranks, zeros)

    def to_row(self):
        return [p.tobytes() for p in self.planes], [r.tobytes() for r in self.ranks], self.zeros

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i."""
        step, plane = i // STEP, self.planes[level]
        low, high = step * STEP // 8, i // 8
        ones = int(self.ranks[level][step]) + int(np.bitwise_count(plane[low:high]).sum())
        return ones + int(plane[high] & ((1 << i % 8) - 1)).bit_count() if i % 8 else ones

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def __getitem__(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, start), self._rank1(level, end)
            one = value >> (len(self.zeros) - 1 - level) & 1
            start, end = (zeros + a, zeros + b) if one else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs from start to before end."""
        low, high = self._range(value, start, self.n if end is None else end)
        return high - low

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of this kind."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self._rank1(level, middle + 1)
            if (ones if bit else middle + 1 - ones) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def find(self, value: int, k: int = 0) -> int:
        """The place of the k-th (from 0) occurrence of an id, or -1."""
        start, end = self._range(value, 0, self.n)
        if k >= end - start:
            return -1
        i = start + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def all(self) -> np.ndarray:
        """The whole sequence, rebuilt from the lowest plane up."""
        now = np.zeros(self.n, dtype=np.uint32)
        for b, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            one = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(now)
            above[~one] = now[:zeros]
            above[one] = now[zeros:] | np.uint32(1 << b)
            now = above
        return now


class Encoder:
    """The library's ids of whole texts, from the ids of their pieces.

    Merges stay within the pieces that the vocabulary's pattern finds. So each different piece of the texts is merged
    once, all of them in step, and those that are long by the library.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or steps.get("type") != "ByteLevel" or not steps["use_regex"] or steps["add_prefix_space"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError("not a byte-level BPE file of the kind that this operator encodes")
        self.size = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.type = np.dtype("H" if self.size <= 1 << 16 else "I").type
        self.model, self.symbol = self.tokenizer.model, dict(enumerate(byte_symbols()))
        self.merges = Merges(model)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _long(self, piece: bytes) -> list[int]:
        """What the library's model makes of a piece."""
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.symbol))]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0].tobytes()

    def encode_all(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has.

        Texts with an added token are encoded one by one.
        """
        texts = pa.array(texts, type=pa.large_string()) if isinstance(texts, list) else texts
        texts.validate(full=True)
        apart = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            apart |= np.asarray(pc.match_substring(texts, token).fill_null(False))
        lone = np.flatnonzero(apart)
        alone = [self._whole(texts[i].as_py()) for i in lone.tolist()]
        if len(lone):
            texts = pc.if_else(pa.array(apart), "", texts)
        raw, at = text_bytes(texts)
        starts = piece_starts(raw, at)
        sizes = np.diff(starts, append=len(raw))
        name, chosen = distinct_spans(raw, starts, sizes)
        first, size = starts[chosen], sizes[chosen]
        short = size <= self.merges.longest
        ids, length = self.merges(raw, first[short], size[short])
        long = [self._long(raw[i : i + n].tobytes()) for i, n in zip(first[~short].tolist(), size[~short].tolist())]
        # ids of the short pieces, then of the long ones, then of the texts encoded alone, each of these like one piece
        flat = np.concatenate((ids.astype(self.type), *[np.array(x, dtype=self.type) for x in [*long, *alone]]))
        length = np.concatenate((length, np.array([len(x) for x in [*long, *alone]], dtype=np.int64)))
        name = np.where(short, np.cumsum(short) - 1, len(chosen) - len(long) + np.cumsum(~short) - 1)[name]
        until = np.searchsorted(starts, at)
        if len(lone):
            name = np.insert(name, until[lone], len(chosen) + np.arange(len(lone)))
            until[1:] += np.cumsum(apart)
        begin = np.cumsum(length) - length
        count = length[name]
        upto = np.concatenate(([0], np.cumsum(count)))
        source = np.repeat(begin[name] - upto[:-1], count) + np.arange(int(upto[-1]))
        return flat[source], np.diff(upto[until])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    e = Encoder(path)
    e.tokenizer.no_truncation()
    e.tokenizer.no_padding()
    return e


class _Shards:
    """Rows of the token files, from documents that come in order."""

    def __init__(self, bits: int):
        self.bits, self.part = bits, 0
        self.tokens: list[np.ndarray] = []
        self.docs: list[tuple[int, int | None, int]] = []  # block, id, end in the shard
        self.held = 0

    def add(self, block: int, doc_id: int | None, tokens: np.ndarray):
        """The row of the shard that this document does not fit into any more, if it fills one."""
        done = self.close() if self.docs and self.held + len(tokens) > SHARD_TOKENS else None
        self.tokens.append(tokens)
        self.held += len(tokens)
        self.docs.append((block, doc_id, self.held))
        return done

    def close(self) -> pa.RecordBatch:
        blocks, ids, ends = zip(*self.docs)
        matrix = WaveletMatrix.build(np.concatenate(self.tokens), self.bits)
        planes, ranks, zeros = matrix.to_row()
        row = {
            "block": blocks[0], "part": self.part, "n_docs": len(ids), "n_tokens": matrix.n,
            "doc_ids": np.array([i or 0 for i in ids], dtype="<i8").tobytes(),
            "known": np.array([i is not None for i in ids], dtype=np.uint8).tobytes(),
            "ends": np.array(ends, dtype="<i8").tobytes(), "planes": planes, "ranks": ranks, "zeros": zeros,
        }
        self.part, self.held, self.tokens, self.docs = self.part + 1, 0, [], []
        return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def _shard_rows(path: str, end_id: int):
    def run(batches):
        e = encoder(path)
        shards = _Shards(int(e.size - 1).bit_length())
        for batch in batches:
            blocks, ids = batch.column("block").to_pylist(), batch.column("doc_id").to_pylist()
            at = 0
            for some in pieces(batch.column("text"), TEXT_BYTES):
                flat, count = e.encode_all(some)
                # an end id after each document
                total = np.cumsum(count + 1)
                tokens = np.full(int(total[-1]), end_id, dtype=e.type)
                inside = np.ones(len(tokens), dtype=bool)
                inside[total - 1] = False
                tokens[inside] = flat
                for document in np.split(tokens, total[:-1]):
                    full = shards.add(blocks[at], ids[at], document)
                    at += 1
                    if full is not None:
                        yield full
        if shards.docs:
            yield shards.close()

    return run


_ARROW = pa.schema([
    ("block", pa.int32()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("known", pa.binary()),
    ("ends", pa.binary()), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())), ("zeros", pa.list_(pa.int64())),
])


def write_tokens(spark: SparkSession, documents: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Write the token files of all documents to a new folder.

    A block of ids is one partition, sorted by Spark, which may spill; its task holds a batch and a shard at a time.
    """
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = block_bounds(documents, blocks)

    @F.arrow_udf("int")
    def block_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, np.asarray(ids), side="right").astype(np.int32))

    known = F.col("doc_id").isNotNull()
    rows = documents.select("doc_id", "text", known.alias("known"), F.when(known, block_of(F.coalesce("doc_id", F.lit(0)))).otherwise(F.lit(0)).alias("block"))
    ordered = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "known", "doc_id", "text")
    ordered.mapInArrow(_shard_rows(vocabulary, end_id), FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def _documents_of(batches):
    for batch in batches:
        for row in batch.to_pylist():
            tokens = WaveletMatrix(row["n_tokens"], row["planes"], row["ranks"], row["zeros"]).all().astype("<u4")
            ends = np.frombuffer(row["ends"], dtype="<i8")
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            known = np.frombuffer(row["known"], dtype=np.uint8).astype(bool)
            raw = memoryview(tokens).cast("B") if len(tokens) else memoryview(b"")
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(np.frombuffer(row["doc_ids"], dtype="<i8"), pa.int64(), mask=~known),
                "start": starts + row["shard_start"],
                "n_tokens": ends - starts,
                "ids": pa.array([bytes(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.binary()),
            })


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids are little-endian 32-bit numbers."""
    shards = spark.read.schema(FILE_SCHEMA).parquet(path)
    order = Window.orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    # 16 bytes for each shard of some million tokens: the shards themselves stay where they are read
    starts = shards.select("block", "part", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("shard_start"))
    return shards.join(F.broadcast(starts), ["block", "part"]).mapInArrow(_documents_of, "doc_id long, start long, n_tokens long, ids binary")


def write_and_read(spark: SparkSession, documents: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    write_tokens(spark, documents, path, vocabulary, end_id)
    return read_tokens(spark, path)
