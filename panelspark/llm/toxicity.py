"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased and everything but letters becomes a blank. Its features are
the character n-grams of a few lengths that occur in it, hashed to buckets. Each
bucket's log-count ratio compares its document frequency in the two classes; a
logistic regression on the presence of the buckets, scaled by these ratios, gives
the score.

Fitting uses a bounded sample of the labelled rows, at most ``SAMPLE_PER_CLASS`` of
each label, taken by a hash of the id; a sampled row counts as often as there are
labelled rows for each one taken of its label, so the share of a label is the same
however many rows there are. Scoring covers every text whole. Null, empty
and letterless texts get the score of no features. Without rows of both labels the
score is the share of label 1, or 0.5 if there is no label at all. Repeated ids
count once in the fit, with their largest label; extra columns are not read.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import land

BUCKET_BITS = 18
LENGTHS = (3, 4, 5)
SAMPLE_PER_CLASS = 6000
FEATURES = 8192
SMOOTHING = 1.0
L2 = 1.0
NEWTON_STEPS, CG_STEPS = 12, 15
ROWS_AT_A_TIME = 500
PIECE = 1 << 18  # texts are turned into features this many characters at a time

_CHAR = np.arange(0x3000, dtype=np.uint32)
for _c in range(0x3000):
    if not chr(_c).isalpha():
        _CHAR[_c] = 32


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, each text between blanks, and the number of the text of each place."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(codes < len(_CHAR), _CHAR[np.minimum(codes, len(_CHAR) - 1)], codes)
    text = np.repeat(np.arange(len(lowered), dtype=np.int32), [len(t) for t in lowered])
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (text[1:] != text[:-1])
    return codes[keep], text[keep]


def _grams(codes: np.ndarray, text: np.ndarray):
    """For each length: the bucket of each n-gram that lies in one text, and that text's number."""
    h = np.full(len(codes), 0x9E3779B1, dtype=np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        size = len(codes) - n + 1
        if size <= 0:
            return
        h = h[:size] * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        if n in LENGTHS:
            whole = text[:size] == text[n - 1 :]
            bucket = ((h * np.uint32(0x27D4EB2F + 2 * n)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
            yield bucket, text[:size], whole


def present(texts: list[str], wanted: np.ndarray | None = None):
    """The distinct (text number, bucket) pairs, for a bounded number of characters, or one longer text, at a
    time; only of wanted buckets if a mask is given."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= PIECE):
            size += len(texts[j])
            j += 1
        found = [np.empty(0, dtype=np.int64)]
        for bucket, text, whole in _grams(*_codes(texts[i:j])):
            keep = whole if wanted is None else whole & wanted[bucket]
            found.append(np.unique((text[keep].astype(np.int64) + i) << BUCKET_BITS | bucket[keep]))
        pairs = np.unique(np.concatenate(found))
        yield pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)
        i = j


@dataclass
class Model:
    """The weight of each bucket that counts, and the score of no features in log odds."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.zeros(1 << BUCKET_BITS, dtype=np.float32)
        table[self.buckets] = self.weights
        return table

    def log_odds(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for text, bucket in present(texts, table != 0):
            np.add.at(out, text, table[bucket])
        return out

    def score(self, text: Column) -> Column:
        """The probability of label 1 for each text."""
        model, held = self, []

        @F.arrow_udf("double")
        def scores(texts: pa.Array) -> pa.Array:
            if not held:
                held.append(model.table())
            z = model.log_odds([t or "" for t in texts.to_pylist()], held[0])
            return pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))

        return scores(text)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(text, label, stands_for) of at most ``per_class`` labelled rows of each label that ``train`` holds for.

    ``stands_for`` is the number of such rows over the number taken, so that a bounded sample keeps the labels' shares.
    The sample of ids has at most twice ``per_class`` rows, so it is small enough to send to every task.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id").agg(F.max(label).alias("label_of_id"))
        .where(train)
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    n = {r["label_of_id"]: r["count"] for r in known.groupBy("label_of_id").count().collect()}
    ids = [
        known.where(F.col("label_of_id") == v).orderBy(*order).limit(per_class)
        .withColumn("stands_for", F.lit(max(1.0, n.get(v, 0) / per_class)))
        for v in (0, 1)
    ]
    return (
        documents.select("doc_id", "text")
        .join(F.broadcast(ids[0].union(ids[1])), "doc_id")
        .select("text", F.col("label_of_id").cast("int").alias("label"), "stands_for")
    )


def _counts(batches):
    """How many texts of each label have each bucket: one row a bucket and label that a task met."""
    n = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
    for batch in batches:
        labels = np.asarray(batch.column("label"))
        for text, bucket in present([t or "" for t in batch.column("text").to_pylist()]):
            for v in (0, 1):
                np.add.at(n[v], bucket[labels[text] == v], 1)
    at = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], ["bucket", "n0", "n1"])


def _rows(wanted_buckets):
    def run(batches):
        wanted = np.zeros(1 << BUCKET_BITS, dtype=bool)
        wanted[wanted_buckets] = True
        for batch in batches:
            packed = [b""] * batch.num_rows
            for text, bucket in present([t or "" for t in batch.column("text").to_pylist()], wanted):
                for part in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1):
                    if len(part):
                        packed[text[part[0]]] = bucket[part].astype("<i4").tobytes()
            columns = [batch.column("label"), batch.column("stands_for"), pa.array(packed, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "stands_for", "buckets"])

    return run


def logistic(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, l2: float = L2, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on present features times their scale; a row counts ``times`` times.

    Newton steps; each solves its linear system by conjugate gradients.
    """
    n, k = len(rows), len(scale)
    times = np.ones(n) if times is None else times
    # a share of the rows at a time, columns as small numbers: the driver holds little more than the rows
    parts = []
    for at in range(0, n, ROWS_AT_A_TIME):
        some = rows[at : at + ROWS_AT_A_TIME]
        sizes = np.array([len(r) for r in some])
        parts.append((slice(at, at + len(some)), np.concatenate(some).astype(np.int32), np.repeat(np.arange(len(some)), sizes).astype(np.int32)))

    def forward(w):
        z, scaled = np.empty(n), scale * w[:k]
        for where, column, row in parts:
            z[where] = np.bincount(row, weights=scaled[column], minlength=where.stop - where.start)
        return z + w[k]

    def backward(g):
        total = np.zeros(k)
        for where, column, row in parts:
            total += np.bincount(column, weights=g[where][row], minlength=k)
        return np.append(total * scale, g.sum())

    def loss(w, z):
        return times @ (np.logaddexp(0, z) - labels * z) + penalty @ (w * w) / 2

    penalty = np.append(np.full(k, l2), 1e-6)
    w = np.zeros(k + 1)
    z = forward(w)
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        gradient, curve = backward(times * (p - labels)) + penalty * w, times * p * (1 - p)
        step, left = np.zeros(k + 1), -gradient
        direction, size = left.copy(), left @ left
        first = size
        for _ in range(CG_STEPS):
            if size <= 1e-6 * first:
                break
            bent = backward(curve * forward(direction)) + penalty * direction
            a = size / (direction @ bent)
            step += a * direction
            left -= a * bent
            size, before = left @ left, size
            direction = left + size / before * direction
        now, part = loss(w, z), 1.0
        while loss(w + part * step, z_new := forward(w + part * step)) > now and part > 1e-4:
            part /= 2
        w, z = w + part * step, z_new
        if part <= 1e-4 or np.abs(gradient).max() < 1e-3:
            break
    return w[:k] * scale, float(w[k])


def fit(spark: SparkSession, sample: DataFrame, features: int = FEATURES) -> Model:
    """The classifier of a bounded (text, label) table; with a column stands_for a row counts that many times."""
    if "stands_for" not in sample.columns:
        sample = sample.withColumn("stands_for", F.lit(1.0))
    sample = land(sample, spark, "toxicity-sample")
    totals = {r["label"]: r for r in sample.groupBy("label").agg(F.count("*").alias("n"), F.sum("stands_for").alias("all")).collect()}
    n0, n1 = (totals[v]["n"] if v in totals else 0 for v in (0, 1))
    none = np.empty(0, dtype=np.int64)
    if not n0 or not n1:
        all0, all1 = (totals[v]["all"] if v in totals else 0 for v in (0, 1))
        share = (all1 + 0.5) / (all0 + all1 + 1)
        return Model(none, none.astype(np.float32), float(np.log(share / (1 - share))))
    counts = sample.mapInArrow(_counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p, q = F.col("n1") + SMOOTHING, F.col("n0") + SMOOTHING
    ratio = F.log(p / (n1 + 2 * SMOOTHING)) - F.log(q / (n0 + 2 * SMOOTHING))
    chosen = (
        counts.where(F.col("n0") + F.col("n1") >= 3)
        .select("bucket", ratio.alias("ratio"), F.abs(ratio / F.sqrt(1 / p + 1 / q)).alias("weight"))
        .orderBy(F.desc("weight"), "bucket").limit(features).toPandas().sort_values("bucket")
    )
    buckets, ratios = chosen["bucket"].to_numpy(np.int64), chosen["ratio"].to_numpy(float)
    rows = sample.mapInArrow(_rows(buckets), "label int, stands_for double, buckets binary").toPandas()
    labels = rows["label"].to_numpy(float)
    place = [np.searchsorted(buckets, np.frombuffer(b, dtype="<i4")).astype(np.int32) for b in rows.pop("buckets")]
    weights, bias = logistic(place, labels, ratios, times=rows["stands_for"].to_numpy(float))
    return Model(buckets, weights.astype(np.float32), float(bias))
