"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Each passage becomes
numbers on its form: how often one kind of character follows another, how words
repeat, how long they are. A learnt layer encodes it; gated attention, a tanh and a
sigmoid branch multiplied, gives it a weight within its document; the weighted sum of
the encodings gives the score. Only documents have labels: which passages matter is
learnt from them.

Fitting uses a bounded sample of labelled rows, at most ``SAMPLE_PER_CLASS`` of each
label; a sampled row counts as often as there are labelled rows for each one taken of
its label. Scoring covers every passage of every text. Null and empty texts, and those
without words, have one passage of zeros. Without rows of both labels the score is
the share of label 1, or 0.5 without any label. Repeated ids count once in the fit.
"""

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.hashing import pieces, text_bytes, word_hashes, word_spans

PASSAGE_WORDS = 64
SAMPLE_PER_CLASS = 3000
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 25, 128, 0.01, 1e-4

# kinds of characters: other punctuation is one kind, letters beyond ASCII another
_KINDS = 12
_kind = np.full(256, 10, dtype=np.uint8)
_kind[128:] = 11
_kind[97:123], _kind[65:91], _kind[48:58] = 0, 1, 2
for _i, _chars in enumerate((" \t", "\n\r\v\f", ".", ",;:", "!?", "|", "-'\"()")):
    _kind[[ord(c) for c in _chars]] = 3 + _i
WORD_FEATURES = 6
FEATURES = _KINDS * _KINDS + WORD_FEATURES


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features of every passage, and the number of passages of each text."""
    raw, at = text_bytes(texts)
    starts, ends, first = word_spans(raw, at)
    words, _ = word_hashes(texts)
    sizes = np.diff(first)
    count = np.maximum(1, -(-sizes // PASSAGE_WORDS))
    skip = np.concatenate(([0], np.cumsum(count)))
    n = int(skip[-1])
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - first[:-1][text]
    own = skip[:-1][text] + place // PASSAGE_WORDS
    x = np.zeros((n, FEATURES), dtype=np.float32)
    if len(words):
        # a byte belongs to the passage of the last word that begins at or before it
        begin = np.zeros(len(raw), dtype=np.int64)
        begin[starts] = 1
        word_of = np.cumsum(begin) - 1
        kind = _kind[raw].astype(np.int64)
        inside = np.flatnonzero((word_of[1:] >= 0)) + 1
        pair = own[word_of[inside]] * (_KINDS * _KINDS) + kind[inside - 1] * _KINDS + kind[inside]
        x[:, : _KINDS * _KINDS] = np.bincount(pair, minlength=n * _KINDS * _KINDS).reshape(n, -1)
        x[:, : _KINDS * _KINDS] /= np.maximum(x[:, : _KINDS * _KINDS].sum(axis=1, keepdims=True), 1)
        np.sqrt(x[:, : _KINDS * _KINDS], out=x[:, : _KINDS * _KINDS])
        total = np.bincount(own, minlength=n)
        share = lambda mask: np.bincount(own, weights=mask, minlength=n) / np.maximum(total, 1)
        after = np.zeros(len(words), dtype=bool)
        after[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
        after2 = np.zeros(len(words), dtype=bool)
        after2[2:] = (words[2:] == words[:-2]) & (text[2:] == text[:-2])
        order = np.lexsort((words, own))
        new = np.ones(len(words), dtype=bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (own[order][1:] != own[order][:-1])
        order_text = np.lexsort((place, words, text))
        seen = np.zeros(len(words), dtype=bool)
        seen[order_text[1:]] = (words[order_text][1:] == words[order_text][:-1]) & (text[order_text][1:] == text[order_text][:-1])
        length = (ends - starts).astype(np.float64)
        columns = (share(after), share(after2), np.bincount(own[order], weights=new, minlength=n) / np.maximum(total, 1), share(seen), np.log1p(share(length)), total / PASSAGE_WORDS)
        for k, column in enumerate(columns):
            x[:, _KINDS * _KINDS + k] = column
    return x, count


def _softmax_by_bag(z: np.ndarray, cut: np.ndarray, count: np.ndarray) -> np.ndarray:
    top = np.repeat(np.maximum.reduceat(z, cut), count)
    e = np.exp(z - top)
    return e / np.repeat(np.add.reduceat(e, cut), count)


@dataclass
class Model:
    """Centre and scale of the features, and the weights of encoder, attention and classifier."""

    bias: float = 0.0
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    p: dict = field(default_factory=dict)

    def forward(self, x: np.ndarray, count: np.ndarray):
        p, cut = self.p, np.concatenate(([0], np.cumsum(count)[:-1]))
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = _softmax_by_bag((t * s) @ p["w"], cut, count)
        z = np.add.reduceat(a[:, None] * h, cut)
        return z @ p["c"] + p["d"], (cut, h, t, s, a, z)

    def attention(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Each passage's weight within its document."""
        return self.forward((x - self.centre) * self.scale, count)[1][4]

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        if not self.p:
            return np.full(len(texts), self.bias)
        out = [np.empty(0)]
        for piece in pieces(texts, 1 << 21):
            x, count = passages(piece)
            out.append(self.forward((x - self.centre) * self.scale, count)[0])
        return np.concatenate(out)

    def score(self, text: Column) -> Column:
        """The probability of label 1 for each text."""

        @F.arrow_udf("double")
        def scores(texts: pa.Array) -> pa.Array:
            return pa.array(1 / (1 + np.exp(-np.clip(self.log_odds(texts).astype(np.float64), -60, 60))))

        return scores(text)


def gradients(model: Model, x: np.ndarray, count: np.ndarray, y: np.ndarray, times: np.ndarray | float = 1.0) -> dict:
    """Of the mean log loss, by every parameter; a bag's loss counts ``times`` times."""
    p = model.p
    score, (cut, h, t, s, a, z) = model.forward(x, count)
    gap = (1 / (1 + np.exp(-np.clip(score, -60, 60))) - y) * times / len(y)
    g = {"c": z.T @ gap, "d": gap.sum()}
    dz = np.repeat(gap[:, None] * p["c"][None], count, axis=0)
    da = (dz * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, cut), count))
    g["w"] = (t * s).T @ de
    dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
    g["W"], g["b"] = x.T @ dh, dh.sum(axis=0)
    return g


def train(x: np.ndarray, count: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 0, times: np.ndarray | None = None) -> Model:
    """The model of labelled bags, by Adam on batches of bags; a bag's loss counts in proportion to ``times``."""
    times = np.ones(len(y)) if times is None else times / times.mean()
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0)
    model = Model(0.0, x.mean(axis=0), (1 / np.where(scale > 1e-6, scale, np.inf)).astype(np.float32))
    x = (x - model.centre) * model.scale
    draw = lambda *size: (rng.normal(size=size) / np.sqrt(size[0])).astype(np.float32)
    model.p = {
        "W": draw(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
        "w": draw(GATE), "c": draw(HIDDEN), "d": np.float32(0),
    }
    m, v, step = {k: 0 * p for k, p in model.p.items()}, {k: 0 * p for k, p in model.p.items()}, 0
    start = np.concatenate(([0], np.cumsum(count)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            bags = order[at : at + BATCH]
            rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in bags])
            g = gradients(model, x[rows], count[bags], y[bags], times[bags])
            step += 1
            for k, p in model.p.items():
                d = g[k] + DECAY * p
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                model.p[k] = (p - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _bags(batches):
    for batch in batches:
        at = 0
        for part in pieces(batch.column("text"), 1 << 21):
            x, count = passages(part)
            cut = np.concatenate(([0], np.cumsum(count)))
            bags = [x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            columns = [*(batch.column(c).slice(at, len(part)) for c in ("label", "stands_for")), pa.array(bags, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "stands_for", "bag"])
            at += len(part)


def fit(spark: SparkSession, sample: DataFrame) -> Model:
    """The model of a bounded (text, label) table; with a column stands_for a row counts that many times."""
    if "stands_for" not in sample.columns:
        sample = sample.withColumn("stands_for", F.lit(1.0))
    rows = sample.mapInArrow(_bags, "label int, stands_for double, bag binary").toPandas()
    y, times = rows["label"].to_numpy(float), rows["stands_for"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        share = (y @ times + 0.5) / (times.sum() + 1)
        return Model(float(np.log(share / (1 - share))))
    # one order whatever task gave a row first
    order = sorted(range(len(rows)), key=lambda i: (y[i], zlib.crc32(rows["bag"][i])))
    bags = [np.frombuffer(rows["bag"][i], dtype=np.float32).reshape(-1, FEATURES) for i in order]
    return train(np.concatenate(bags), np.array([len(b) for b in bags]), y[order], times=times[order])

