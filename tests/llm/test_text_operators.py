"""PII, BPE, token files, hashing, classifiers: hand-written and brute-force cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm import bpe, hashing, pii, quality, toxicity, wavelet
from panelspark.llm.byte_pieces import Merges
from panelspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, label int, block int, score double"
LONG = "word " * 40_000 + "a" * 120_000 + " +" * 30_000


def documents(spark, texts, ids=None):
    """A documents table with columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "x", 7, 3, 0.5) for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


# ---------------------------------------------------------------- hashing

def test_words_split_at_ascii_blanks_only():
    texts = pa.array(["a b\t\nc", None, "", "  ", "x y\x1cz", "A\x0bb\x0cc\rd"])
    hashes, first = hashing.word_hashes(texts)
    assert np.diff(first).tolist() == [3, 0, 0, 0, 1, 4]
    assert len(set(hashes[:3].tolist())) == 3
    low, _ = hashing.word_hashes(pa.array(["ÀB"]), lower=True)
    same, _ = hashing.word_hashes(pa.array(["Àb"]))
    assert low == same


def test_hash_of_a_word_does_not_depend_on_its_place():
    one, _ = hashing.word_hashes(pa.array(["a" * 300_000 + " tail"]))
    two, _ = hashing.word_hashes(pa.array(["tail", "a" * 300_000]).slice(0, 2))
    assert one[0] == two[1] and one[1] == two[0]


@pytest.mark.parametrize("words", [0, 1, 4, 5, 6, 40])
def test_shingle_sets(words):
    text = " ".join(str(i % 7) for i in range(words))
    hashes, cut = hashing.shingle_sets(pa.array([text, text]), 5)
    w = text.split()
    want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    assert cut.tolist() == [0, len(want), 2 * len(want)]
    assert hashes[: len(want)].tolist() == hashes[len(want) :].tolist()


# ---------------------------------------------------------------- PII

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1])))
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and total % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans_equal_plain_patterns(table):
    rng = random.Random(5)
    made = ["".join(rng.choice("a.@-+1234567890 ()%_é4") for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    for text in [*table["text"], *made]:
        assert [s[:3] for s in pii.spans_of(text) if s[0] in PATTERNS] == brute_spans(text)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert [s[0] for s in pii.spans_of("iban DE89 3704 0044 0532 0130 00.") if s[0] == "iban"]
    assert not [s for s in pii.spans_of("iban DE88 3704 0044 0532 0130 00.") if s[0] == "iban"]
    assert [s[0] for s in pii.spans_of("her social security number 123-45-6789")] == ["ssn"]
    assert pii.spans_of("part 123-45-6789") == []
    near, far = pii.spans_of("server 10.0.0.1")[0], pii.spans_of("version 10.0.0.1")[0]
    assert near[3] > far[3]


def test_redaction_joins_overlapping_spans():
    assert pii.redacted("to a.b@c.org, ok") == "to [EMAIL], ok"
    assert pii.redacted("+49 170 1234567 x") == "[PHONE] x"
    assert pii.redacted(None) is None and pii.redacted("") == ""


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1(" * 130_000])
def test_long_texts_take_one_pass(text):
    pii.spans_of(text)


def test_pii_columns(spark):
    df = documents(spark, [None, "", LONG, "x@y.zz", "x@y.zz"], [1, 2, 3, 4, 4])
    rows = df.select("doc_id", pii.find(F.col("text")).alias("s")).collect()
    assert [len(r["s"]) for r in rows] == [0, 0, 0, 1, 1]
    assert documents(spark, []).select(pii.redact(F.col("text"))).count() == 0


def test_pii_query(spark, table):
    got = QUERIES["op1_pii"](spark, SF).toPandas().set_index("doc_id")
    for doc_id, text in zip(table["doc_id"], table["text"]):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(text or ""))
        row = got.loc[doc_id]
        assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(row["spans"].split(","))


# ---------------------------------------------------------------- BPE

@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(WORD)


def test_bpe_equals_the_library_on_documents(table, word_tokenizer):
    v = bpe.vocabulary(WORD)
    for text in table["text"]:
        ids = np.frombuffer(v.encode(text), dtype="<u4")
        want = word_tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert v.decode(ids) == word_tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_equals_the_library_on_odd_texts(word_tokenizer):
    rng = random.Random(1)
    letters = "aaabbthe in an re  \t\n \x1c\x85ΣσςİßÅéÇ1²½'s're!?<|>_日本語한\U0001F600‍́\xa0Ⅷǅ"
    v = bpe.vocabulary(WORD)
    for i in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        if i % 10 == 0:
            text += "<|endoftext|>" + text[:3] + "<|startoftext|>"
        want = word_tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(v.encode(text), dtype="<u4").tolist() == want, repr(text)


def test_long_words_and_pairs(word_tokenizer):
    v = bpe.vocabulary(WORD)
    for word in ("a" * 2000, "ha" * 1500, "!" * 3000, "aab" * 700):
        assert np.frombuffer(v.encode(word), dtype="<u4").tolist() == word_tokenizer.encode(word, add_special_tokens=False).ids
    assert len(v.encode("a" * 300_000)) > 0


def some_characters():
    """Every 31st, all of the first pages, and every fifth that the pattern library knows and Python does not."""
    newer = sorted(map(ord, wavelet.newer_characters()[0]))
    return [chr(c) for c in sorted({*range(0, 0x110000, 31), *range(0x600), *newer[::5]}) if not 0xD800 <= c < 0xE000]


def test_bpe_equals_the_library_on_characters_of_every_age(word_tokenizer):
    texts = [f"a{c}b {c}1 é{c}\u0323." for c in some_characters()]
    ids, count = bpe.vocabulary(WORD).encode_all(pa.array(texts))
    for text, got in zip(texts, np.split(ids, np.cumsum(count)[:-1])):
        assert got.tolist() == word_tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_bpe_of_many_texts_at_once(table, word_tokenizer, monkeypatch):
    texts = ["<|endoftext|>", None, "", " ", "x <|startoftext|>y", "a" * 500, *table["text"][:200], "it's", "  it's\n"]
    want = [word_tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    v = bpe.Vocabulary(WORD)
    for slots, short in ((20, 64), (4, 3)):  # a small memory of pairs forgets, short pieces become long ones
        monkeypatch.setattr(bpe, "SLOTS", slots)
        monkeypatch.setattr(bpe, "SHORT", short)
        v.asked = np.full(1 << slots, -1, dtype=np.int64)
        ids, count = v.encode_all(pa.array(texts, type=pa.string()))
        assert [g.tolist() for g in np.split(ids, np.cumsum(count)[:-1])] == want
    assert v.encode_all(pa.array([], type=pa.string()))[0].tolist() == []


def test_distinct_spans_trust_bytes_only(monkeypatch):
    raw = np.frombuffer(b"abcabcabdxyzabc123456789012345678901", dtype=np.uint8)
    starts, sizes = np.array([0, 3, 6, 9, 12, 15, 25, 35]), np.array([3, 3, 3, 3, 3, 10, 10, 1])
    spans = [raw[i : i + n].tobytes() for i, n in zip(starts, sizes)]
    for keys in (hashing.span_keys, lambda p, e, s, z, seed=0: np.zeros(len(s), dtype=np.uint64)):
        monkeypatch.setattr(hashing, "span_keys", keys)
        name, chosen = hashing.distinct_spans(raw, starts, sizes)
        assert [spans[chosen[n]] for n in name] == spans


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(BYTE)
    with pytest.raises(ValueError):
        wavelet.Encoder(WORD)


def test_bpe_columns(spark):
    df = documents(spark, [None, "", " \n ", LONG, "Hello", "Hello"])
    both = df.select(bpe.encode(F.col("text"), WORD).alias("ids"), bpe.encode_packed(F.col("text"), WORD).alias("packed"))
    rows = both.select("*", bpe.decode_packed(F.col("packed"), WORD).alias("text")).collect()
    assert [len(r["ids"]) for r in rows[:3]] == [0, 0, 0] and [r["text"] for r in rows[:3]] == ["", "", ""]
    assert all(np.frombuffer(r["packed"], "<u4").tolist() == r["ids"] for r in rows)
    assert rows[4]["text"] == rows[5]["text"] == "hello</w>"
    assert documents(spark, []).select(bpe.encode(F.col("text"), WORD)).count() == 0


def test_bpe_query(spark, table, word_tokenizer):
    got = QUERIES["op3_bpe"](spark, SF).toPandas().set_index("doc_id")
    for doc_id, text in zip(table["doc_id"][:60], table["text"]):
        ids = word_tokenizer.encode(text, add_special_tokens=False).ids
        assert got.loc[doc_id, "ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = word_tokenizer.decode(ids, skip_special_tokens=False)
        assert got.loc[doc_id, "decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


# ---------------------------------------------------------------- token files

@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 4000])
def test_wavelet_matrix(n):
    x = np.random.default_rng(n).integers(0, 40, n).astype(np.uint16)
    m = wavelet.WaveletMatrix.build(x, 6)
    assert m.all().tolist() == x.tolist()
    assert [m[i] for i in range(0, n, 13)] == x[::13].tolist()
    for value in (0, 17, 39):
        at = np.flatnonzero(x == value)
        assert m.count(value) == len(at) and m.count(value, n // 3, n // 2) == (x[n // 3 : n // 2] == value).sum()
        assert [m.find(value, k) for k in range(0, len(at), 5)] == at[::5].tolist()
        assert m.find(value, len(at)) == -1


def test_encoder_equals_the_library():
    rng, e, t = random.Random(2), wavelet.encoder(BYTE), Tokenizer.from_file(BYTE)
    parts = ["a", "the", " ", " ", "  ", "\n", "\t", "'s", "'", ".", "!!", "1", "é", "\x1c", "\xa0", "　", "<|endoftext|>", "日"]
    texts = [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    ids, count = e.encode_all(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(count)[:-1])):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert got.tolist() == want == np.frombuffer(e.encode(text), dtype=e.type).tolist(), repr(text)


def test_encoder_equals_the_library_on_characters_of_every_age():
    e, t = wavelet.encoder(BYTE), Tokenizer.from_file(BYTE)
    texts = [f"a{c}b {c}1 {c}." for c in some_characters()]
    ids, count = e.encode_all(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(count)[:-1])):
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids, ascii(text)


def test_short_pieces_are_merged_together(table):
    """Different pieces of a batch take no call of the library each; those too long for that, and files of other merges, do."""
    e, t = wavelet.Encoder(BYTE), Tokenizer.from_file(BYTE)
    rng = random.Random(5)
    letters = "abcdefgh'’ -.,019éß日\n\t "
    texts = [*table["text"][:100], *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)), "x'll're's'd 'll \n 's!'t''t"]
    want = [t.encode(text, add_special_tokens=False).ids for text in texts]
    model, e.model = e.model, None
    ids, count = e.encode_all(texts)
    assert [g.tolist() for g in np.split(ids, np.cumsum(count)[:-1])] == want
    e.model = model
    around = [sign * n for sign in ("a", "=", "ha", " ", "日") for n in (31, 32, 33, 63, 64, 65, 2000)]
    ids, count = e.encode_all(around)
    assert [g.tolist() for g in np.split(ids, np.cumsum(count)[:-1])] == [t.encode(text, add_special_tokens=False).ids for text in around]
    e.merges.longest = 0
    ids, count = e.encode_all(texts[:120])
    assert [g.tolist() for g in np.split(ids, np.cumsum(count)[:-1])] == want[:120]
    with pytest.raises(pa.ArrowInvalid):
        e.encode_all(pa.array([b"a\xe9"]).view(pa.string()))


def test_merges_of_one_token_are_left_to_the_library():
    vocab = {s: i for i, s in enumerate(bpe.byte_symbols())} | {"ab": 256, "bc": 257, "abc": 258}
    merges = [["a", "b"], ["b", "c"], ["ab", "c"]]
    assert Merges({"vocab": vocab, "merges": merges}).longest
    assert Merges({"vocab": vocab, "merges": [" ".join(m) for m in merges]}).longest
    assert not Merges({"vocab": vocab, "merges": [*merges, ["a", "bc"]]}).longest
    assert not Merges({"vocab": {s: i for s, i in vocab.items() if s != "z"}, "merges": merges}).longest


def brute_tokens(rows):
    t, at, out = Tokenizer.from_file(BYTE), 0, []
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, monkeypatch):
    texts = [None, "", "b  c", LONG, "same", "same", "last"]
    ids = [5, None, 2, 9, 4, 4, 11]
    df = documents(spark, texts, ids)
    for shard_tokens in (1 << 22, 5):
        monkeypatch.setattr(wavelet, "SHARD_TOKENS", shard_tokens)
        got = wavelet.write_and_read(spark, df, BYTE).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
        want = brute_tokens([(None, ""), (2, "b  c"), (4, "same"), (4, "same"), (5, ""), (9, LONG), (11, "last")])
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert wavelet.write_and_read(spark, documents(spark, []), BYTE).count() == 0


def test_token_query(spark, table):
    got = QUERIES["op5_tokens"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_tokens(zip(table["doc_id"], table["text"]))


# ---------------------------------------------------------------- classifiers

def test_logistic_reaches_the_minimum():
    rng = np.random.default_rng(0)
    x = rng.random((200, 8)) < 0.4
    y = (x[:, 0] | (x[:, 1] & x[:, 2])).astype(float)
    scale = rng.normal(size=8) + 2
    w, b = toxicity.logistic([np.flatnonzero(r) for r in x], y, scale)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    gradient = (x * scale).T @ (p - y) + toxicity.L2 * w / scale
    assert np.abs(gradient).max() < 0.05 and abs((p - y).sum()) < 0.05


def test_attention_gradients():
    rng = np.random.default_rng(1)
    count = np.array([1, 3, 2])
    x, y = rng.normal(size=(6, 5)), np.array([1.0, 0.0, 1.0])
    model = quality.Model()
    model.p = {k: rng.normal(size=s) for k, s in {"W": (5, 4), "b": 4, "V": (4, 3), "U": (4, 3), "w": 3, "c": 4}.items()} | {"d": np.array(0.3)}

    def loss():
        z = model.forward(x, count)[0]
        return (np.logaddexp(0, z) - y * z).mean()

    g = quality.gradients(model, x, count, y)
    for k, p in model.p.items():
        for i in np.ndindex(p.shape):
            old = p[i]
            p[i] = old + 1e-6
            up = loss()
            p[i] = old - 1e-6
            slope = (up - loss()) / 2e-6
            p[i] = old
            assert abs(slope - np.asarray(g[k])[i]) < 1e-6


def test_attention_weights_sum_to_one_in_each_document(table):
    x, count = quality.passages(pa.array(table["text"][:40]))
    y = np.arange(40) % 2
    model = quality.train(x, count, y.astype(float), epochs=1)
    a = model.attention(x, count)
    assert np.allclose(np.add.reduceat(a, np.concatenate(([0], np.cumsum(count)[:-1]))), 1, atol=1e-5)


def test_passages_of_odd_texts():
    x, count = quality.passages(pa.array([None, "", " \n", "one", "w " * 200]))
    assert count.tolist() == [1, 1, 1, 1, 4] and not x[:3].any() and np.isfinite(x).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_fit_without_both_labels(spark, module):
    for rows, want in (([], 0.5), ([("a b c", 1), ("d", 1)], 2.5 / 3)):
        model = module.fit(spark, spark.createDataFrame(rows, "text string, label int"))
        got = documents(spark, ["x", None, LONG]).select(model.score(F.col("text")).alias("s")).collect()
        assert all(abs(r["s"] - want) < 1e-9 for r in got)


def _held_out(spark, name, sf):
    label, parts, held = ("toxic", 4, 2) if name == "op2_toxicity" else ("quality", 5, 0)
    got = QUERIES[name](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    crc = np.array([zlib.crc32(str(i).encode()) % parts == held for i in got["doc_id"]])
    assert (got["held_out"] == crc).all() and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    part = got[crc]
    return part[label].to_numpy(), part["score"].to_numpy()


@pytest.mark.parametrize("name", ["op2_toxicity", "op7_quality"])
def test_held_out_accuracy(spark, name):
    y, score = _held_out(spark, name, "/root/testdata/sf0.01")
    pairs = score[y == 1][:, None] - score[y == 0][None]
    assert (pairs > 0).mean() + (pairs == 0).mean() / 2 > 0.9


def test_labels_and_other_columns_do_not_reach_the_score(spark):
    sample = spark.createDataFrame([("you fool", 1), ("kind words", 0)] * 20, "text string, label int")
    model = toxicity.fit(spark, sample)
    got = documents(spark, ["you fool", "you fool", None, ""]).select(model.score(F.col("text")).alias("s")).toPandas()["s"]
    assert got[0] == got[1] > 0.5 and got[2] == got[3]


def _predicted_shares(spark, module, per_class, rare):
    """The share of predicted ones by kind of text: an eighth has bars, where the rarer label is 40 %, and else 6 %."""
    rng = np.random.default_rng(7)
    barred = rng.random(3000) < 1 / 8
    label = np.where(rng.random(3000) < np.where(barred, 0.4, 0.06), rare, 1 - rare)
    texts = [" ".join(["tabular | "[: 10 if b else 0] + "words of text"] * 3) for b in barred]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(label)], "doc_id long, v int")
    model = module.fit(spark, toxicity.labelled_sample(docs, labels, "v", F.lit(True), per_class))
    score = docs.select("doc_id", model.score(F.col("text")).alias("s")).toPandas().sort_values("doc_id")["s"].to_numpy()
    return [(score[barred == b] >= 0.3).mean() for b in (True, False)]


@pytest.mark.parametrize("module, rare", [(toxicity, 1), (quality, 0)])
def test_a_small_sample_predicts_the_shares_of_the_full_fit(spark, module, rare):
    full = _predicted_shares(spark, module, 5000, rare)
    assert full == [1, 1 - rare]
    assert _predicted_shares(spark, module, 150, rare) == full


@pytest.mark.parametrize("module", [toxicity, quality])
def test_one_label_has_its_share_of_all_rows_however_few_are_sampled(spark, module):
    docs = documents(spark, ["a b c"] * 60)
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, v int")
    model = module.fit(spark, toxicity.labelled_sample(docs, labels, "v", F.lit(True), 3))
    assert abs(docs.select(model.score(F.col("text")).alias("s")).first()["s"] - 60.5 / 61) < 1e-9
