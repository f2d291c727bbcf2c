"""Ranked search, vector codes and decontamination: brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import codebooks, decontaminate, lexical
from panelspark.llm.queries import ORACLES, QUERIES
from panelspark.llm.terms import Terms

DOCS = "doc_id long, text string, hit long, items string, n long, terms string, row string"
ITEMS = "item_id long, text string, doc_id long, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    return TERM.findall((text or "").translate(str.maketrans(UP, LOW)))


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", "z") for i, t in zip(ids, texts)], DOCS)


def items(spark, pairs):
    return spark.createDataFrame([(i, t, 5, 6) for i, t in pairs], ITEMS)


# ---------------------------------------------------------------- terms

ODD_TEXTS = [None, "", "  ", "Straße 12-B", "ab", "cd", "É É", "a\x00b", "x" * 5000 + " y" * 3, "中文字符 混合 text", "A" * 16 + " " + "A" * 17]


def test_terms_of_odd_texts():
    terms = Terms(pa.array(ODD_TEXTS))
    got = [[terms.text(i).decode() for i in range(a, b)] for a, b in zip(terms.first, terms.first[1:])]
    assert got == [words(t) for t in ODD_TEXTS]


def test_terms_of_a_slice_and_of_nothing():
    terms = Terms(pa.array(ODD_TEXTS)[3:6])
    assert [terms.text(i).decode() for i in range(len(terms))] == ["straße", "12", "b", "ab", "cd"]
    assert len(Terms(pa.array([], pa.string()))) == 0 and len(Terms(pa.array([None], pa.string()))) == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_keys_tell_apart_what_linear_hashes_do_not():
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    terms = Terms(pa.array([a, b, a, "q" * 1500 + "1", "q" * 1500 + "2"]))
    keys = terms.keys()
    assert len(set(keys.tolist())) == 4 and keys[0] == keys[2]
    assert terms.equal(np.array([0, 0, 3, 3]), terms, np.array([2, 1, 4, 3])).tolist() == [True, False, False, True]


# ---------------------------------------------------------------- decontamination

def brute_hits(rows, tests, width=10):
    out = []
    for doc_id, text in rows:
        ws = words(text)
        hit, found = set(), set()
        for item_id, t in tests:
            ts = words(t)
            n = min(width, len(ts))
            if item_id is None or not n:
                continue
            passages = {tuple(ts[i : i + n]) for i in range(len(ts) - n + 1)}
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in passages:
                    hit.update(range(i, i + n))
                    found.add(str(item_id))
        out.append((doc_id, len(ws), len(hit), sorted(found)))
    return sorted(out, key=repr)


def hits_of(df):
    rows = df.collect()
    for r in rows:
        runs = [(x["first"], x["last"]) for x in r["runs"]]
        assert sum(b - a + 1 for a, b in runs) == r["n_hit"]
        assert all(a[1] + 1 < b[0] for a, b in zip(runs, runs[1:]))
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows], key=repr)


def contaminated_corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "Ünd", "x1", "longer-word", "w" * 40, "w" * 39 + "v", "中文"]
    tests = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 9, 10, 11, 25, 60])))) for i in range(14)]
    tests += [(3, "the of a the"), (20, None), (21, " ;. "), (None, "x1"), (2, tests[2][1]), (40, tests[8][1])]
    texts = [None, "", "..."]
    for _ in range(40):
        text = rng.choices(vocabulary + ["zz", "yy", "xx"] * 4, k=rng.choice([1, 8, 10, 63, 64, 65, 200]))
        for _ in range(rng.choice([0, 1, 2])):
            t = words(rng.choice(tests)[1])
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() if w.isascii() else w for w in t[rng.randrange(max(len(t) - 9, 1)) :]]
        texts.append(rng.choice([" ", ", ", "\n"]).join(text))
    texts += [texts[5], texts[5], " ".join(["the of"] * 4000)]
    return tests, texts


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 200])
def test_hits_equal_brute_force(spark, chunk_bytes):
    tests, texts = contaminated_corpus()
    ids = [*range(len(texts) - 2), 4, None]
    got = hits_of(decontaminate.contaminated(spark, documents(spark, texts, ids), items(spark, tests), chunk_bytes=chunk_bytes))
    assert got == brute_hits(list(zip(ids, texts)), tests)
    assert sum(r[2] > 0 for r in got) > 5


def test_hits_without_items_or_documents(spark):
    docs = documents(spark, ["one two three", None])
    assert hits_of(decontaminate.contaminated(spark, docs, items(spark, []))) == [(0, 3, 0, []), (1, 0, 0, [])]
    assert decontaminate.contaminated(spark, docs.limit(0), items(spark, [(1, "one")])).count() == 0


def test_scan_skips_most_of_a_clean_text():
    tables = decontaminate.tables([" ".join(f"t{i}" for i in range(30))])
    assert [p.length for p in tables] == [10]
    text = Terms(pa.array([" ".join(f"d{i}" for i in range(9000))]))
    asked = []
    real = tables[0].blocks_at
    tables[0].blocks_at = lambda t, ends: asked.append(len(ends)) or real(t, ends)
    assert len(tables[0].occurrences(text)[0]) == 0
    assert sum(asked) < 9000 / 7  # nine words at a time, and a start for each lane


def test_buckets_confirm_on_bytes():
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"t{i}" for i in range(9))
    tables = decontaminate.tables([f"{a} {tail}"])
    found = decontaminate.hits(pa.array([f"{b} {tail}", f"{a} {tail}"]), tables, np.array([0]))
    assert found[2].tolist() == [[1, 0]]


# ---------------------------------------------------------------- ranked search

def brute_ranks(rows, tests, k):
    docs = [(i, Counter(words(t))) for i, t in rows if i is not None and words(t)]
    big_n, big_l = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    terms = {}
    for item_id, t in tests:
        if item_id is not None and t is not None:
            terms.setdefault(item_id, set()).update(words(t))
    for item_id, ts in terms.items():
        scored = []
        for doc_id, c in docs:
            m = 100 - 50 + (50 * sum(c.values()) * big_n) // big_l
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m))
                for w in ts if c[w]
            )
            if score > 0:
                scored.append((-score, doc_id))
        out += [(item_id, rank + 1, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def ranks_of(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def ranked_corpus(n=900, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Über", "中文", "x" * 30]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30, 120]))) for _ in range(n)]
    texts += [None, "", "--", texts[3], texts[3].upper(), "w7 " * 3000, *[texts[9]] * 60]
    ids = [*range(len(texts) - 2), 3, None]
    tests = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 4, 25])))) for i in range(12)]
    tests += [(3, "w7 w300"), (90, None), (91, ""), (92, "nowhere at all"), (None, "w1"), (5, tests[5][1]), (93, texts[9])]
    return texts, ids, tests


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 150])
def test_ranks_equal_brute_force(spark, chunk_bytes):
    texts, ids, tests = ranked_corpus()
    got = ranks_of(lexical.ranked(spark, documents(spark, texts, ids), items(spark, tests), 20, chunk_bytes))
    assert got == brute_ranks(list(zip(ids, texts)), tests, 20)


def test_ranks_over_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCUMENTS", 256)
    monkeypatch.setattr(lexical, "BLOCK", 8)
    texts, ids, tests = ranked_corpus()
    rows = [(i, t) for i, t in zip(ids, texts) if i is not None and t]
    vocabulary = lexical.Vocabulary([(str(i), t) for i, t in tests if i is not None and t is not None])
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    forward = list(lexical._forward(vocabulary)([batch]))
    count = Counter(t for b in forward for ts in b.column("terms").to_pylist() for t in ts)
    n = sum(b.num_rows for b in forward)
    stats = {
        "N": n, "L": sum(sum(b.column("n").to_pylist()) for b in forward),
        "weights": np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * count[w] + 1))) for w in range(len(vocabulary))]),
    }
    scored = []
    real = lexical.Shard.scores
    monkeypatch.setattr(lexical.Shard, "scores", lambda self, docs: scored.append(len(docs)) or real(self, docs))
    found = lexical._search(vocabulary.items, vocabulary.names, stats, [1] * len(vocabulary.names), 5)(forward)
    best = {}
    for b in found:
        for item, doc, score in zip(*[b.column(c).to_pylist() for c in ("item_id", "doc_id", "score")]):
            best.setdefault(int(item), []).append((-score, doc))
    got = sorted((i, r + 1, d, -s) for i, v in best.items() for r, (s, d) in enumerate(sorted(v)[:5]))
    assert got == brute_ranks(rows, tests, 5)
    # blocks are skipped: far fewer documents are scored than have a term of the item
    having = sum(len(set(i) & set(ts)) > 0 for i in map(list, vocabulary.items) for b in forward for ts in b.column("terms").to_pylist())
    assert sum(scored) < having / 2


def test_ranks_of_nothing(spark):
    docs = documents(spark, ["one two", None])
    assert lexical.ranked(spark, docs, items(spark, [])).count() == 0
    assert lexical.ranked(spark, docs.limit(0), items(spark, [(1, "one")])).count() == 0
    assert lexical.ranked(spark, documents(spark, [None, ""]), items(spark, [(1, "one")])).count() == 0


def test_summaries_bound_every_document():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 12, 500)
    terms = np.concatenate([rng.choice(60, s, replace=False) for s in sizes])
    weights = rng.integers(1, 9000, 60)
    stats = {"N": 500, "L": int(sizes.sum() * 3), "weights": weights, "beside": lambda t: np.ones(60, dtype=bool)}
    shard = lexical.Shard(np.arange(500), sizes * 3, sizes, terms, rng.integers(1, 5, len(terms)), stats)
    asked = rng.choice(60, 9, replace=False)
    shard.asked[asked] = weights[asked]
    for term in range(60):
        blocks = shard.blocks(term)
        assert sorted(blocks.docs) == sorted(shard.docs_of(term)) and np.diff(blocks.cut).max() <= lexical.BLOCK
        bound = blocks.bounds(np.sort(asked), weights[np.sort(asked)])
        for b in range(blocks.n):
            assert shard.scores(blocks.docs[blocks.cut[b] : blocks.cut[b + 1]]).max() <= bound[b]


# ---------------------------------------------------------------- vector codes

VECTORS = "vec_id long, embedding array<float>, label int, dim int, code string, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 9, "c", 3) for i, v, label in rows], VECTORS)


def brute_codes(rows, rounds=4):
    """Plain Python over each length of vector on its own."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    for dim in {len(v) for _, v, _ in kept}:
        mine = [r for r in kept if len(r[1]) == dim]
        ends = [dim * p // 4 for p in range(5)]
        parts = [[r[1][a:b] for r in mine] for a, b in zip(ends, ends[1:])]
        books = [[list(x) for x in p[:256]] for p in parts]

        def nearest(part, book):
            return min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(book))

        for _ in range(rounds):
            for p, book in zip(parts, books):
                groups = {}
                for part in p:
                    groups.setdefault(nearest(part, book)[1], []).append(part)
                for i, members in groups.items():
                    book[i] = [sum(c) // len(members) for c in zip(*members)]
        digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for n, (i, _, label) in enumerate(mine):
            best = [nearest(p[n], book) for p, book in zip(parts, books)]
            out.append((i, "".join(f"{b[1]:02x}" for b in best), sum(b[0] for b in best), label, digest))
    total = Counter()
    for r in out:
        total[r[3]] += r[2]
    return sorted([(i, code, error, total[label], digest) for i, code, error, label, digest in out], key=repr)


def codes_of(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_codes_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [round(rng.gauss(0, 0.1), rng.choice([1, 2, 5])) for _ in range(8)], rng.choice([None, 0, 1, 2])) for i in range(500, 0, -1)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(150)]  # one vector very often
    rows += [(2000, None, 1), (2001, [0.1] * 7 + [None], 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, None)]
    rows += [(17, [0.5] * 8, 1), (17, [0.25] * 8, 1), (None, [0.75] * 8, 2), (17, [0.5] * 8, 1)]
    rows += [(5000 + i, [rng.random() * 8 - 4 for _ in range(5)], 1) for i in range(9)] + [(6000, [], 1), (6001, [], None)]
    assert codes_of(codebooks.codes(spark, vectors(spark, rows))) == brute_codes(rows)


def test_codes_of_few_and_of_no_vectors(spark):
    rows = [(3, [1.0, 2.0, 3.0, 4.0], None), (1, [-1.0, 0.0, 0.5, 0.25], None)]
    got = codes_of(codebooks.codes(spark, vectors(spark, rows)))
    assert got == brute_codes(rows) and {r[1] for r in got} == {"00000000", "01010101"}
    assert codebooks.codes(spark, vectors(spark, rows).limit(0)).count() == 0


def test_components_too_large_raise(spark):
    with pytest.raises(Exception, match="a component of 16384 or more"):
        codebooks.codes(spark, vectors(spark, [(1, [20000.0] * 4, 1)])).collect()


@pytest.mark.parametrize("stride", [1, 2, 7, 512])
@pytest.mark.parametrize("spread", [2, 5, 3000])
def test_trie_distances_equal_plain_ones(stride, spread):
    rng = np.random.default_rng(spread)
    leaves, weights, place = codebooks.distinct(rng.integers(-spread, spread, (300, 5)))
    assert weights.sum() == 300 and all(a < b for a, b in zip(leaves.tolist(), leaves[1:].tolist()))
    entries = rng.integers(-spread, spread, (11, 5))
    plain = ((leaves[:, None, :] - entries[None]) ** 2).sum(axis=2)
    got = np.concatenate([d for _, d in codebooks.leaf_distances(leaves, entries, stride)])
    assert (got == plain).all()
    index, error = codebooks.nearest(leaves, entries)
    assert (index == plain.argmin(axis=1)).all() and (error == plain.min(axis=1)).all()


def test_each_prefix_is_visited_once(monkeypatch):
    """The work is one step for each node of the trie, not one for each part and dimension."""
    rng = np.random.default_rng(4)
    leaves, _, _ = codebooks.distinct(rng.integers(0, 3, (5000, 6)))
    nodes = sum(len(np.unique(leaves[:, : t + 1], axis=0)) for t in range(6))
    grown = []
    real = np.cumsum
    monkeypatch.setattr(codebooks.np, "cumsum", lambda opens: grown.append(int(opens.sum())) or real(opens))
    strides = list(codebooks.leaf_distances(leaves, leaves[:2], 64))
    # a stride that goes on below a node counts it again, without working it out again
    assert nodes <= sum(grown) <= nodes + 6 * len(strides)


def test_registered_with_sql():
    assert {"op11_lexical", "op12_codebooks", "op13_decontaminate"} <= set(QUERIES) & set(ORACLES)


# ---------------------------------------------------------------- texts that linear hashes confuse

def test_sequences_and_windows_of_patterns_differ():
    from panelspark.llm import hashing
    a = thue_morse(4096)
    b = a.translate(str.maketrans("ab", "ba"))
    texts = pa.array([" ".join(a), " ".join(b), " ".join(a), "", "a", "a a", "a a a", "x " + a[:2048], "x " + b[:2048]])
    words, first = hashing.word_keys(texts)
    for seed in (1, 2):
        keys = hashing.sequence_hash(words, first, seed).tolist()
        assert keys[0] == keys[2] and len(set(keys)) == 8
    alone = [hashing.sequence_hash(*hashing.word_keys(texts[i : i + 1]), 1)[0] for i in range(len(texts))]
    assert alone == hashing.sequence_hash(words, first, 1).tolist()


def test_operators_tell_patterns_apart(spark):
    """Two words of 2,048 letters, and two texts of 4,096 words, that sums of powers cannot tell apart."""
    from tokenizers import Tokenizer

    import public_tokenizers
    from panelspark.llm import minhash, substrings, wavelet
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(12))
    docs = documents(spark, [f"{a} {tail}", f"{b} {tail}", " ".join(thue_morse(4096)), " ".join(thue_morse(4096).translate(str.maketrans("ab", "ba")))])
    assert [r["n_removed"] for r in substrings.remove_repeats(spark, docs).orderBy("doc_id").take(2)] == [0, 0]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    flat, count = wavelet.encoder(path).encode_all([f"{a} x", f"{b} x", f"{a} x"])
    want = [library.encode(t, add_special_tokens=False).ids for t in (f"{a} x", f"{b} x", f"{a} x")]
    assert flat.tolist() == sum(want, []) and count.tolist() == [len(w) for w in want]
    first, second = (r["n_shingles"] for r in minhash.classes(spark, docs.where("doc_id >= 2")).orderBy("doc_id").collect())
    assert first == second
    from panelspark.llm.hashing import sequence_hash, word_keys
    keys = word_keys(pa.array([" ".join(thue_morse(4096)), " ".join(thue_morse(4096).translate(str.maketrans("ab", "ba")))]))
    assert len(set(sequence_hash(*keys, 1).tolist())) == 2


def test_members_are_never_missed(spark):
    from panelspark.llm.membership import Members
    ids = spark.range(0, 3000, 3).select(F.col("id").alias("node"))
    rows = spark.range(3000).select("id").union(spark.createDataFrame([(None,)], "id long"))
    members = Members(ids)
    some, others = members.possible(rows, "id"), members.impossible(rows, "id")
    kept = {r["id"] for r in some.collect()}
    assert {i for i in range(0, 3000, 3)} <= kept and len(kept) < 1400
    assert some.count() + others.count() == 3001
    assert not kept & {r["id"] for r in others.where("id IS NOT NULL").collect()}
    empty = Members(ids.limit(0))
    assert empty.possible(rows, "id").count() == 0 and empty.impossible(rows, "id").count() == 3001
