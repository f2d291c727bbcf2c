"""Near-duplicates, repeats, vectors, mixing and the pipeline: brute force on small tables."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelspark.llm import components, embedding_dedup, minhash, mixing, substrings, vafile
from panelspark.llm.queries import ORACLES, QUERIES

import corpus_pipeline

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, component long, block int, topic string, row string"


def documents(spark, texts, ids=None):
    """A documents table with columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, "t", "r") for i, t in zip(ids, texts)], DOCS)


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---------------------------------------------------------------- components

def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 3), (7, None)]
    links += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in components.components(spark, spark.createDataFrame(links, "x long, y long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == closure({n for link in real for n in link}, real)


def test_components_of_nothing(spark):
    assert components.components(spark, spark.createDataFrame([], "x long, y long")).count() == 0


# ---------------------------------------------------------------- MinHash

def brute_classes(rows, similar=85):
    sets = defaultdict(list)
    for doc_id, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets[doc_id].append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    ids = [i for i in sets if i is not None]
    links = [
        (a, b) for n, a in enumerate(ids) for b in ids[:n]
        if any(s and t and 100 * len(s & t) >= similar * len(s | t) for s in sets[a] for t in sets[b])
    ]
    return closure(ids, links), sets


def mutated(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.randint(0, 10**6)}" for w in words)


def test_minhash_equals_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for g in range(12):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([3, 5, 30, 200]))]
        texts += [mutated(rng, base, rng.choice([0, 0.01, 0.02, 0.04, 0.1])) for _ in range(rng.choice([1, 4, 9]))]
    texts += [None, "", " \t ", "one", "ONE", "one two", "tail " * 30_000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want, sets = brute_classes(rows)
    got = minhash.classes(spark, documents(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]]
        assert r["n_shingles"] == len(sets[r["doc_id"]][0])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_minhash_clusters_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = [mutated(rng, base, rng.choice([0.005, 0.01, 0.02, 0.05])) for _ in range(60)]
    want, _ = brute_classes(list(enumerate(texts)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.classes(spark, documents(spark, texts)).collect()}
    assert got == want


def test_minhash_ids_that_repeat_or_are_missing(spark):
    df = documents(spark, ["a b c d e f"] * 4 + ["x y z"], [7, 7, None, 9, 7])
    got = sorted(map(tuple, minhash.classes(spark, df).collect()), key=repr)
    assert got == sorted([(7, 2, 7, True), (7, 2, 7, True), (None, 2, None, True), (9, 2, 7, False), (7, 1, 7, True)], key=repr)
    kept = minhash.deduplicated(spark, df)
    assert kept.columns == df.columns and kept.count() == 4
    assert minhash.classes(spark, documents(spark, [])).count() == 0


def test_signature_takes_both_ends_of_each_permutation():
    hashes = minhash.mix(np.arange(50, dtype=np.uint64))
    s = minhash.signatures(hashes, np.array([0, 20, 50]))
    for row, part in zip(s, (hashes[:20], hashes[20:])):
        for k, factor in enumerate(minhash._multipliers()):
            assert row[2 * k] == (part * factor).min() and row[2 * k + 1] == (part * factor).max()


@pytest.mark.parametrize("similar", [85, 80, 60, 40, 10])
def test_pairs_at_the_limit_are_as_rarely_missed_at_every_limit(similar):
    bands, values = minhash.banding(similar)
    assert (1 - (similar / 100) ** values) ** bands <= 2e-7
    # keys of 300 pairs of sets whose similarity is the limit
    n, rng = 300, np.random.default_rng(similar)
    drawn = rng.integers(0, 2**63, size=(n, 200), dtype=np.uint64)
    own = (200 - 2 * similar) // 2
    one, two = drawn[:, : 200 - own], np.concatenate([drawn[:, : 2 * similar], drawn[:, 200 - own :]], axis=1)
    keys = [minhash.band_keys(minhash.signatures(x.ravel(), np.arange(n + 1) * x.shape[1], -(-bands * values // 2)), bands, values) for x in (one, two)]
    assert (keys[0] == keys[1]).any(axis=1).all()


@pytest.mark.parametrize("similar", [80, 60])
def test_minhash_equals_brute_force_at_lower_limits(spark, similar):
    rng = random.Random(similar)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([40, 120]))]
        texts += [" ".join(base), mutated(rng, base, rng.choice([0.02, 0.03, 0.05, 0.08]))]
    want, _ = brute_classes(list(enumerate(texts)), similar)
    assert want != brute_classes(list(enumerate(texts)))[0]
    got = {r["doc_id"]: r["component_id"] for r in minhash.classes(spark, documents(spark, texts), similar).collect()}
    assert got == want


# ---------------------------------------------------------------- repeated passages

def brute_removed(rows):
    first, docs = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in docs:
        if i is not None:
            for j in range(len(w) - 12):
                key = tuple(w[j : j + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone = np.zeros(len(w), dtype=bool)
        if i is not None:
            for j in range(len(w) - 12):
                if first[tuple(w[j : j + 13])] < i:
                    gone[j : j + 13] = True
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def test_substrings_equal_brute_force(spark):
    rng = random.Random(5)
    passages = [" ".join(f"p{rng.randint(0, 50)}" for _ in range(n)) for n in (12, 13, 14, 25, 60)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(0, 20))) for _ in range(4)]
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    texts += [None, "", " ", "é " * 12, "é " * 13, "é " * 30, "z " * 40_000, passages[4], passages[4]]
    ids = [rng.randint(-50, 500) for _ in texts[:-3]] + [None, 3, 3]
    got = substrings.remove_repeats(spark, documents(spark, texts, ids)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_removed(zip(ids, texts)), key=repr)


def test_a_block_does_not_depend_on_the_order_of_its_rows():
    rng = random.Random(6)
    ids, texts = [3, 1, None, 2, 2, 2, None], ["c d", "a", "n", "y", "x z", "x z", None]
    order = list(range(7))
    want = substrings.Block(pa.table({"doc_id": ids, "text": texts}))
    for _ in range(10):
        rng.shuffle(order)
        got = substrings.Block(pa.table({"doc_id": [ids[i] for i in order], "text": [texts[i] for i in order]}))
        assert got.row_ids == want.row_ids and got.texts == want.texts and (got.words == want.words).all()


def test_substrings_of_an_empty_table(spark):
    assert substrings.remove_repeats(spark, documents(spark, [])).count() == 0


def test_every_shift_of_two_positions_meets_the_cover():
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + k) % 7 in substrings.COVER and (j + k) % 7 in substrings.COVER for k in range(7))


# ---------------------------------------------------------------- vectors

VECTORS = "vec_id long, embedding array<float>, label int, cell int, block int, links long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, lab, 1, 2, 3) for i, e, lab in rows], VECTORS)


ODD = [
    (900, None, 1), (901, [], 1), (902, [1.0, None], 1), (903, [float("nan"), 1.0], 1), (904, [float("inf"), 1.0], 1),
    (905, [0.0, 0.0], 1), (906, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (907, [1.0, 0.0], 2), (908, [1.0, 0.0, 0.0], 1),
    (909, [2.0, 0.0], 1), (910, [3.0, 0.0], 1), (910, [3.0, 0.0], 1),
]


def clustered(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.3, 1.0], size=(n, 1))
    return [(int(i), [float(v) for v in np.float32(row)], int(i) % 3) for i, row in enumerate(x)]


def brute_groups(rows, similar=0.93):
    good = [(i, np.array(e, dtype=float), lab) for i, e, lab in rows if i is not None and e and lab is not None and all(v is not None and math.isfinite(v) for v in e) and any(e)]
    links = []
    for n, (a, x, la) in enumerate(good):
        for b, y, lb in good[:n]:
            if a != b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= similar:
                links.append((a, b))
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return closure({i for i, *_ in rows if i is not None}, links), count


@pytest.mark.parametrize("block", [2048, 16])
def test_embedding_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = clustered(1, 300) + ODD
    root, count = brute_groups(rows)
    got = embedding_dedup.groups(spark, vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        else:
            assert (r["n_links"], r["component_id"]) == (count[r["vec_id"]], root[r["vec_id"]]), r


def test_embedding_groups_of_an_empty_table(spark):
    assert embedding_dedup.groups(spark, vectors(spark, [])).count() == 0


@pytest.mark.parametrize("block", [8192, 20])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vafile, "BLOCK", block)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", max(3, block // 8))
    rows = clustered(2, 230) + ODD + [(231 + i, [0.5] * 8, 0) for i in range(9)]
    good = [(i, [math.floor(256 * float(v)) for v in e]) for i, e, _ in rows if i is not None and e and all(v is not None and math.isfinite(v) for v in e)]
    want = []
    for q, x in dict((i, x) for i, x in good if i % 50 == 0).items():
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q and len(x) == len(y))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    got = vafile.nearest(spark, vectors(spark, rows), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_an_empty_table(spark):
    assert vafile.nearest(spark, vectors(spark, []), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(200, 7)))
    cells, low, width = vafile._cells(x)
    q = np.floor(256 * rng.normal(size=(20, 7)))
    row = {"n": 200, "cells": cells.tobytes(), "low": low.tobytes(), "width": width.tobytes()}
    lower, upper = vafile._bounds(q, row)
    assert (lower <= q @ x.T).all() and (q @ x.T <= upper).all()


# ---------------------------------------------------------------- mixing

def test_raking_meets_the_targets(spark):
    rng = np.random.default_rng(4)
    cells = spark.createDataFrame([(a, b, c, int(rng.integers(1, 1000))) for a in "xyz" for b in "pq" for c in "mn"], "source string, lang string, topic string, tokens long")
    targets = {"source": 0.5, "lang": 0.7, "topic": 0.8}
    fitted = mixing.rake(mixing.smoothed_shares(cells.coalesce(1), targets), list(targets), 30)
    for k in targets:
        for r in fitted.groupBy(k).agg(F.sum("weight").alias("w"), F.first(f"{k}_share").alias("s")).collect():
            assert abs(r["w"] - r["s"]) < 1e-6


@pytest.mark.parametrize("last, missed", [(300, []), (200, [("topic", "n")])])
def test_cells_with_tokens_to_spare_take_up_what_full_cells_cannot(spark, last, missed):
    rows = [("a", "m", 1000), ("a", "n", 100), ("b", "m", 100), ("b", "n", last)]
    cells = spark.createDataFrame(rows, "source string, topic string, tokens long").coalesce(1)
    keys, wanted = ["source", "topic"], 750
    fitted = mixing.rake(mixing.smoothed_shares(cells, dict.fromkeys(keys, 0.0)), keys, 12, wanted)
    got = {(r["source"], r["topic"]): r["weight"] * wanted for r in fitted.collect()}
    assert all(got[a, b] <= n + 1e-6 for a, b, n in rows)
    assert abs(got["b", "n"] - last) < 1e-6 and abs(got["a", "m"] + got["b", "m"] - 375) < 3.75
    assert [(r["dimension"], r["value"]) for r in mixing.out_of_reach(fitted, keys).collect() if r["dimension"] == "topic"] == missed
    if not missed:
        assert all(abs(got[a, "m"] + got[a, "n"] - 375) < 3.75 for a in "ab")


def test_mixing_odd_tables(spark):
    df = documents(spark, [None, "", "a b c", "a b c", "x | y " * 30_000], [1, None, 2, 2, 3])
    got = mixing.sampled(spark, df)
    assert got.columns == [*df.columns, "mixing"]
    rows = got.select("doc_id", "text", "mixing.*").collect()
    assert len(rows) == 5 and all(0 <= r["probability"] <= 1 for r in rows)
    assert len({r["kept"] for r in rows if r["doc_id"] == 2}) == 1
    assert mixing.sampled(spark, documents(spark, [])).count() == 0


def test_mixing_uses_no_python(spark):
    plan = QUERIES["op8_mixing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# ---------------------------------------------------------------- SQL and pipeline

@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    from check import compare, database

    assert compare(QUERIES[name](spark, SF).toPandas(), database(SF).execute(ORACLES[name]).df()) is None


def test_pipeline_stages(spark):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, len(corpus_pipeline.STAGES) - 1
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if n < last:
            assert out.columns == columns and out.dtypes == docs.dtypes
            rows = [r.asDict() for r in out.collect()]
            out = spark.createDataFrame(rows, docs.schema)
        seen[name] = (docs.toPandas(), out.toPandas())
        docs = out
    before, after = seen["minmax_dedup"]
    root, _ = brute_classes(list(zip(before["doc_id"], before["text"])))
    assert set(after["doc_id"]) == {i for i in before["doc_id"] if root[i] == i}
    from panelspark.llm import pii

    before, after = seen["pii"]
    want = {i: pii.redacted(t) for i, t in zip(before["doc_id"], before["text"])}
    assert dict(zip(after["doc_id"], after["text"])) == want
    assert (after["n_chars"] == after["text"].str.len()).all()
    before, after = seen["toxicity"]
    assert set(after["doc_id"]) <= set(before["doc_id"]) and len(after) > 0.7 * len(before)
    before, after = seen["mixing"]
    assert 0 < len(after) < len(before)
    before, after = seen["bpe"]
    assert set(after["doc_id"]) == set(before["doc_id"]) and (after["n_tokens"] > 0).all()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in zip(before["doc_id"], before["text"])}
    assert {i: np.frombuffer(b, "<u4").tolist() for i, b in zip(after["doc_id"], after["ids"])} == ids


def test_pipeline_runs_on_odd_documents(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", None, "s", 13), (3, "mail x@y.org now", "en", None, 16)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0




def test_blocks_of_vectors_move_once_whatever_the_queries(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 40), monkeypatch.setattr(vafile, "QUERY_BLOCK", 16), monkeypatch.setattr(vafile, "SLICE", 5)
    for scale in (1, 1 << 10, 7_300_000):  # two, four and eight bytes a component
        x = np.random.default_rng(3).integers(-300, 301, (200, 4)) * [scale, 1, 1, 1] / 256
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        found = vafile.nearest(spark, df, F.col("vec_id") % 2 == 0, 3)
        # only queries are copied
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2
        whole = [[int(c) for c in row] for row in np.floor(x * 256)]
        want = {}
        for i in range(0, 200, 2):
            best = sorted((-sum(a * b for a, b in zip(whole[j], whole[i])), j) for j in range(200) if j != i)[:3]
            want |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(best)}
        assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()} == want
