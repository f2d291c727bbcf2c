"""One query for each operator over the given tables, and its SQL where SQL can express it."""

import public_tokenizers
from pyspark.sql import functions as F

from panelspark.llm import bpe, codebooks, decontaminate, embedding_dedup, lexical, minhash, mixing, pii, quality, substrings, toxicity, vafile, wavelet


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_pii(spark, sf_dir):
    spans = F.col("spans")
    found = _table(spark, sf_dir, "documents").select("doc_id", pii.find(F.col("text")).alias("spans"))
    return found.select(
        "doc_id",
        *[pii.count(spans, kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.joined(spans, pii.BASE_KINDS).cast("binary"), 256).alias("base_sha256"),
        pii.joined(spans).alias("spans"),
    )


def op2_toxicity(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    sample = toxicity.labelled_sample(documents, _table(spark, sf_dir, "labels"), "toxic", _remainder(4) != 2)
    model = toxicity.fit(spark, sample)
    scored = documents.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_bpe(spark, sf_dir, path=public_tokenizers.path("word_bpe_49k.json")):
    ids = _table(spark, sf_dir, "documents").select("doc_id", bpe.encode_packed(F.col("text"), path).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decode_packed(F.col("ids"), path).alias("decoded"))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_substrings(spark, sf_dir):
    clean = substrings.remove_repeats(spark, _table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_tokens(spark, sf_dir, path=public_tokenizers.path("byte_bpe_50k.json")):
    tokens = wavelet.write_and_read(spark, _table(spark, sf_dir, "documents"), path)
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_embeddings(spark, sf_dir):
    return embedding_dedup.groups(spark, _table(spark, sf_dir, "embeddings"))


def op7_quality(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    sample = toxicity.labelled_sample(documents, _table(spark, sf_dir, "labels"), "quality", _remainder(5) != 0, quality.SAMPLE_PER_CLASS)
    model = quality.fit(spark, sample)
    scored = documents.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_mixing(spark, sf_dir):
    mixed = mixing.sampled(spark, _table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "source", "lang", "mixing.topic", F.col("mixing.tokens").alias("n_tokens"),
        F.round("mixing.probability", 9).alias("probability"), "mixing.kept",
    )


def op9_topk(spark, sf_dir):
    return vafile.nearest(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op10_minmax(spark, sf_dir):
    return minhash.classes(spark, _table(spark, sf_dir, "documents"))


def op11_lexical(spark, sf_dir):
    return lexical.ranked(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 50)


def op12_codebooks(spark, sf_dir):
    return codebooks.codes(spark, _table(spark, sf_dir, "embeddings"))


def op13_decontaminate(spark, sf_dir):
    found = decontaminate.contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_substrings": op4_substrings,
    "op5_tokens": op5_tokens,
    "op6_embeddings": op6_embeddings,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_topk": op9_topk,
    "op10_minmax": op10_minmax,
    "op11_lexical": op11_lexical,
    "op12_codebooks": op12_codebooks,
    "op13_decontaminate": op13_decontaminate,
}

ORACLES = {
    "op4_substrings": substrings.oracle(),
    "op6_embeddings": embedding_dedup.oracle(),
    "op9_topk": vafile.oracle(),
    "op10_minmax": minhash.oracle(),
    "op8_mixing": mixing.oracle(),
    "op11_lexical": lexical.oracle(),
    "op12_codebooks": codebooks.oracle(),
    "op13_decontaminate": decontaminate.oracle(),
}
