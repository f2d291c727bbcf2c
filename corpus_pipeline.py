"""A pipeline of the training-data operators: documents go through the stages in order."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, minhash, mixing, pii, toxicity
from panelspark.session import land

TOXIC_FROM = 0.3
HELD_OUT = (4, 2)  # labels of ids with this remainder of their CRC are never learnt
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the limit; a null or empty text has the score of no features."""
    parts, held_out = HELD_OUT
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(spark, toxicity.labelled_sample(docs, labels, "toxic", remainder != held_out))
    return docs.where(model.score(F.col("text")) < TOXIC_FROM)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id."""
    return minhash.deduplicated(spark, docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars follows the text."""
    clean = docs.withColumn("text", pii.redact(F.col("text")))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the sample to source, language and topic targets holds."""
    return mixing.sampled(spark, docs, within=True).where("mixing.kept").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed as little-endian 32-bit numbers, and digests of ids and decoded text."""
    ids = docs.select("doc_id", "source", "lang", bpe.encode_packed(F.col("text"), VOCABULARY).alias("ids"))
    return ids.select(
        "*",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(bpe.decode_packed(F.col("ids"), VOCABULARY).cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", not_toxic),
    ("minmax_dedup", one_of_each_group),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("bpe", encoded),
]

# models and hashing are not SQL; tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), spark, f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
