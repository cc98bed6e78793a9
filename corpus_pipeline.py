"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the last returns the
encoded documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import bpe_trie, lang_parse, mixture_fit, pii_surrogates, simhash_gray
from quarryline.llm.common import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language stay: null texts and those without a letter go. Each row goes through the parse whole; if
    no language could be learned, all that have a letter stay."""
    samples = lang_parse.fit_samples(docs)
    if not samples:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = lang_parse.identify(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"), samples)
    return found.where(F.col("lang_pred") != "und").select("doc_id.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more) stays, that with the smallest id (of rows with one id, that whose text has the
    smallest hash; rows without an id come last). Rows that share an id without being near copies all stay."""
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.md5("text").alias("hash"), F.col("__row").alias("row"))
    found = simhash_gray.similar_groups(rows.select(key.alias("doc_id"), "text", "__row"), row="__row")
    kept = found.where(F.col("doc_id.row") == F.col("component_id.row")).select(F.col("doc_id.row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts are replaced; n_chars is the length of the new text."""
    found = pii_surrogates.replace_entities(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to three times. Rows go through the mix whole, whatever their ids."""
    taken = mixture_fit.mix(docs.select(F.struct(*docs.columns).alias("doc_id"), "source", "text")).where("copies > 0")
    return taken.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text and a checksum of what they decode to."""
    found = bpe_trie.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("encode", encode)]
#: Not expressible in SQL. The operators of the stages are tested against brute force, a library or plain loops each, and
#: the stages on rows with shared or no ids, in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
