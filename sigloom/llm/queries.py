"""The registered queries of the training-data operators, and the SQL twins of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import (
    ann, convtrie, hilbert, langid, license, mixing, ngramjoin, pii, quality, sentencepieces, suffixdedup, tokenout, vectorcodes,
)
from sigloom.llm.common import documents, tokenizer
from sigloom.llm.sql import SQL  # noqa: F401  (the SQL twins, for __spark_entry__)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.classes(documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    ids = sentencepieces.encoded(documents(spark, sf_dir).select("doc_id", "text"), model)
    return sentencepieces.decoded(ids, model).select(
        "doc_id", "variant", "n_pieces", F.crc32(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_crc32"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.masked(documents(spark, sf_dir).select("doc_id", "text"), pii.session_key(spark))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.measured(docs.select("doc_id", "text"), model).drop("text")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.deduplicated(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", *mixing.PLAN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identified(docs, langid.fit_languages(docs))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenout.write_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), ordinary=False)
    return tokenout.read_tokens(spark, path)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return ann.nearest(rows, rows.where(F.col("id") % 20 == 0))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.plan(documents(spark, sf_dir))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return convtrie.trie(convtrie.relinked(convtrie.sequences(turns)))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_ngram_join, op3_sentencepiece, op4_pii, op5_quality_rules, op6_suffix_dedup, op7_mixing,
    op8_language_id, op9_token_output, op10_nearest, op11_vector_codes, op12_hilbert_shards, op13_conversation_trie,
)} | {"pipeline": corpus_pipeline.run}
