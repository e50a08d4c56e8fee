"""From raw documents to token ids: STAGES in order, each written as Parquet and read back as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows it gets; all but the last return the columns of ``docs``.
The last adds variant, n_pieces and ids. No stage is expressible in SQL as a whole, so ORACLE_SQL is None and the tests
compare each stage with a plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import mixing, ngramjoin, pii, quality, sentencepieces
from sigloom.llm.common import documents, saved, tokenizer


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the quality model go."""
    return quality.accepted(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id stays."""
    return ngramjoin.one_of_each(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values are replaced by their pseudonyms."""
    return pii.masked(docs, pii.session_key(spark), count=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources reach their target weights."""
    return mixing.mixed(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with merge-dropout."""
    return sentencepieces.encoded(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("private_values", mask_private),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, "snappy")
    return docs
