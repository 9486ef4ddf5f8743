"""documents -> quality rules -> MinHash near-dedup -> benchmark decontamination -> secret scan -> packing.

Defined cases: rows with null, empty or very short text fail the quality rules; copies of a text, near or exact,
leave their smallest doc_id; rows with a null doc_id are linked with nothing and stay; repeated rows of one doc_id
leave one. Texts are read whole at every stage. Columns of documents, any others too, come through to the last
stage but one. An empty table gives an empty result. Each stage's table is written to the shared folder and the one
before it removed, so lost executors cost a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import balanced_packing, decontamination, near_dups, quality, secrets
from loomtext.runtime import Scratch, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_judged(docs, table(spark, sf_dir, "labels"))


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_first(docs)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = balanced_packing.pack(docs)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", good), ("near_dups", first_of_group), ("decontamination", not_leaked), ("secrets", without_secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written as Parquet in the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.keep(name)
    return docs


#: Tokenizer bands and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
