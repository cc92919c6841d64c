"""From raw documents to token ids: the stages of a training corpus, one after the other.

1. quality: documents that the classifier rejects go.
2. near duplicates: of each group of linked documents (five-word shingles, similarity 0.8) one stays.
3. decontamination: documents that hold a benchmark item go.
4. personal data: spans are replaced by their kind.
5. tokens: ids by the public vocabulary, checked by decoding them again.

All but the last return the columns of ``documents``.  Each stage holds the promises of its operator
for nulls, empty and long texts, repeated rows, empty tables and extra columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from promptloom.llm import bpe_trie, decontaminate, minmax, pii, quality
from promptloom.plans.registry import table
from promptloom.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax.deduplicate(docs, width=5, threshold=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the workers are those of four other stages, so they remember less
    return bpe_trie.encode_checked(docs, public_tokenizers.path(VOCABULARY), most_words=100_000, most_fits=200_000)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("tokens", token_ids),
]

#: Trained models and tokenizers are no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before it keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
