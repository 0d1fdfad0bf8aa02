"""Corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last
return the columns of documents. Defined cases are those of the operators: null and empty texts are
scored like any text, are no one's near-duplicate, hold no benchmark passage and have no tokens;
repeated rows of one doc_id stay together; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenvec.llm import decontaminate, near_dup, quality, tree_bpe
from lumenvec.llm.common import staged, table, tune
from lumenvec.llm.tokens import vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on docs and labels, does not reject."""
    tune(spark)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    tune(spark)
    return near_dup.one_of_each(docs, shingle=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    tune(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers) and digests of ids and decoded text."""
    tune(spark)
    encoded = tree_bpe.encode_documents(docs, vocabulary_path("word_bpe_49k.json"))
    return tree_bpe.digests(encoded, "ids")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", encoding_stage),
]

#: The fitted classifier and the tokenizer are not SQL; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
