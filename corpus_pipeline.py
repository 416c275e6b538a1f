"""A corpus pipeline: stages that each call one of the operators of sporeline.llm, with Parquet between them.

Each stage works on all that the one before has kept: quality rules drop documents, of near-duplicates one stays,
repeated passages are cut out of all texts but one, documents that hold a benchmark item go, and what is left is encoded.

Null and empty texts fail the quality rules, so no later stage meets them but for texts that are cut to nothing. Very long texts are
read whole. Of ties, such as repeated rows of one doc_id, near-dedup keeps those of the smallest doc_id, all rows of it; rows without a
doc_id pass if their text does. A passage stays in the text of the lowest hash that has it. Empty tables of documents or of items give no rows or drop none. Extra columns go along to the last stage, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sporeline.llm import bpe_codec, decontamination, quality_rules, simhash_dedup, substring_dedup
from sporeline.llm._shared import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text that they decode to."""
    import public_tokenizers

    return bpe_codec.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("simhash_dedup", near_dedup), ("substring_dedup", substrings), ("decontamination", decontaminate), ("bpe_codec", encode)]
#: Hashes with a seed, chains, edit distances and merges aren't expressible in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
