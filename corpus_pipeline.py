"""A corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, packing.

Each stage takes what the stage before it kept; all but the last return the columns of documents, extra columns of the input among
them. Defined cases, for every stage: an empty table gives an empty table; null and empty texts fail the quality rules, and where a later
stage meets them they have no words and stay; very long texts are read whole; rows with a null doc_id are never near copies of others; of
rows that share a doc_id one of each fingerprint stays, chosen by a hash of its columns; repeated passages stay in the row with the
smallest doc_id. The text is the only column that a stage changes, and n_chars where it is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orthoweave.llm.common import Scope, discard, written
from orthoweave.llm.decontamination import clean_documents
from orthoweave.llm.packing import packed_pieces
from orthoweave.llm.quality_bands import kept_documents
from orthoweave.llm.simhash_trie import deduplicated
from orthoweave.llm.substring_dedup import without_repeats
from orthoweave.llm.textcode import tokenizer_path

#: The tokenizer whose ids are packed.
TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands and base rules keep."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id holds."""
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packed_pieces(docs, tokenizer_path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Zstandard ratios, SimHash components and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table goes once the next one is written, and so does what a stage kept beside it.

    The packed pieces are the reader's to write: what they lean on (the last stage's table) stays in the shared folder.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with Scope():
            docs = written(stage(spark, docs, sf_dir), name, lasting=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
