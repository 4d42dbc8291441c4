"""Documents to packed training sequences: quality rules, exact dedup, near dedup, secret redaction, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is
written as Parquet in the shared folder and read again as the next stage's
docs, so a lost executor costs part of one stage. All but the last return the
columns of `documents`, further ones included, whatever their names.

An empty table passes every stage as an empty one. Rows that repeat an id are rows of their own until a dedup stage keeps one. Very long
texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm.common import table, written
from sievework.llm.exact_dedup import drop_copies
from sievework.llm.near_dedup import similar_groups
from sievework.llm.packing import pack_documents
from sievework.llm.quality import keep_good
from sievework.llm.secrets import redact_secrets
from sievework.llm.simhash import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands and base counts keep; those with a null, empty or short text go."""
    return keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null is empty), the document with the largest id; a null id stays only alone."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose 5-word shingles have Jaccard similarity 0.8 or more, the document with the smallest id.

    Candidates are the SimHash components of these shingles, and texts with a common MinHash key, as most such texts differ in more bits than
    fingerprints are linked at; each link is checked exactly. Texts without words, null ones too, are one component; a null id stays only where its component has no other.
    """
    return drop_near_copies(docs, groups=similar_groups)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and `n_chars` set to the new length; null texts and ids stay."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens with their places in sequences; a null or empty text has its end id alone."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("secret scan", secret_scan),
    ("packing", packing),
]

#: Compression ratios, shingles, the forest and the tokenizer are not SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
