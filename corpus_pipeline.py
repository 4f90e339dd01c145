"""From raw documents to sampled token sequences, one operator a stage.

Quality rules drop junk, the n-gram join leaves the smallest doc_id of each group of
near copies (five words, similarity 0.8), decontamination drops documents that hold
benchmark items, personal data is replaced by its kind, and what is left is
segmented. Each stage's rows are written to the shared folder and read again by the next,
which deletes them once its own are written.

Defined results: a null or empty text fails the quality rules, so its document goes; documents
without a doc_id have no near copies, and the other stages treat them like all others; repeated rows
(one doc_id, one text) are one document, whose rows all stay or all go; of texts that share a doc_id
one is compared with other documents, and all rows of the id stay or go with it; columns
besides those of documents are dropped by the first stage; an empty documents table gives an
empty result, an empty labels table no learned rule, an empty benchmark no contamination; very long texts
are worked on whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, ngram_join, pii, quality_rules, spm_sample
from tessera.storage import discard, materialize, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs, width=5, num=80, den=100).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers replaced."""
    return pii.redact_documents(docs).select(*COLUMNS)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document."""
    return spm_sample.segmentations(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", segmentation),
]

#: Learned rules, components and sampling are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[str] = []
    for i, (_, stage) in enumerate(STAGES):
        before, own = set(written()), []
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{i}", scratch=own)
        # the rows before, and what the stage needed for its own
        discard(spark, last + [path for path in written() if path not in before and path not in own])
        last = own
    return docs
