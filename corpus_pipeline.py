"""A corpus cleaned and packed: the stages of a training-data pipeline, one after another.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, the last one the packed
pieces. What a stage reads, fits and decides covers all that the stage before kept.

Defined cases: documents without text have no words and go with the quality rules; rows without doc_id are
documents like others, never labelled, after all others of a group of copies, and before all others where
passages repeat; of repeated rows one stays (near copies); rows of one doc_id with different texts are
judged each; texts of any length are read whole; an empty table gives no pieces; other columns, whatever
their names, are carried up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from granary.llm import packing, quality_classifier, quality_rules, simhash, suffix_dedup
from granary.llm.common import discard, settled

#: Documents that the classifier scores below this go.
QUALITY_THRESHOLD = 0.3


def _known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels to learn from: those of rows that are not held out."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality_classifier.held_out("doc_id"))


def drop_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules or the isolation forest reject."""
    rules, _ = quality_rules.fit_rules(spark, docs, _known_labels(spark, sf_dir))
    return rules.keep(docs)


def drop_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality_classifier.QualityClassifier().fit(docs, _known_labels(spark, sf_dir)).keep(docs, QUALITY_THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id."""
    return simhash.keep_first(docs, simhash.NearCopies().components(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of 100 bytes or more that occur earlier."""
    return suffix_dedup.dedup_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", drop_by_rules),
    ("quality_classifier", drop_by_classifier),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: SQL cannot express fitted models, fingerprints or evolved packings: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs, source = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if source is not None:
            discard(source)
        source = docs
    return STAGES[-1][1](spark, docs, sf_dir)
