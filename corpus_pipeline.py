"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns the columns of documents; the last one returns the encoded documents.
Stages write nothing themselves: whoever runs them stores one stage's rows as
Parquet and hands them to the next, as ``run`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartospark.llm import line_dedup, mixing, ngram_join, quality, sentencepiece_codec
from cartospark.llm.common import WORD, scratch, table
from cartospark.llm.queries import model_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with cutoffs certified on the labelled ones among them."""
    found = quality.verdicts(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return found.where("kept").select(*(F.col(f"_{c}").alias(c) for c in COLUMNS))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line chunks that an earlier document has; n_chars follows. A document that loses its last word so is a copy and goes."""
    left = line_dedup.dedup_lines(docs).where((F.col("n_removed_lines") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    groups = ngram_join.ngram_components(docs)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs).select(*COLUMNS)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document of the mix, with the digests of ids and decoded text."""
    return sentencepiece_codec.round_trip(docs, model_path(), keep=("ids",))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Rounding draws and tokenizer ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows stored before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
