"""A corpus pipeline over the training-data operators.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents. Further columns of
docs pass through, whatever their names; null texts count as empty, and nulls in other columns are values like any
other; an empty table passes all stages. Very long texts are read whole by every stage, each in one row. Repeated rows
pass the first three stages alike, and one of them stays behind the fourth; ties there go to the least doc_id, then to
the least hash of the text, so no stage's result depends on the order of rows.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import line_dedup, packing, quality_model, quality_rules, simhash
from pulsegrid.llm.common import shared_dir
from pulsegrid.session import attach


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores under 0.7."""
    return quality_model.stage(attach(spark), docs, sf_dir)


def adaptive_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie outside the fences of their language and source."""
    return quality_rules.stage(attach(spark), docs, sf_dir)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that an earlier line is equal or near to; keeps all documents."""
    return line_dedup.stage(attach(spark), docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of SimHash near-duplicates."""
    return simhash.stage(attach(spark), docs, sf_dir)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences; a row for each piece."""
    return packing.stage(attach(spark), docs, sf_dir)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", adaptive_rules),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_duplicates),
    ("packing", sequences),
]

#: A trained classifier and a tokenizer are among the stages: SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for sf_dir's documents; each stage's rows lie in the shared folder."""
    folder = posixpath.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = posixpath.join(folder, str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
