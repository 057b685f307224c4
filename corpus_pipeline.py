"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import jaccard_join, line_dedup, packing, quality_rules, secret_scan
from corpusloom.sources import tables


def _as_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with its n_chars, if it has any, made true again."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of shared runs of lines are cut out; a document that is nothing but repeats goes."""
    left = line_dedup.line_dedup(docs).where(F.btrim("text", F.lit(quality_rules.SEPARATORS)) != "")
    return _as_documents(left, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share three quarters of their shingles, the smallest id stays."""
    return jaccard_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, encoded ones too, are replaced by marks."""
    return _as_documents(secret_scan.redact_secrets(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bin, offset and the bin's final length."""
    return packing.pack_documents(docs, packing.token_estimate(F.col("text")))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: Weak supervision, R-trees and bin packing have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written in the cluster's shared folder and read again.

    What one stage has written goes once the next one has written its own; the last of these feeds the result and stays.
    """
    at = f"{tables.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
            if k:
                tables.delete_folder(spark, f"{at}/{k - 1}")
    return docs
