"""The supplied tables seen as what the operators work on: documents, chunks, queries, vectors, sheet rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document; the start of its first line is its section."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_index"), "doc_id", F.lit(0).alias("seq"), F.col("lang").alias("category"), F.col("source").alias("source_file"),
        F.substring(F.element_at(F.split("text", "\n"), 1), 1, 40).alias("section_path"), T.classify_content(F.col("text")).alias("content_type"),
        F.col("text").alias("content"), F.lit("NL").alias("split_strategy"), F.lit(False).alias("has_image"), F.array().cast("array<string>").alias("image_ids"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query and query_vec: benchmark items, with the vector of the same number."""
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(vecs, "query_id", "left")


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_index"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_index"), "embedding")
    return vecs.join(docs, "chunk_index", "left_semi")


def markdown(html):
    """A page as Markdown: headings, paragraphs, and list links as images."""
    steps = [
        (r"(?s)<(script|style|head)[^>]*>.*?</(script|style|head)>", ""), (r'<li><a href="[^"]*">([^<]*)</a></li>', "\n![$1](images/$1.png)\n"),
        (r"<h1>([^<]*)</h1>", "\n\n## $1\n\n"), (r"</?p>|<br>", "\n\n"), (r"<[^>]*>", ""), (r"\n{3,}", "\n\n"),
    ]
    for pattern, made in steps:
        html = F.regexp_replace(html, pattern, made)
    return html


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("page_id").alias("doc_id"), F.lit("web").alias("category"), F.col("url").alias("source_file"), markdown(F.col("html")).alias("content"))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as sheets: one document per size, one sheet per manufacturer, a heading row before each brand."""
    parts = table(spark, sf_dir, "part")
    about = ["p_size", "p_type"]
    heads = parts.select(*about, "p_brand").distinct().select(*about, F.concat("p_brand", F.lit(" 0")).alias("row_no"), F.array(F.concat("p_brand", F.lit(":")), F.lit("")).alias("cells"))
    body = parts.select(*about, F.concat("p_brand", F.lit(" 1 "), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("row_no"), F.array(F.col("p_partkey").cast("string"), "p_name", F.lit(None), F.col("p_size").cast("string")).alias("cells"))
    rows = heads.unionByName(body)
    return rows.select(F.col("p_size").cast("long").alias("doc_id"), F.concat(F.lit("size "), "p_size").alias("stem"), F.col("p_type").alias("sheet"), F.col("p_type").alias("sheet_no"), "row_no", "cells")
