"""Incremental ingestion: documents and files that arrive in a drop folder are chunked, indexed and placed among fixed clusters once.

Which documents have been seen is kept in Spark's state store, by document; so a batch looks up its own documents, however many came
before. What a batch adds is written under its number: chunks, postings, the deltas of term frequencies and totals, vectors with their
clusters, and how far those lie from their centres. Nothing that came before is read. A batch that is run again
after a failure gets the same documents from the state store and writes to the same places.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators import index, parse, vectors
from corpusloom.operators.chunk import chunk_documents
from corpusloom.sources.tables import checkpointed
from corpusloom.streaming import deltas

DOCS = "doc_id long, category string, source_file string, content string"
FILES = "path string, modificationTime timestamp, length long, content binary"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def longest(batch: DataFrame) -> DataFrame:
    """The documents of a batch, each once: the longest of several with one id. Rows without id or content are left out."""
    best = F.max_by(F.struct("category", "source_file", "content"), F.struct(F.length("content"), "content"))
    return batch.where("doc_id IS NOT NULL AND content IS NOT NULL").groupBy("doc_id").agg(best.alias("d")).select("doc_id", "d.*")


def first_arrivals(stream: DataFrame) -> DataFrame:
    """The documents of a stream whose ids no earlier micro-batch had, the longest of several in one. The state is one flag for an id."""

    def keep(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for rows in groups:
            if not state.exists:
                order = rows["content"].str.len()
                rows = rows[order == order.max()].sort_values("content").tail(1)
                if best is None or (len(rows["content"].iloc[0]), rows["content"].iloc[0]) > (len(best["content"].iloc[0]), best["content"].iloc[0]):
                    best = rows
        if best is not None:
            state.update((True,))
            yield best

    known = stream.where("doc_id IS NOT NULL AND content IS NOT NULL").select("doc_id", "category", "source_file", "content")
    return known.groupBy("doc_id").applyInPandasWithState(keep, DOCS, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def sum_terms(parts: DataFrame) -> DataFrame:
    return parts.groupBy("term").agg(F.sum("df").alias("df"))


def sum_totals(parts: DataFrame) -> DataFrame:
    return parts.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def append_batch(docs: DataFrame, out: str, number: int, centers: list[list[float]] | None = None) -> None:
    """What the new documents of one batch add to the tables under ``out``, made by the batch chunker.

    Ids must be new to ``out``; ingest_stream sees to that. Chunks are numbered within their batch, and chunk_index holds the batch in its
    upper bits. The totals are written last: what has no totals yet is not read. With ``centers`` each chunk's vector is placed among them.
    """
    spark = docs.sparkSession
    fresh = checkpointed(longest(docs))
    if fresh.isEmpty():
        return
    chunks = chunk_documents(fresh).withColumn("chunk_index", F.shiftleft(F.lit(number).cast("long"), 40) + F.col("chunk_index"))
    chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
    stored = spark.read.parquet(f"{out}/chunks/batch={number}")
    index.postings(stored).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
    counted = spark.read.parquet(f"{out}/postings/batch={number}")
    if centers is not None:
        placed = vectors.assign(index.build_vectors(stored), centers)
        placed.write.mode("overwrite").parquet(f"{out}/vectors/batch={number}")
        near = spark.read.parquet(f"{out}/vectors/batch={number}").agg(F.count(F.lit(1)).alias("n_vectors"), F.avg("center_score").alias("mean_score"))
        near.write.mode("overwrite").parquet(f"{out}/nearness/batch={number}")
    deltas.append(index.frequencies(counted), f"{out}/terms", number, sum_terms)
    sizes = counted.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))
    totals = stored.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(F.broadcast(sizes))  # one row
    deltas.append(totals, f"{out}/totals", number, sum_totals)


def _started(stream: DataFrame, out: str, checkpoint: str, available_now: bool, centers: list[list[float]] | None) -> StreamingQuery:
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    if "HDFSBacked" in before:
        spark.conf.set(PROVIDER, ROCKSDB)  # ids by the thousand million do not fit in the default store's memory
    try:
        writer = first_arrivals(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        writer = writer.foreachBatch(lambda df, number: append_batch(df, out, number, centers))
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(PROVIDER, before)


def ingest_stream(
    spark: SparkSession, drop: str, out: str, checkpoint: str, available_now: bool = True, files_per_batch: int | None = None, centers: list[list[float]] | None = None
) -> StreamingQuery:
    """Follows the Parquet files of a drop folder. ``out`` and ``checkpoint`` belong together: the one holds what the other says is done."""
    reader = spark.readStream.schema(DOCS)
    reader = reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)
    return _started(reader.parquet(drop), out, checkpoint, available_now, centers)


def documents_of(files: DataFrame, category: str = "default", name: Column | None = None) -> DataFrame:
    """Dropped text files (path, content, ...) as documents, routed and parsed like a batch of files.

    ``name`` is the file's name where the end of its path is not. The id is a hash of the path: a file that is dropped under the same path again is
    the same document. Suffixes that need a binary parser wait for one and are left out.
    """
    named = parse.describe_files(files if name is None else files.withColumn("path", F.concat("path", F.lit("/"), name)))
    routed = parse.route_manifest(named).where("status = 'success' AND parser = 'txt_direct'")
    parsed = parse.parse_text(routed)
    return parsed.select(F.xxhash64("path").alias("doc_id"), F.lit(category).alias("category"), F.col("original").alias("source_file"), "content")


def ingest_files(
    spark: SparkSession, drop: str, out: str, checkpoint: str, available_now: bool = True, files_per_batch: int | None = None, centers: list[list[float]] | None = None,
    category: str = "default", name: Column | None = None,
) -> StreamingQuery:
    """Follows the files of a drop folder and its folders themselves: listed, routed, decoded and ingested."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    reader = reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)
    return _started(documents_of(reader.load(drop), category, name), out, checkpoint, available_now, centers)


def corpus_statistics(spark: SparkSession, out: str) -> index.LexicalIndex:
    """The lexical index over all that was ingested: postings as they were written, frequencies and totals summed over the deltas."""
    last = max((p.last for p in deltas.parts(spark, f"{out}/totals")), default=-1)
    counted = spark.read.parquet(f"{out}/postings").where(F.col("batch") <= last).drop("batch")
    df, totals = deltas.read(spark, f"{out}/terms"), deltas.read(spark, f"{out}/totals")
    return index.lexical_index(counted, sum_terms(df), sum_totals(totals))


def drift(spark: SparkSession, out: str, fitted: float) -> DataFrame:
    """batch, n_vectors, mean_score (cosine with the nearest centre) and drift, how far that lies below ``fitted``, the mean over the
    vectors that the centres were fitted on. Centres that drift have grown old: fit new ones and place all vectors anew."""
    return spark.read.parquet(f"{out}/nearness").select("batch", "n_vectors", "mean_score", (F.lit(fitted) - F.col("mean_score")).alias("drift"))
