"""Lexical and vector indexes over a chunks table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import helpers
from corpusloom.functions import text as T
from corpusloom.sources.tables import Steps, checkpointed, current_snapshot, folders, new_snapshot

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass(frozen=True)
class LexicalIndex:
    """postings(term, chunk_index, tf, dl), terms(term, df, idf) and corpus, one row of n_docs, avgdl, avg_idf.

    The length of its chunk is kept beside each posting, so scoring needs no join with a table of chunks.
    """

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


Tokenizer = Callable[[Column], Column]


def doc_stats(chunks: DataFrame, tokenize: Tokenizer = T.tokenize) -> DataFrame:
    return chunks.select("chunk_index", F.size(tokenize(F.col("content"))).cast("long").alias("dl"))


def postings(chunks: DataFrame, tokenize: Tokenizer = T.tokenize) -> DataFrame:
    """Term counts. Texts are dealt by chunk, as they take less room than their postings; a chunk's tokens are then counted in one task, and what is
    summed up by chunk next needs no exchange.

    ``tokenize`` must be the one that queries are cut with, such as helpers.dictionary_tokens with a list of terms. No token may hold T.BETWEEN.
    """
    texts = chunks.select("chunk_index", F.coalesce("content", F.lit("")).alias("content"))
    if tokenize is T.tokenize:
        tokens = texts.repartition("chunk_index").select("chunk_index", tokenize(F.col("content")).alias("tokens"))
    else:  # may run in Python, after which Spark no longer knows that rows lie by chunk; so tokens travel, as one string
        cut = texts.select("chunk_index", tokenize(F.col("content")).alias("tokens"))
        joined = cut.select("chunk_index", F.when(F.size("tokens") > 0, F.array_join("tokens", T.BETWEEN)).alias("joined")).repartition("chunk_index")
        tokens = joined.select("chunk_index", F.split("joined", T.BETWEEN).alias("tokens"))
    # explode() would have Spark cut each text once more, to see before the exchange whether it has tokens
    rows = tokens.select("chunk_index", F.size("tokens").cast("long").alias("dl"), F.explode_outer("tokens").alias("term")).where("term IS NOT NULL")
    return rows.groupBy("term", "chunk_index").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def frequencies(counted: DataFrame) -> DataFrame:
    """term and df of postings; of several batches of chunks they add up."""
    return counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lexical_index(counted: DataFrame, df: DataFrame, totals: DataFrame) -> LexicalIndex:
    """The index for postings, document frequencies (term, df) and one row of n_docs and n_tokens.

    idf = ln(N - df + 0.5) - ln(df + 0.5); a negative one becomes a quarter of the mean over all terms.
    """
    stats = totals.select("n_docs", (F.col("n_tokens") / F.nullif(F.col("n_docs"), F.lit(0))).alias("avgdl"))
    raw = df.crossJoin(F.broadcast(stats))  # one row
    raw = raw.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("avg_idf"))
    terms = raw.crossJoin(F.broadcast(mean))  # one row
    idf = F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("avg_idf")).otherwise(F.col("raw"))
    return LexicalIndex(counted, terms.select("term", "df", idf.alias("idf")), stats.crossJoin(F.broadcast(mean)))


def indexed(counted: DataFrame, chunks: DataFrame) -> LexicalIndex:
    """The index for the postings of chunks. Terms and totals are checkpointed; postings stay as they are."""
    with Steps(chunks.sparkSession) as steps:
        seen = steps.keep(counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")))
        sizes = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
        totals = chunks.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(F.broadcast(sizes))  # one row
        made = lexical_index(counted, seen.select("term", "df"), totals)
        terms, corpus = steps.keep(made.terms), steps.keep(made.corpus)
        steps.done(terms, corpus)
    return LexicalIndex(counted, terms, corpus)


def build_bm25(chunks: DataFrame, tokenize: Tokenizer = T.tokenize) -> LexicalIndex:
    """The lexical index of chunks. Its postings are cut from the texts wherever they are read, since they take several times the texts' room when
    written; what is read more than once should be written by the caller, as rebuild() does."""
    return indexed(postings(chunks, tokenize), chunks)


def text_hashes(chunks: DataFrame) -> DataFrame:
    """chunk_index, t (what is embedded for a chunk) and text_hash."""
    body = F.coalesce("enriched_content", "content")
    keyed = chunks.select("chunk_index", T.embed_text(F.col("content_type"), F.col("section_path"), F.col("source_file"), body).alias("t"))
    return keyed.withColumn("text_hash", F.sha2("t", 256))


def build_vectors(chunks: DataFrame, cache: DataFrame | None = None, dim: int = 64, encoder=helpers.hashed_vector) -> DataFrame:
    """chunk_index, text_hash, embedding. Each distinct text is embedded once, and not at all if ``cache``
    (text_hash, embedding) has it."""
    keyed = text_hashes(chunks)
    todo = keyed.dropDuplicates(["text_hash"])
    if cache is not None:
        todo = todo.join(cache, "text_hash", "left_anti")
    made = todo.select("text_hash", helpers.embed(F.col("t"), dim, encoder).alias("embedding"))
    known = made if cache is None else cache.select("text_hash", "embedding").unionByName(made)
    return keyed.select("chunk_index", "text_hash").join(known, "text_hash")


def cached_vectors(chunks: DataFrame, cache: str, dim: int = 64, encoder=helpers.hashed_vector) -> DataFrame:
    """build_vectors with a cache in a folder, to which what is new is appended: a text is embedded once for all builds.

    The cache lies in folders by the first digit of the hash. A text that two builds embed at once is there twice and counts once.
    """
    spark = chunks.sparkSession
    keyed = text_hashes(chunks)
    todo = keyed.select("text_hash", "t").dropDuplicates(["text_hash"])
    known = spark.read.parquet(cache).select("text_hash") if folders(spark, cache) else None
    todo = checkpointed(todo if known is None else todo.join(known, "text_hash", "left_anti"))
    made = todo.select("text_hash", helpers.embed(F.col("t"), dim, encoder).alias("embedding"), F.substring("text_hash", 1, 1).alias("digit"))
    if known is None or not todo.isEmpty():
        made.repartition("digit").write.mode("append").partitionBy("digit").parquet(cache)
    if not folders(spark, cache):  # no text at all
        return build_vectors(chunks, None, dim, encoder)
    held = spark.read.parquet(cache).groupBy("text_hash").agg(F.first("embedding").alias("embedding"))
    return keyed.select("chunk_index", "text_hash").join(held, "text_hash")


def rebuild(chunks: DataFrame, root: str, cache: str, encoder=helpers.hashed_vector, tokenize: Tokenizer = T.tokenize) -> str:
    """Chunks, postings, terms, corpus and vectors as one snapshot under ``root``; the folder. Readers have the one before until all is there."""
    spark = chunks.sparkSession
    with new_snapshot(spark, root) as at:
        chunks.write.parquet(f"{at}/chunks")
        stored = spark.read.parquet(f"{at}/chunks")
        postings(stored, tokenize).write.parquet(f"{at}/postings")
        made = indexed(spark.read.parquet(f"{at}/postings"), stored)
        for name in ("terms", "corpus"):
            getattr(made, name).write.parquet(f"{at}/{name}")
        cached_vectors(stored, cache, encoder=encoder).write.parquet(f"{at}/vectors")
    return at


def read_index(spark: SparkSession, root: str) -> LexicalIndex | None:
    """The lexical index of the last complete snapshot."""
    at = current_snapshot(spark, root)
    return at and LexicalIndex(*[spark.read.parquet(f"{at}/{name}") for name in ("postings", "terms", "corpus")])


def vector_table(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vector collection: one row per chunk, section paths cut to 8,000 characters."""
    about = chunks.select("chunk_index", "category", "source_file", F.substring("section_path", 1, 8000).alias("section_path"), "content_type", "content")
    return about.join(vectors.select("chunk_index", "embedding"), "chunk_index")


def index_stats(stats: DataFrame, vectors: DataFrame) -> DataFrame:
    """n_chunks, n_tokens, n_vectors and dims, the distinct vector lengths."""
    one = stats.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("dl").alias("n_tokens"))
    two = vectors.agg(F.count(F.lit(1)).alias("n_vectors"), F.array_join(F.array_sort(F.collect_set(F.size("embedding").cast("string"))), ",").alias("dims"))
    return one.crossJoin(F.broadcast(two))  # one row each
