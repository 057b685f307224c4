"""Data-quality checks over chunks and indexes, one row per check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import retrieve
from corpusloom.operators.index import LexicalIndex

RULE = r"\|[-:\s]+\|"
SCHEMA = "name string, passed boolean, level string, value double"


def _share(condition: Column) -> Column:
    return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))


def chunk_checks(chunks: DataFrame) -> DataFrame:
    """The five checks that look at chunks alone, from one pass over them."""
    body, section = T.py_strip(F.coalesce("content", F.lit(""))), F.coalesce("section_path", F.lit(""))
    rest = T.py_strip(F.array_join(F.filter(T.lines(F.coalesce("content", F.lit(""))), lambda x: ~T.py_strip(x).startswith("|")), "\n"))
    bare_table = F.col("content_type").isin(T.MAIN_TABLE, T.SUB_TABLE) & F.col("content").rlike(RULE) & (F.length(rest) < 20)
    sums = chunks.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(body == "").alias("empty"), _share(T.py_strip(section) != "").alias("sections"), F.count_if(bare_table).alias("bare"),
        F.countDistinct(F.coalesce("source_file", F.lit(""))).alias("files"), _share(section.contains(">")).alias("deep"),
    )
    n = F.col("n")
    checks = [
        ("chunk_count", (n > 0) & (F.col("empty") <= n * F.lit(0.1)), "ERROR", n),
        ("section_paths", (n > 0) & (F.col("sections") >= 0.7), "WARN", F.round("sections", 6)),
        ("table_chunks", F.col("bare") == 0, "WARN", F.col("bare")),
        ("file_diversity", F.col("files") >= 2, "WARN", F.col("files")),
        ("hierarchy_depth", n > 0, "INFO", F.round("deep", 6)),
    ]
    return _rows(sums, checks)


def _rows(sums: DataFrame, checks: list[tuple[str, Column, str, Column]]) -> DataFrame:
    row = lambda name, passed, level, value: F.struct(F.lit(name).alias("name"), passed.alias("passed"), F.lit(level).alias("level"), value.cast("double").alias("value"))
    return sums.select(F.explode(F.array(*[row(*c) for c in checks])).alias("c")).select("c.*")


def vector_check(vectors: DataFrame, dim: int) -> DataFrame:
    """All vectors have the expected length."""
    size = F.size("embedding")
    sums = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most"))
    good = F.coalesce((F.col("least") == dim) & (F.col("most") == dim), F.lit(False))
    return _rows(sums, [("embedding_dims", good, "ERROR", F.col("most"))])


def lexical_check(stats: DataFrame) -> DataFrame:
    """The lexical index has tokens. stats: chunk_index, dl."""
    sums = stats.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))
    return _rows(sums, [("bm25_index", F.col("tokens") > 0, "ERROR", F.col("tokens"))])


def self_retrieval(chunks: DataFrame, index: LexicalIndex, n: int = 3, terms: int = 5) -> DataFrame:
    """query_id, best: for n sampled chunks, the chunk found first by their first tokens. The sample goes by hash of id."""
    sample = chunks.where(T.py_strip(F.coalesce("content", F.lit(""))) != "").orderBy(F.md5(F.col("chunk_index").cast("string")), "chunk_index").limit(n)
    words = F.slice(F.filter(T.tokenize(F.col("content")), lambda x: F.length(x) >= 2), 1, terms)
    query = F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.substring("content", 1, 20))
    asked = sample.select(F.col("chunk_index").alias("query_id"), query.alias("query"))
    found = retrieve.bm25_topk(asked, index, 1, stop=[])
    return asked.join(found, "query_id", "left").select("query_id", F.col("chunk_index").alias("best"))


def retrievability_check(chunks: DataFrame, index: LexicalIndex, n: int = 3, hits: int = 2) -> DataFrame:
    found = self_retrieval(chunks, index, n).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("query_id") == F.col("best")).alias("hits"))
    return _rows(found, [("retrievability", (F.col("n") >= n) & (F.col("hits") >= hits), "ERROR", F.col("hits"))])


def run_audit(chunks: DataFrame, index: LexicalIndex, stats: DataFrame, vectors: DataFrame, dim: int = 1024) -> DataFrame:
    """name, passed, level, value of all eight checks."""
    parts = [retrievability_check(chunks, index), vector_check(vectors, dim), lexical_check(stats)]
    out = chunk_checks(chunks)
    for p in parts:
        out = out.unionByName(p)
    return out


def report(checks: DataFrame) -> DataFrame:
    """passed: whether no check of level ERROR fails; n_failed: how many checks do."""
    return checks.agg(F.bool_and(F.col("passed") | (F.col("level") != "ERROR")).alias("passed"), F.count_if(~F.col("passed")).alias("n_failed"))
