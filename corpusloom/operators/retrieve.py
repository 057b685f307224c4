"""Batch hybrid retrieval: queries against lexical and vector indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import text as T
from corpusloom.operators.index import B, K1, LexicalIndex, Tokenizer
from corpusloom.operators.match import contained
from corpusloom.operators.vectors import flat_topk
from corpusloom.sources.tables import checkpointed

RRF_K, VECTOR_WEIGHT, BM25_WEIGHT = 20, 0.3, 0.7
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows; else the planner joins it by shuffling."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark drops the rest before and after the exchange."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def expand_queries(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """queries with every canonical term appended whose alias the query holds and which it does not hold itself."""
    words = synonyms.select(F.explode(F.array("alias", "canonical")).alias("word"))
    hits = checkpointed(contained(queries.select("query_id", "query").distinct(), "query_id", "query", words, "word").distinct())
    named = hits.join(synonyms, F.col("pattern") == F.col("alias")).select("query_id", "ord", "canonical")
    found = named.join(hits.withColumnRenamed("pattern", "canonical"), ["query_id", "canonical"], "left_anti").groupBy("query_id")
    added = found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "canonical"))), lambda s: s["canonical"]), " ").alias("added"))
    out = queries.join(added, "query_id", "left")
    return out.withColumn("query", F.concat("query", F.when(F.col("added").isNotNull(), F.concat(F.lit(" "), "added")).otherwise(""))).drop("added")


def allowed(chunk_value: Column, wanted: Column) -> Column:
    """Membership in a list; a null list allows everything."""
    return wanted.isNull() | F.array_contains(wanted, chunk_value)


def metadata_filter(chunks: DataFrame, categories: list[str] | None = None, content_types: list[str] | None = None) -> DataFrame:
    if categories is not None:
        chunks = chunks.where(F.col("category").isin(categories))
    return chunks if content_types is None else chunks.where(F.col("content_type").isin(content_types))


def filter_of(queries: DataFrame) -> DataFrame:
    """query_id, categories and content_types; null where the queries have no such column."""
    lists = [F.col(c) if c in queries.columns else F.lit(None).cast("array<string>").alias(c) for c in ("categories", "content_types")]
    return queries.select("query_id", *lists)


def permitted(scored: DataFrame, queries: DataFrame, chunks: DataFrame | None) -> DataFrame:
    """The rows of scored (query_id, chunk_index, ...) that their query's own lists of categories and content types allow."""
    if chunks is None or not {"categories", "content_types"} & set(queries.columns):
        return scored
    kinds = chunks.select("chunk_index", "category", "content_type").hint("shuffle_hash")  # scores lie by chunk already, and need not be sorted
    about = scored.join(kinds, "chunk_index").join(broadcast_if_small(filter_of(queries)), "query_id")
    good = allowed(F.col("category"), F.col("categories")) & allowed(F.col("content_type"), F.col("content_types"))
    return about.where(good).select(*scored.columns)


def bm25_topk(
    queries: DataFrame, index: LexicalIndex, k: int, stop: list[str] = T.QUERY_STOP_WORDS, allowed_chunks: DataFrame | None = None, chunks: DataFrame | None = None,
    tokenize: Tokenizer = T.tokenize, pad_zero: DataFrame | None = None,
) -> DataFrame:
    """query_id, rank, chunk_index, score (6 places) of the k best chunks of each query; ties go to the smaller index.

    The terms of the queries, few and weighed beforehand, are sent to the postings, which stay where they are. Where postings lie by chunk, as those of
    build_bm25 do, each task sums up its chunks and keeps the k best of each query; else partial sums by query and chunk are exchanged first. ``allowed_chunks`` restricts all queries before the top k, and
    with ``chunks`` each query's own lists (categories, content_types) do. With ``pad_zero``, the chunks with what filters need, a query
    that fewer than k chunks match is filled up with the smallest other numbers that it allows, at score 0.
    """
    words = queries.select("query_id", F.explode(tokenize(F.coalesce("query", F.lit("")))).alias("term")).where(~F.col("term").isin(stop))
    words = words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    weighed = checkpointed(words.join(index.terms.select("term", "idf"), "term").crossJoin(F.broadcast(index.corpus.select("avgdl"))))  # one row
    asked = index.postings.join(broadcast_if_small(weighed.select("term").distinct()), "term", "left_semi")  # Spark takes this before tokens are counted
    found = asked.join(broadcast_if_small(weighed), "term")
    if allowed_chunks is not None:
        found = found.join(allowed_chunks.select("chunk_index"), "chunk_index", "left_semi")
    tf = F.col("tf")
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = permitted(found.groupBy("query_id", "chunk_index").agg(F.round(F.sum(part), 6).alias("score")), queries, chunks)
    best = top(scored, ["query_id"], [F.desc("score"), F.asc("chunk_index")], k)
    if pad_zero is not None:
        best = checkpointed(best)
        kinds = [c for c in ("category", "content_type") if c in pad_zero.columns]
        least = top(pad_zero, kinds, [F.asc("chunk_index")], k) if kinds else pad_zero.orderBy("chunk_index").limit(k)  # k rows for each kind of chunk
        fillers = queries.select("query_id").join(broadcast_if_small(least.select("chunk_index")), F.lit(True)).join(best, ["query_id", "chunk_index"], "left_anti")
        fillers = permitted(fillers.withColumn("score", F.lit(0.0)), queries, chunks)
        both = best.select("query_id", "chunk_index", "score").unionByName(fillers)
        matched = F.col("score") != 0
        best = top(both, ["query_id"], [F.desc(matched), F.desc("score"), F.asc("chunk_index")], k)
    return best.select("query_id", "rank", "chunk_index", "score")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, chunks: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """query_id, rank, chunk_index, score (cosine, 6 places) of the k nearest vectors of each query, exactly.

    Vectors are dealt to parts once and queries sent to each, so neither side grows in a task, and nothing passes through the driver. With ``chunks`` each
    query's own lists (categories, content_types) restrict before the top k. Null vectors and those of another length are left out. Many searches over the same
    vectors go through a layout: see operators/vectors.py.
    """
    about = vectors.select("chunk_index", "embedding")
    if chunks is not None and {"categories", "content_types"} & set(queries.columns):
        about = about.join(chunks.select("chunk_index", "category", "content_type"), "chunk_index")
    return flat_topk(queries, about, k, parts)


def rrf_fuse(vector: DataFrame, bm25: DataFrame, keep: int, k: int = RRF_K, weights: tuple[float, float] = (VECTOR_WEIGHT, BM25_WEIGHT)) -> DataFrame:
    """query_id, chunk_index, score, fused_rank: the sum of weight / (k + rank) over the lists a chunk is in.

    Scores are rounded to 9 places before ranking; ties go by vector rank, then by lexical rank.
    """
    lists = [df.select("query_id", "chunk_index", "rank", F.lit(w).alias("weight"), F.lit(n).alias("list")) for n, df, w in ((0, vector, weights[0]), (1, bm25, weights[1]))]
    both = lists[0].unionByName(lists[1])
    rank_in = lambda n: F.min(F.when(F.col("list") == n, F.col("rank"))).alias(f"r{n}")
    fused = both.groupBy("query_id", "chunk_index").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"), rank_in(0), rank_in(1))
    order = [F.desc("score"), F.asc_nulls_last("r0"), F.asc_nulls_last("r1"), F.asc("chunk_index")]
    return top(fused, ["query_id"], order, keep, "fused_rank").select("query_id", "chunk_index", "score", "fused_rank")


def file_diversity(fused: DataFrame, top_k: int, max_files: int = 5, per_file: int = 2) -> DataFrame:
    """The best chunks from the max_files best files, at most per_file of each. fused carries source_file."""
    of_file, of_query = W.partitionBy("query_id", "source_file"), W.partitionBy("query_id")
    ranked = fused.withColumn("best", F.min("fused_rank").over(of_file)).withColumn("n", F.row_number().over(of_file.orderBy("fused_rank")))
    ranked = ranked.withColumn("file_rank", F.dense_rank().over(of_query.orderBy("best"))).where(f"file_rank <= {max_files} AND n <= {per_file}")
    return top(ranked, ["query_id"], [F.asc("fused_rank")], top_k).drop("best", "n", "file_rank")


def overlap_score(query: Column, text: Column) -> Column:
    """Share of common tokens, a stand-in for a model that scores pairs."""
    a, b = F.array_distinct(T.tokenize(query)), F.array_distinct(T.tokenize(text))
    return F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 6)


def rerank(hits: DataFrame, top_k: int, scorer=overlap_score, candidates: int = 15) -> DataFrame:
    """hits (query_id, query, rank, content, ...) by ``scorer(query, first 500 characters)``, top_k of each query.

    Queries with three hits or fewer keep their order; only the first ``candidates`` are scored.
    """
    n = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    scored = hits.where(F.col("rank") <= candidates).withColumn("n", n)
    scored = scored.withColumn("rerank_score", F.when(F.col("n") > 3, scorer(F.col("query"), F.substring("content", 1, 500))))
    best = top(scored, ["query_id"], [F.desc_nulls_last("rerank_score"), F.asc("rank")], top_k, "new_rank")
    return best.drop("rank", "n").withColumnRenamed("new_rank", "rank")


def label_relevance(hits: DataFrame) -> DataFrame:
    """hits with relevance_score (6 places), rank by it, and relevance: direct from 90 % of the best score on."""
    scored = hits.withColumn("relevance_score", F.round("score", 6))
    best = F.max("relevance_score").over(W.partitionBy("query_id"))
    scored = scored.withColumn("relevance", F.when(F.col("relevance_score") >= best * 0.9, "direct").otherwise("indirect"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance_score"), F.asc("fused_rank"))))


def filename_boost(queries: DataFrame, files: DataFrame, most: float = 20.0, stop: list[str] = T.QUERY_STOP_WORDS) -> DataFrame:
    """query_id, source_file, boost = 1 + share of query keywords in the file name * (most - 1), matches only."""
    words = F.filter(T.tokenize(F.col("query")), lambda x: (F.length(x) >= 2) & ~x.isin(stop))
    asked = queries.select("query_id", words.alias("words")).where(F.size("words") > 0)
    names = files.select("source_file").distinct().where("source_file != ''")
    names = checkpointed(names.withColumn("name_id", F.monotonically_increasing_id()))  # numbers that stay; hits carry these, not names
    single = asked.select("query_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    held = contained(names.withColumn("name", F.replace("source_file", F.lit(".md"), F.lit(""))), "name_id", "name", single, "word")
    # a name's words travel together, and are met with the queries, counted and named where they arrive
    lists = held.groupBy("name_id").agg(F.collect_list("pattern").alias("words")).select("name_id", F.explode("words").alias("word"))
    hits = lists.join(broadcast_if_small(single), "word").groupBy("query_id", "name_id", "n").agg(F.count(F.lit(1)).alias("found"))
    boost = F.round(1 + F.col("found") / F.col("n") * (most - 1), 6)
    return hits.select("query_id", "name_id", boost.alias("boost")).join(names, "name_id").select("query_id", "source_file", "boost")


def only(chunks: DataFrame, hits: DataFrame, most: int = 10_000) -> DataFrame:
    """The chunks that hits name, for a join with these. At most ``most`` numbers are named in a filter, which Spark takes before it works out the
    other columns of chunks; of more hits, all chunks are left to the join."""
    found = [x[0] for x in hits.select("chunk_index").distinct().limit(most + 1).collect()]
    return chunks.where(F.col("chunk_index").isin(found)) if len(found) <= most else chunks


def retrieve(
    queries: DataFrame, chunks: DataFrame, index: LexicalIndex, vectors: DataFrame, top_k: int = 10, rank_by: str = "rrf", synonyms: DataFrame | None = None,
    tokenize: Tokenizer = T.tokenize,
) -> DataFrame:
    """The whole retrieval: expansion by synonyms if there are any, both legs to 5 * top_k under each query's own filters,
    fusion to 4 * top_k, file diversity, reranking, labels, chunk columns.

    Diverse hits are reranked where a query has more than three. Labels then order them by fused score, so that a rerank
    shows in rerank_score only; with ``rank_by="rerank"`` it decides the order.
    """
    pool = 5 * top_k
    expanded = queries if synonyms is None else expand_queries(queries, synonyms)
    kinds = ["category", "content_type"] if {"categories", "content_types"} & set(queries.columns) else []
    about = checkpointed(chunks.select("chunk_index", "source_file", *kinds))  # what filters and diversity ask for, worked out once
    fused = rrf_fuse(vector_topk(expanded, vectors, pool, about), bm25_topk(expanded, index, pool, chunks=about, tokenize=tokenize), 4 * top_k)
    diverse = checkpointed(file_diversity(fused.join(about.select("chunk_index", "source_file"), "chunk_index"), top_k).drop("source_file"))
    whole = only(chunks, diverse).join(broadcast_if_small(diverse), "chunk_index").join(expanded.select("query_id", "query"), "query_id")  # the only join with texts
    labelled = label_relevance(rerank(whole, top_k).drop("query").withColumnRenamed("rank", "reranked"))
    if rank_by == "rerank":
        labelled = labelled.withColumn("rank", F.col("reranked"))
    return labelled.select("query_id", "rank", "chunk_index", "relevance_score", "relevance", "rerank_score", *[c for c in chunks.columns if c != "chunk_index"])


def citations(hits: DataFrame, excerpt: int = 200) -> DataFrame:
    keep = ["query_id", "rank", "source_file", "section_path", "content_type", "relevance_score", "category", "has_image", "image_ids", "relevance", "split_strategy"]
    return hits.select(*keep, F.substring("content", 1, excerpt).alias("excerpt"))
