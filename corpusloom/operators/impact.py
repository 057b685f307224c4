"""Lexical top-k by bounds: postings in blocks with their largest impact, and a threshold below which neither terms nor blocks are read.

The impact of a posting is what it adds to a score for each unit of a query term's weight. A block holds postings of one term with nearly the same impact, some
BLOCK_ROWS of them. The search is exact, in four steps:

1. The blocks that can add most to each query are scored alone, and the k best chunks of these in full: the k-th score is a threshold.
2. Of each query's terms in rising order of what they can add at most, those that together stay below the threshold are weak: no chunk that holds only
   them can be among the best. The others are strong.
3. Of the strong terms' blocks those are opened that reach the threshold with all that the other terms can add. A chunk in any other block is
   out. Chunks whose sum does not reach the threshold with all weak terms are out, too.
4. What is left is looked up in the weak terms' postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import text as T
from corpusloom.operators.index import B, K1, LexicalIndex, Tokenizer
from corpusloom.operators.retrieve import broadcast_if_small, top
from corpusloom.sources.tables import checkpointed

BLOCK_ROWS, LEVELS = 512, 8  # levels of impact for each unit of it, which is below K1 + 1
SLACK = 2e-6  # scores have six places


@dataclass(frozen=True)
class ImpactIndex:
    """blocks(term, level, shard, n, most, entries(chunk_index, impact)) and terms(term, df, idf, most)."""

    blocks: DataFrame
    terms: DataFrame


def impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def impact_blocks(index: LexicalIndex, block_rows: int = BLOCK_ROWS) -> ImpactIndex:
    """The postings of an index in blocks. Those of one term and level are dealt to as many blocks as they fill."""
    weighed = index.postings.crossJoin(F.broadcast(index.corpus.select("avgdl")))  # one row
    rows = weighed.select("term", "chunk_index", impact(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("impact")).withColumn("level", F.floor(F.col("impact") * LEVELS))
    rows = checkpointed(rows)  # read twice
    sizes = rows.groupBy("term", "level").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    dealt = rows.join(sizes, ["term", "level"]).withColumn("shard", F.pmod(F.xxhash64("chunk_index"), F.col("blocks")))
    made = dealt.groupBy("term", "level", "shard").agg(F.max("impact").alias("most"), F.collect_list(F.struct("chunk_index", "impact")).alias("entries"))
    blocks = checkpointed(made.select("term", "level", "shard", F.size("entries").alias("n"), "most", "entries"))
    most = blocks.groupBy("term").agg(F.max("most").alias("most"))
    return ImpactIndex(blocks, index.terms.join(most, "term"))


def _opened(blocks: DataFrame, *keep: str) -> DataFrame:
    return blocks.select("term", *keep, F.explode("entries").alias("e")).select("term", *keep, "e.*")


def bounded_bm25(
    queries: DataFrame, index: ImpactIndex, k: int, stop: list[str] = T.QUERY_STOP_WORDS, tokenize: Tokenizer = T.tokenize, seeds: int = 10
) -> tuple[DataFrame, DataFrame]:
    """The same as retrieve.bm25_topk (query_id, rank, chunk_index, score), and what it took: query_id, n_postings of its terms and n_scored.

    The first step takes the strongest blocks until they have ``seeds`` times k postings. Queries of few words, as people type them, gain most: in long ones the weak terms
    together reach any threshold.
    """
    words = queries.select("query_id", F.explode(tokenize(F.coalesce("query", F.lit("")))).alias("term")).where(~F.col("term").isin(stop))
    words = words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).join(index.terms, "term")
    weight = F.col("times") * F.col("idf")
    of_query = W.partitionBy("query_id")
    rising = of_query.orderBy("bound", "term").rowsBetween(W.unboundedPreceding, 0)
    asked = words.select("query_id", "term", "df", weight.alias("weight"), (F.greatest(weight, F.lit(0.0)) * F.col("most")).alias("bound"))
    asked = asked.withColumns({"all": F.sum("bound").over(of_query), "up_to": F.sum("bound").over(rising)})
    asked = checkpointed(asked)

    def sums(opened: DataFrame) -> DataFrame:
        return opened.groupBy("query_id", "chunk_index").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"), F.count(F.lit(1)).alias("n"))

    def looked_up(pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """Sums over the given terms (query_id, term, weight) for the given chunks (query_id, chunk_index). A term is opened once for all queries."""
        wanted = pairs.select("query_id", "chunk_index").join(terms.select("query_id", "term", "weight"), "query_id")
        postings = _opened(index.blocks.join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi"))
        return sums(postings.join(broadcast_if_small(wanted), ["term", "chunk_index"]))

    best_first = of_query.orderBy(F.desc(F.col("weight") * F.col("most")), "term", "level", "shard").rowsBetween(W.unboundedPreceding, -1)
    offered = index.blocks.select("term", "level", "shard", "n", "most").join(broadcast_if_small(asked.select("query_id", "term", "weight")), "term")
    taken = offered.withColumn("before", F.coalesce(F.sum("n").over(best_first), F.lit(0))).where(F.col("before") < seeds * k)
    opened = index.blocks.join(broadcast_if_small(taken.select("query_id", "weight", "term", "level", "shard")), ["term", "level", "shard"])
    first = checkpointed(sums(_opened(opened, "query_id", "weight")))
    leaders = checkpointed(top(first, ["query_id"], [F.desc("score"), F.asc("chunk_index")], k))
    known = checkpointed(looked_up(leaders, asked))
    reached = known.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score") - SLACK).otherwise(F.lit(-1e300)).alias("threshold"))
    judged = checkpointed(asked.join(reached, "query_id").withColumn("weak", F.col("up_to") < F.col("threshold")))
    strong = judged.where("NOT weak").select("query_id", "term", "weight", (F.col("all") - F.col("bound")).alias("others"), "threshold")
    near = index.blocks.join(broadcast_if_small(strong), "term").where(F.col("weight") * F.col("most") + F.col("others") >= F.col("threshold"))
    part = sums(_opened(near, "query_id", "weight"))
    weak = judged.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("weak"), F.col("bound"))), F.lit(0.0)).alias("more"), F.first("threshold").alias("threshold"))
    part = checkpointed(part.join(broadcast_if_small(weak), "query_id"))
    left = part.where(F.col("score") + F.col("more") >= F.col("threshold")).select("query_id", "chunk_index", "score", "n")
    rest = looked_up(left, judged.where("weak"))
    both = checkpointed(left.join(rest.withColumnsRenamed({"score": "rest", "n": "n_rest"}), ["query_id", "chunk_index"], "left"))
    scored = both.select("query_id", "chunk_index", F.round(F.col("score") + F.coalesce("rest", F.lit(0.0)), 6).alias("score"))
    best = top(scored, ["query_id"], [F.desc("score"), F.asc("chunk_index")], k).select("query_id", "rank", "chunk_index", "score")
    steps = [first.groupBy("query_id").agg(F.sum("n").alias("n")), known.groupBy("query_id").agg(F.sum("n").alias("n")), part.groupBy("query_id").agg(F.sum("n").alias("n"))]
    steps.append(both.groupBy("query_id").agg(F.coalesce(F.sum("n_rest"), F.lit(0)).alias("n")))
    spent = steps[0].unionByName(steps[1]).unionByName(steps[2]).unionByName(steps[3]).groupBy("query_id").agg(F.sum("n").alias("n_scored"))
    return best, asked.groupBy("query_id").agg(F.sum("df").alias("n_postings")).join(spent, "query_id", "left")
