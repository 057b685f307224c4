"""Conversation-aware queries, and what is put around an answer: context, images, tables, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import text as T

IMAGE_INTENT = "图|图纸|大样|示意图|标注|尺寸图|附图"
RULE = r"\|[-:\s]+\|"
SYSTEM = "You answer from the given passages only."


def in_order(item: Column) -> Column:
    return F.array_sort(F.collect_list(item))


def followup_enrich(turns: DataFrame) -> DataFrame:
    """conv_id, turn, query, enriched_query for each user turn.

    A short fragment (under 8 characters, and with fewer than three content tokens or none that is new) gets
    the tokens of the user's turn before, or that whole turn if it has none to add.
    """
    users = turns.where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("query"))
    users = users.withColumn("last", F.lag("query").over(W.partitionBy("conv_id").orderBy("turn")))
    both = users.withColumn("now", T.content_tokens(F.col("query"))).withColumn("before", T.content_tokens(F.coalesce("last", F.lit(""))))
    fragment = ((F.size("now") < 3) | (F.size(F.array_except("now", "before")) == 0)) & (F.length("query") < 8)
    missing = F.array_except("before", "now")
    added = F.when(F.size(missing) > 0, F.concat("query", F.lit(" "), F.array_join(missing, " "))).otherwise(F.concat("last", F.lit(" "), "query"))
    enriched = F.when(fragment & (F.coalesce("last", F.lit("")) != ""), added).otherwise(F.col("query"))
    return both.select("conv_id", "turn", "query", enriched.alias("enriched_query"))


def history_window(turns: DataFrame, n: int = 20) -> DataFrame:
    """turns with history, the n messages before each."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(before))


def clean_context(content: Column) -> Column:
    return T.images_to_placeholder(T.strip_strikethrough(T.strip_tables(content)))


def build_context(hits: DataFrame, n: int = 5) -> DataFrame:
    """query_id, context: the first n hits without tables, each under a header that names its source."""
    place, section, source, kind = F.col("rank").cast("string"), F.coalesce("section_path", F.lit("")), F.coalesce("source_file", F.lit("")), F.coalesce("content_type", F.lit(""))
    block = F.concat(F.lit("【模块"), place, F.lit("】章节: "), section, F.lit(" | 来源: "), source, F.lit(" | 类型: "), kind)
    plain = F.concat(F.lit("[片段"), place, F.lit("] 来源: "), source, F.lit(" | 章节: "), section, F.lit(" | 类型: "), kind)
    header = F.when(F.col("split_strategy") == "BRACKET", block).otherwise(plain)
    part = F.struct("rank", F.concat(header, F.lit("\n"), clean_context(F.col("content"))).alias("text"))
    parts = hits.where(F.col("rank") <= n).groupBy("query_id").agg(in_order(part).alias("parts"))
    return parts.select("query_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n---\n\n").alias("context"))


def build_messages(questions: DataFrame, system: str = SYSTEM) -> DataFrame:
    """questions (query_id, query, context, history) with messages: system, history, then the question with its context."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    asked = F.concat(F.lit("参考以下知识库内容回答问题。\n\n--- 知识库内容 ---\n"), F.coalesce("context", F.lit("")), F.lit("\n--- 结束 ---\n\n问题："), "query")
    history = F.coalesce("history", F.array().cast("array<struct<role:string,text:string>>"))
    return questions.withColumn("messages", F.concat(F.array(message("system", F.lit(system))), history, F.array(message("user", asked))))


def holds_any(content: Column, tokens: Column) -> Column:
    return F.exists(tokens, lambda t: content.contains(t))


def gate(hits: DataFrame, min_answer: int = 5) -> Column:
    """A hit must share a token with its query and, if the answer is rich enough, one with the answer."""
    asked = T.content_tokens(F.col("query"))
    answer = T.content_tokens(F.coalesce("answer", F.lit(""))) if "answer" in hits.columns else F.array().cast("array<string>")
    return ((F.size(asked) == 0) | holds_any(F.col("content"), asked)) & ((F.size(answer) < min_answer) | holds_any(F.col("content"), answer))


def source_images(hits: DataFrame, max_total: int = 8) -> DataFrame:
    """query_id, place, path, relevance, url: images of gated hits, direct ones first, each path once.

    hits: query_id, query, rank, relevance, content, image_ids, category, and answer if there is one.
    """
    direct = F.when(F.col("relevance") == "direct", 0).otherwise(1)
    rows = hits.where(gate(hits)).select("query_id", "rank", "relevance", "category", direct.alias("group"), F.posexplode("image_ids").alias("pos", "path"))
    order = ["group", "rank", "pos"]
    once = rows.withColumn("n", F.row_number().over(W.partitionBy("query_id", "path").orderBy(*order))).where("n = 1")
    placed = once.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= max_total)
    url = F.concat(F.lit("![附图](/api/images/"), T.quote_path(F.col("category")), F.lit("/"), T.quote_path(F.col("path")), F.lit(")"))
    return placed.select("query_id", "place", "path", "relevance", url.alias("url"))


def image_intent(hits: DataFrame, words: str = IMAGE_INTENT, n: int = 2) -> DataFrame:
    """The first n images for the queries that speak of drawings."""
    return source_images(hits.where(F.col("query").rlike(words)), n)


def source_tables(hits: DataFrame, n_hits: int = 5, per_group: int = 2, min_chars: int = 20) -> DataFrame:
    """query_id, relevance, place, table_text, score: the best tables in the first hits of each query.

    hits: query_id, query, rank, relevance, relevance_score, content. A table is a run of lines with pipes, one
    of which begins with a rule row. Direct tables go by the hit's score, indirect ones need two query tokens.
    """
    tokens = T.content_tokens(F.col("query"))
    near = hits.where((F.col("rank") <= n_hits) & F.col("content").rlike(RULE)).withColumn("tokens", tokens)
    near = near.where((F.size("tokens") == 0) | holds_any(F.col("content"), F.col("tokens")))
    about = ["query_id", "rank", "relevance", "relevance_score", "tokens"]
    lines = near.select(*about, F.posexplode(T.lines(F.col("content"))).alias("no", "line")).where(F.col("line").contains("|"))
    island = F.col("no") - F.row_number().over(W.partitionBy("query_id", "rank").orderBy("no"))
    tables = lines.withColumn("island", island).groupBy(*about, "island").agg(
        F.bool_or(F.col("line").rlike(f"^{RULE}")).alias("ruled"), F.min("no").alias("no"), T.py_strip(F.array_join(F.transform(in_order(F.struct("no", "line")), lambda s: s["line"]), "\n")).alias("table_text")
    )
    found = F.size(F.filter("tokens", lambda t: F.col("table_text").contains(t)))
    direct = F.col("relevance") == "direct"
    score = F.when(direct, F.col("relevance_score") * 10 + found * 0.01).otherwise(found + F.col("relevance_score"))
    good = tables.where("ruled").where(F.length("table_text") >= min_chars).where((direct & (F.col("relevance_score") > 0)) | (~direct & (found >= 2)))
    scored = good.withColumn("score", F.round(score, 6))
    once = scored.withColumn("n", F.row_number().over(W.partitionBy("query_id", "relevance", "table_text").orderBy(F.desc("score"), "rank", "no"))).where("n = 1")
    place = F.row_number().over(W.partitionBy("query_id", "relevance").orderBy(F.desc("score"), "rank", "no"))
    return once.withColumn("place", place).where(F.col("place") <= per_group).select("query_id", "relevance", "place", "table_text", "score")


#: Headings of the four groups of media, in order.
MEDIA = (("image", "direct", "### 直接参考图片\n", "\n"), ("table", "direct", "### 直接参考表格\n\n", "\n\n"), ("image", "indirect", "### 拓展参考图片\n", "\n"), ("table", "indirect", "### 拓展参考表格\n\n", "\n\n"))


def _media_part(kind: str, relevance: str, heading: str, separator: str) -> Column:
    own = F.transform(F.filter("all", lambda x: (x["kind"] == kind) & (x["relevance"] == relevance)), lambda x: x["item"])
    return F.when(F.size(own) > 0, F.concat(F.lit(heading), F.array_join(own, separator)))


def media_sections(images: DataFrame, tables: DataFrame) -> DataFrame:
    """query_id, media: images and tables under their headings, direct ones first; queries without any have no row."""
    items = images.select("query_id", F.lit("image").alias("kind"), "relevance", "place", F.col("url").alias("item"))
    items = items.unionByName(tables.select("query_id", F.lit("table").alias("kind"), "relevance", "place", F.col("table_text").alias("item")))
    grouped = items.groupBy("query_id").agg(in_order(F.struct("place", "item", "kind", "relevance")).alias("all"))
    parts = [_media_part(*m) for m in MEDIA]
    return grouped.select("query_id", F.concat(F.lit("\n\n---\n"), F.concat_ws("\n\n", *parts)).alias("media"))


def source_list(hits: DataFrame, n: int = 4) -> DataFrame:
    """query_id, place, source_file, chunk_index, relevance: a citation per file, its last hit at its first place, direct first."""
    of_file = hits.groupBy("query_id", "source_file").agg(F.min("rank").alias("first"), F.max_by(F.struct("chunk_index", "relevance"), F.col("rank")).alias("c"))
    order = [F.when(F.col("c.relevance") == "direct", 0).otherwise(1), F.col("first")]
    placed = of_file.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= n)
    return placed.select("query_id", "place", "source_file", "c.chunk_index", "c.relevance")
