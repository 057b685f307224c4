"""All queries of the library by name; each runs its operator over whole tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import helpers
from corpusloom.functions import text as T
from corpusloom.jobs import corpus
from corpusloom.operators import answer, audit, chunk, impact, index, inline, parse, retrieve, vectors
from corpusloom.sources import tables
from corpusloom.streaming import ingest

TOP_K = 10
RULES = [("the", "THE"), ("then", "AFTER"), ("AFTER", "later"), ("der", "DER")]
SYNONYMS = [(1, "ention", "mention"), (2, "ation", "action"), (3, "der", "die"), (4, "the", "that")]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


PLACES = ("rank", "fused_rank", "place", "seq")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query; places in an order come out as long, whatever the window made them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*[F.col(c).cast("long").alias(c) if c in PLACES else F.col(c) for c in df.columns])

    QUERIES[f.__name__] = run
    return f


# ---- parsing


@query
def route_manifest(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages")
    name = F.concat(F.lit("p"), "page_id", F.element_at(F.array(*[F.lit(x) for x in (".docx", ".pdf", ".xyz", ".txt", ".xlsx", ".doc")]), (F.col("page_id") % 6 + 1).cast("int")))
    files = pages.select("page_id", name.alias("filename"), F.when(F.col("page_id") % 4 == 0, " ").otherwise(F.col("html")).alias("content"))
    files = files.withColumn("ext", F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    return parse.route_manifest(files).select("page_id", "filename", "ext", "parser", "status", "char_count")


@query
def rows_to_markdown(spark, sf_dir):
    return parse.rows_to_markdown(corpus.sheet_rows(spark, sf_dir))


@query
def elements_to_markdown(spark, sf_dir):
    pages = corpus.markdown_pages(spark, sf_dir)
    lines = pages.select("doc_id", F.posexplode(F.split("content", "\n")).alias("seq", "line"))
    runs = F.transform(F.split("line", " "), lambda w, i: F.struct(F.concat(w, F.lit(" ")).alias("text"), (i % 3 == 1).alias("bold"), (i % 2 == 1).alias("italic")))
    rows = F.array(F.split("line", " "), F.array("line"))
    elements = lines.select(
        "doc_id", "seq", F.when(F.col("seq") % 7 == 3, "table").otherwise("para").alias("kind"), F.when(F.col("line").startswith("##"), "Heading 9").alias("style"),
        F.when(F.col("seq") % 5 == 0, 1).alias("outline_level"), runs.alias("runs"), rows.alias("rows"),
    )
    return parse.elements_to_markdown(elements)


@query
def describe_files(spark, sf_dir):
    """The pages as files of a drop folder, some of a kind that is not admitted, some with a stored prefix."""
    pages = corpus.table(spark, sf_dir, "pages")
    ext = F.get(F.array(*[F.lit(x) for x in (".txt", ".pdf", ".doc", ".md", ".exe")]), (F.col("page_id") % 5).cast("int"))
    prefix = F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), F.lit("_")))
    path = F.concat(F.lit("file:/drop/"), prefix, F.lit("f"), "page_id", ext)
    files = pages.select("page_id", path.alias("path"), F.octet_length("html").cast("long").alias("length"))
    return parse.describe_files(files).select("page_id", F.col("original").alias("stem_ext"), "ext", "filename", "length")


@query
def media_inventory(spark, sf_dir):
    """The pages as containers with one to four images, and in every second a clashing name in another folder."""

    @F.pandas_udf("binary")
    def container(ids: pd.Series) -> pd.Series:
        def one(k: int) -> bytes:
            box = io.BytesIO()
            with zipfile.ZipFile(box, "w") as z:
                z.writestr("word/document.xml", "<w/>")
                for i in range(k % 4 + 1):
                    z.writestr(f"word/media/i{i}.png", b"x" * (100 * i + k % 50))
                if k % 2 == 0:
                    z.writestr("ppt/media/i0.png", b"y" * 7)
            return box.getvalue()

        return ids.map(one)

    pages = corpus.table(spark, sf_dir, "pages")
    return parse.media_inventory(pages.select(F.concat(F.lit("f"), "page_id").alias("filename"), container("page_id").alias("content")))


@query
def parse_text(spark, sf_dir):
    files = corpus.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), "page_id").alias("stem"), F.col("html").cast("binary").alias("content"))
    return parse.parse_text(files).select("page_id", F.md5("content").alias("content_md5"), "char_count")


@query
def caption_candidates(spark, sf_dir):
    items = corpus.table(spark, sf_dir, "lineitem")
    media = items.select(
        F.col("l_orderkey").alias("file"), F.concat(F.lit("image"), F.col("l_linenumber")).alias("filename"), F.floor("l_extendedprice").alias("size"),
        F.when(F.col("l_linenumber") % 4 == 0, ".emf").otherwise(".png").alias("ext"), (F.col("l_quantity") > 45).alias("is_page_render"),
    )
    return parse.caption_candidates(media)


def order_media(spark, sf_dir):
    """Orders as files, and their items as the images there."""
    ext = F.when(F.col("o_orderkey") % 3 == 0, ".docx").otherwise(".pdf")
    files = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), ext.alias("file_ext"), F.repeat("o_orderpriority", (F.col("o_orderkey") % 20).cast("int")).alias("text"))
    size = (F.floor("l_extendedprice") % 3000).alias("size")
    items = corpus.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), "l_linenumber", size, (F.col("l_quantity") > 25).alias("is_page_render"))
    return files, items.join(files.select("file", "file_ext"), "file")


@query
def image_only_files(spark, sf_dir):
    files, media = order_media(spark, sf_dir)
    return parse.image_only(files, media)


@query
def media_without_scraps(spark, sf_dir):
    return parse.worth_keeping(order_media(spark, sf_dir)[1]).groupBy("file").agg(F.count(F.lit(1)).alias("n_media"), F.sum("size").alias("size"))


# ---- text


@query
def noise_filter(spark, sf_dir):
    lines = corpus.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    pages = corpus.markdown_pages(spark, sf_dir).select((-F.col("doc_id") - 1).alias("doc_id"), F.explode(F.split("content", "\n")).alias("line"))
    return lines.unionByName(pages).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_noise(F.col("line"))).alias("n_noise"))


@query
def toc_blocks(spark, sf_dir):
    lined = F.array_join(F.transform(F.split("l", " "), lambda w, i: F.when(i % 3 < 2, F.concat(F.lit("1."), i.cast("string"), F.lit(" "), w, F.lit(" "), (i + 10).cast("string"))).otherwise(w)), "\n")
    docs = corpus.table(spark, sf_dir, "documents").withColumn("l", F.replace("text", F.lit("\n"), F.lit(" ")))
    return docs.select("doc_id", T.is_toc_block(F.col("text")).alias("plain"), T.is_toc_block(lined).alias("lined"))


@query
def image_refs(spark, sf_dir):
    pages = corpus.markdown_pages(spark, sf_dir)
    return pages.select("doc_id", F.posexplode(T.image_refs(F.col("content"))).alias("pos", "i")).select("doc_id", "pos", "i.description", "i.path", "i.markdown")


@query
def classify_content(spark, sf_dir):
    return corpus.document_chunks(spark, sf_dir).select("chunk_index", "content_type")


@query
def detect_section(spark, sf_dir):
    pages = corpus.markdown_pages(spark, sf_dir).select("doc_id", F.posexplode(F.split("content", "\n\n")).alias("pos", "part"))
    return pages.select("doc_id", "pos", T.detect_section(F.col("part")).alias("section")).where("section IS NOT NULL")


@query
def cjk_rules(spark, sf_dir):
    """Noise, sections and labels of the documents behind, before or beside CJK forms of each rule."""
    d, t = F.col("doc_id").cast("string"), F.col("text")
    forms = [
        ("第", d, "页 / 第", d, "页"), ("本文件共提取 ", d, " 张"), ("第", d, "页 ", F.col("lang")), ("### 图片 ", d), ("### 图片 ", t), ("一、", t), ("第三章 ", t), ("二  甲 ", t), ("适用范围\n", t),
        (t, "\n不应"), ("图片附件", t), ("| 甲（含） | x |\n| 乙乙乙 | y |\n", t), ("甲：1\n乙： 2\n丙:3\n丁 : 4\n", t), ("| （不含） | z |\n| 乙乙乙 | y |\n", t), ("·•—",), ("四 ", d, " 甲"),
    ]
    made = F.array(*[F.concat(*[F.lit(x) if isinstance(x, str) else x for x in f]) for f in forms])
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(made).alias("form", "x"))
    return rows.select("doc_id", "form", T.is_noise(F.col("x")).alias("noise"), T.detect_section(F.col("x")).alias("section"), T.classify_content(F.col("x")).alias("content_type"))


@query
def strip_tables(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_tables(F.col("text"))).alias("stripped_md5"))


@query
def text_cleanup(spark, sf_dir):
    pages = corpus.markdown_pages(spark, sf_dir)
    text = F.replace(F.replace(F.col("content"), F.lit(" the "), F.lit(" ~~the~~ ")), F.lit(" a "), F.lit(" 2~3 "))
    clean = T.images_to_placeholder(T.normalize_tildes(T.strip_strikethrough(text)))
    return pages.select("doc_id", F.md5(clean).alias("clean_md5"))


@query
def rewrite_image_urls(spark, sf_dir):
    pages = corpus.markdown_pages(spark, sf_dir)
    return pages.select("doc_id", F.md5(T.rewrite_image_urls(F.col("content"), F.col("category"))).alias("rewritten_md5"))


@query
def desensitize(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.desensitize(F.col("text"), RULES)).alias("clean_md5"))


@query
def normalize_dirname(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select("page_id", T.normalize_dirname(F.concat("url", F.lit(" _._ ")), [("http", "")]).alias("dirname"))


@query
def content_tokens(spark, sf_dir):
    tokens = T.content_tokens(F.col("text"), ["the", "der", "und", "les"])
    return corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(tokens, " ").alias("tokens"))


@query
def embed_text(spark, sf_dir):
    text = T.embed_text(F.col("content_type"), F.col("section_path"), F.concat("source_file", F.lit(".md")), F.col("content"))
    return corpus.document_chunks(spark, sf_dir).select("chunk_index", F.md5(text).alias("text_md5"))


# ---- chunking


def headed(spark, sf_dir) -> DataFrame:
    """Blocks of the pages, split at headings and then at blank lines."""
    blocks = chunk.explode_blocks(corpus.markdown_pages(spark, sf_dir), chunk.split_headings(F.col("content")))
    parts = blocks.select("doc_id", (F.col("seq") * 10_000).alias("base"), "title", F.posexplode(chunk.split_blank_lines(F.col("body"))).alias("n", "p"))
    return parts.select("doc_id", (F.col("base") + F.col("n")).alias("seq"), "title", F.col("p.body").alias("body"))


@query
def choose_strategy(spark, sf_dir):
    pages = corpus.markdown_pages(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("page").alias("kind"), "content")
    docs = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), F.col("text").alias("content"))
    marked = lambda kind, pattern, made: docs.select("id", F.lit(kind).alias("kind"), F.regexp_replace("content", pattern, made).alias("content"))
    cjk = marked("brackets", r"([A-Z][^.]*\.)", "【$1】").unionByName(marked("numbered", r"(?m)^([A-Z])", "一、$1"))
    return pages.unionByName(docs).unionByName(cjk).select("id", "kind", chunk.choose_strategy(F.col("content")).alias("strategy"))


@query
def split_headings(spark, sf_dir):
    return chunk.explode_blocks(corpus.markdown_pages(spark, sf_dir), chunk.split_headings(F.col("content")))


@query
def split_blank_lines(spark, sf_dir):
    return chunk.explode_blocks(corpus.markdown_pages(spark, sf_dir), chunk.split_blank_lines(F.col("content"))).select("doc_id", "seq", "body")


@query
def split_subheadings(spark, sf_dir):
    body = F.regexp_replace("content", r"(?m)^([A-Z]\S+ \S+)", "### $1")
    return chunk.explode_blocks(corpus.markdown_pages(spark, sf_dir), chunk.split_subheadings(F.col("category"), body))


@query
def split_numbered(spark, sf_dir):
    text = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", r"(?m)^([A-Z])", "1.2 $1")).otherwise(F.regexp_replace("text", r"(?m)^([A-Z])", "三、$1"))
    return chunk.explode_blocks(corpus.table(spark, sf_dir, "documents"), chunk.split_numbered(text)).select("doc_id", "seq", "title", F.md5("body").alias("body_md5"))


@query
def split_brackets(spark, sf_dir):
    text = F.regexp_replace("text", r"([A-Z][^.]*\.)", "【$1】")
    return chunk.explode_blocks(corpus.table(spark, sf_dir, "documents"), chunk.split_brackets(text))


@query
def split_table_sections(spark, sf_dir):
    """Sheets with their brands as title rows; every second sheet has a row of an area behind each of these."""
    sheets = parse.rows_to_markdown(corpus.sheet_rows(spark, sf_dir))
    text = F.regexp_replace("content", "### ", "| brand title row ")
    text = F.regexp_replace(text, r"(?m)^(\| brand title row .*)$", "$1 |  |")
    area = F.regexp_replace(text, r"(?m)^(\| brand title row .*)$", "$1\n| the northern 区域： |  |")
    return chunk.split_table_sections(sheets.select("doc_id", F.when(F.col("doc_id") % 2 == 0, area).otherwise(text).alias("content")))


@query
def merge_short(spark, sf_dir):
    return chunk.merge_short(headed(spark, sf_dir))


@query
def merge_numbered(spark, sf_dir):
    marked = headed(spark, sf_dir).withColumn("body", F.when(F.length("body") % 3 == 0, F.concat(F.lit("1. "), "body")).otherwise(F.col("body")))
    return chunk.merge_numbered_items(marked)


@query
def carry_section(spark, sf_dir):
    blocks = headed(spark, sf_dir).withColumn("title", F.when(F.col("seq") % 3 == 0, F.col("title")).otherwise(""))
    return chunk.carry_section(blocks).select("doc_id", "seq", "section_path", F.md5("content").alias("content_md5"))


@query
def enrich_neighbors(spark, sf_dir):
    blocks = headed(spark, sf_dir).select("doc_id", "seq", F.col("body").alias("content"))
    with_images = blocks.withColumn("has_image", F.size(T.image_ids(F.col("content"))) > 0)
    return chunk.enrich_image_chunks(with_images).where("enriched_content IS NOT NULL").select("doc_id", "seq", F.md5("enriched_content").alias("enriched_md5"))


@query
def chunk_index(spark, sf_dir):
    docs = corpus.document_chunks(spark, sf_dir).select("category", "source_file", "doc_id")
    return chunk.dense_index(docs, ["category", "source_file", "doc_id"], "chunk_index")


@query
def chunk_documents(spark, sf_dir):
    return chunk.chunk_documents(corpus.markdown_pages(spark, sf_dir)).withColumn("image_ids", F.array_join("image_ids", ","))


@query
def image_columns(spark, sf_dir):
    ids = T.image_ids(F.col("content"))
    return corpus.markdown_pages(spark, sf_dir).select("doc_id", (F.size(ids) > 0).alias("has_image"), F.array_join(ids, ",").alias("image_ids"))


@query
def image_bindings(spark, sf_dir):
    blocks = headed(spark, sf_dir).where("length(body) % 2 = 0").select("doc_id", F.col("seq").cast("long").alias("chunk_index"), F.col("body").alias("content"))
    pages = corpus.markdown_pages(spark, sf_dir)
    chunks = blocks.join(pages.select("doc_id", "source_file"), "doc_id")
    return chunk.image_bindings(pages, chunks).select("source_file", F.coalesce("chunk_index", F.lit(-1)).cast("long").alias("chunk_index"), "pos", "description", "path", "bound")


@query
def chunk_stats(spark, sf_dir):
    pages = corpus.markdown_pages(spark, sf_dir)
    chunks = pages.select(F.lit("web").alias("source_file"), chunk.choose_strategy(F.col("content")).alias("split_strategy"), T.classify_content(F.col("content")).alias("content_type"), T.image_ids(F.col("content")).alias("image_ids"))
    return chunk.chunk_stats(chunks)


@query
def embed_images_inline(spark, sf_dir):
    """The pages with their images in an attachment section, and in their place a number, a pointer, one with two cases, or a numeral and a pointer."""
    pages = corpus.markdown_pages(spark, sf_dir)
    k = F.col("doc_id") % 5
    mark = F.when(k == 0, "图 1\n").when(k == 1, "参考图\n").when(k == 2, "如下图所示\n情况一：x\n情况二: y\n").when(k == 3, "附图二 示意图\n").otherwise("图 2 图3\n")
    shown = F.array_join(F.transform(T.image_refs(F.col("content")), lambda i: i["markdown"]), "\n")
    text = F.concat(F.regexp_replace("content", F.lit(r"!\[[^\n]*\n"), mark), F.lit("\n本文件共 3 张图片。\n## 图片附件\n"), shown)
    return inline.embed_images_inline(pages.select("doc_id", text.alias("content")))


# ---- sources and sinks: what is written in the shared folder and read again


@query
def chunks_roundtrip(spark, sf_dir):
    at = tables.scratch_path(spark, "chunks")
    chunks = corpus.document_chunks(spark, sf_dir).withColumn("image_ids", F.array(F.lit("a"), F.concat(F.lit("b"), "chunk_index")))
    tables.write_chunks_jsonl(chunks, at)
    return tables.read_chunks_jsonl(spark, at).select("chunk_index", "category", "source_file", "section_path", "content_type", F.md5("content").alias("content_md5"), F.array_join("image_ids", ",").alias("image_ids"))


@query
def table_roundtrip(spark, sf_dir):
    at = tables.scratch_path(spark, "parts")
    tables.write_table(corpus.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), at, "p_brand")
    return spark.read.parquet(at).select("p_partkey", "p_brand", "p_type")


@query
def bindings_roundtrip(spark, sf_dir):
    at = tables.scratch_path(spark, "bindings")
    tables.write_bindings_json(QUERIES["image_bindings"](spark, sf_dir).withColumn("markdown", F.concat(F.lit("!["), "description", F.lit("]"))), at)
    schema = "source_file string, images array<struct<chunk_index:long,pos:int,description:string,path:string,markdown:string,bound:boolean>>"
    return spark.read.schema(schema).json(at).select("source_file", F.explode("images").alias("i")).select("source_file", "i.chunk_index", "i.pos", "i.description", "i.path", "i.bound")


@query
def read_rules(spark, sf_dir):
    """The nations as a rule file: names to be replaced by regions."""
    at = tables.scratch_path(spark, "rules")
    nations = corpus.table(spark, sf_dir, "nation").join(corpus.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rules = F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("pattern"), F.col("r_name").alias("replacement"))))
    nations.agg(F.to_json(rules)).write.text(at)
    return spark.createDataFrame(tables.read_rules(spark, at), "pattern string, replacement string")


@query
def index_snapshot(spark, sf_dir):
    """Term statistics of the last complete snapshot, after one rebuild and another that failed."""
    at, chunks = tables.scratch_path(spark, "index"), corpus.document_chunks(spark, sf_dir).withColumn("enriched_content", F.lit(None).cast("string"))
    index.rebuild(chunks, f"{at}/index", f"{at}/cache")
    try:
        with tables.new_snapshot(spark, f"{at}/index") as half:
            chunks.write.parquet(f"{half}/chunks")
            raise InterruptedError
    except InterruptedError:
        pass
    return index.read_index(spark, f"{at}/index").terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def read_terms(spark, sf_dir):
    at = tables.scratch_path(spark, "terms")
    corpus.table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_type", F.lit(" "))).write.text(at)
    return tables.read_terms(spark, at)


@query
def read_synonyms(spark, sf_dir):
    """The nations as a dictionary file: a comment, blank lines, and each alias twice, of which the later counts."""
    at = tables.scratch_path(spark, "synonyms")
    nations = corpus.table(spark, sf_dir, "nation").join(corpus.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit("# note\n"), "n_name", F.lit("=old\n\n "), "n_name", F.lit(" = "), "r_name")
    nations.select(line).write.text(at)
    return tables.read_synonyms(spark, at).select("alias", "canonical")


# ---- indexes


@query
def bm25_postings(spark, sf_dir):
    return index.postings(corpus.document_chunks(spark, sf_dir))


@query
def bm25_term_stats(spark, sf_dir):
    terms = index.build_bm25(corpus.document_chunks(spark, sf_dir)).terms
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_doc_stats(spark, sf_dir):
    return index.doc_stats(corpus.document_chunks(spark, sf_dir))


@query
def index_stats(spark, sf_dir):
    return index.index_stats(index.doc_stats(corpus.document_chunks(spark, sf_dir)), corpus.document_vectors(spark, sf_dir))


@query
def vector_table(spark, sf_dir):
    made = index.vector_table(corpus.document_chunks(spark, sf_dir), corpus.document_vectors(spark, sf_dir))
    return made.select("chunk_index", "category", "source_file", "section_path", "content_type", F.size("embedding").cast("long").alias("dim"))


@query
def embed_hash(spark, sf_dir):
    made = index.build_vectors(corpus.document_chunks(spark, sf_dir).withColumn("enriched_content", F.lit(None).cast("string")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return made.select("chunk_index", "text_hash", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


@query
def vectors_cached(spark, sf_dir):
    """Vectors of which every second is taken from a cache, where they all are ones."""
    chunks = corpus.document_chunks(spark, sf_dir).withColumn("enriched_content", F.lit(None).cast("string"))
    keyed = index.text_hashes(chunks)
    cache = keyed.where("chunk_index % 2 = 0").select("text_hash").distinct().withColumn("embedding", F.array_repeat(F.lit(1.0).cast("float"), 64))
    made = index.build_vectors(chunks, cache).withColumn("cached", F.forall("embedding", lambda x: x == 1))
    even = F.max((F.col("chunk_index") % 2 == 0)).over(W.partitionBy("text_hash"))
    # a text that an even chunk has, too, is cached; any other has been embedded
    right = made.withColumn("right", F.col("cached") == even)
    return right.select("chunk_index", "text_hash", (F.col("right") & (F.col("chunk_index") % 2 == 0)).alias("from_cache"))


# ---- retrieval


@query
def query_expand(spark, sf_dir):
    synonyms = spark.createDataFrame(SYNONYMS, "ord int, alias string, canonical string")
    asked = corpus.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    return retrieve.expand_queries(asked, synonyms)


@query
def metadata_filter(spark, sf_dir):
    return retrieve.metadata_filter(corpus.document_chunks(spark, sf_dir), ["en", "fr"], [T.PLAIN]).select("chunk_index", "category", "content_type")


def lexical(spark, sf_dir, k: int = 5 * TOP_K) -> DataFrame:
    return retrieve.bm25_topk(corpus.benchmark_queries(spark, sf_dir), index.build_bm25(corpus.document_chunks(spark, sf_dir)), k)


def nearest(spark, sf_dir, k: int = 5 * TOP_K) -> DataFrame:
    return retrieve.vector_topk(corpus.benchmark_queries(spark, sf_dir), corpus.document_vectors(spark, sf_dir), k)


def fused(spark, sf_dir) -> DataFrame:
    return retrieve.rrf_fuse(nearest(spark, sf_dir), lexical(spark, sf_dir), 4 * TOP_K)


def hits(spark, sf_dir) -> DataFrame:
    chunks = corpus.document_chunks(spark, sf_dir)
    return retrieve.retrieve(corpus.benchmark_queries(spark, sf_dir), chunks, index.build_bm25(chunks), corpus.document_vectors(spark, sf_dir), TOP_K)


def asked_hits(spark, sf_dir) -> DataFrame:
    return hits(spark, sf_dir).join(corpus.benchmark_queries(spark, sf_dir).select("query_id", "query"), "query_id")


@query
def bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir)


def short_queries(spark, sf_dir) -> DataFrame:
    """The queries by their last four words, as people type them."""
    asked = corpus.benchmark_queries(spark, sf_dir)
    return asked.select("query_id", F.array_join(F.reverse(F.slice(F.reverse(T.tokenize(F.col("query"))), 1, 4)), " ").alias("query"))


@query
def bm25_bounded(spark, sf_dir):
    """Lexical top ten by bounds over blocks of postings; the same as by scoring them all."""
    blocked = impact.impact_blocks(index.build_bm25(corpus.document_chunks(spark, sf_dir)))
    return impact.bounded_bm25(short_queries(spark, sf_dir), blocked, TOP_K)[0]


@query
def bm25_padded(spark, sf_dir):
    """Each query asked by its last word, and filled up to ten chunks; those of every third query are English."""
    chunks = corpus.document_chunks(spark, sf_dir)
    english = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("en")))
    asked = corpus.benchmark_queries(spark, sf_dir).select("query_id", F.element_at(T.tokenize(F.col("query")), -1).alias("query"), english.alias("categories"))
    about = chunks.select("chunk_index", "category", "content_type")
    return retrieve.bm25_topk(asked, index.build_bm25(chunks), TOP_K, chunks=about, pad_zero=about)


@query
def bm25_dictionary(spark, sf_dir):
    """Lexical search with a dictionary that keeps compounds whole where no space parts them."""
    compound = lambda c: F.replace(c, F.lit(" the "), F.lit(" 配电系统照明 "))
    cut = lambda c: helpers.dictionary_tokens(c, ["配电系统", "照明", "配电"])
    chunks = corpus.document_chunks(spark, sf_dir).withColumn("content", compound("content"))
    asked = corpus.benchmark_queries(spark, sf_dir).withColumn("query", compound("query"))
    return retrieve.bm25_topk(asked, index.build_bm25(chunks, cut), TOP_K, tokenize=cut)


@query
def bm25_segmented(spark, sf_dir):
    """Lexical search with runs of CJK cut by word frequencies: the words of a run overlap, and the likelier pair is cut."""
    compound = lambda c: F.replace(c, F.lit(" the "), F.lit(" 配电系统照明 "))
    cut = lambda c: helpers.weighted_tokens(c, {"配电": 40, "系统照明": 50, "配电系统": 10, "照明": 5, "系统": 3})
    chunks = corpus.document_chunks(spark, sf_dir).withColumn("content", compound("content"))
    asked = corpus.benchmark_queries(spark, sf_dir).withColumn("query", compound("query"))
    return retrieve.bm25_topk(asked, index.build_bm25(chunks, cut), TOP_K, tokenize=cut)


@query
def vector_topk(spark, sf_dir):
    return nearest(spark, sf_dir, TOP_K)


@query
def rrf_fuse(spark, sf_dir):
    return fused(spark, sf_dir)


@query
def file_diversity(spark, sf_dir):
    files = corpus.document_chunks(spark, sf_dir).select("chunk_index", "source_file")
    return retrieve.file_diversity(fused(spark, sf_dir).join(files, "chunk_index"), TOP_K).select("query_id", "rank", "chunk_index", "source_file")


@query
def hybrid_retrieve(spark, sf_dir):
    return hits(spark, sf_dir).select("query_id", "rank", "chunk_index", "relevance_score", "relevance", "source_file", "category")


def filtered_queries(spark, sf_dir) -> DataFrame:
    """The queries with lists of their own: languages for some, content types for some, one that nothing meets."""
    asked = corpus.benchmark_queries(spark, sf_dir)
    k = F.col("query_id") % 5
    none = F.lit(None).cast("array<string>")
    lists = {
        "categories": F.when(k == 1, F.array(F.lit("en"), F.lit("fr"))).when(k == 3, F.array(F.lit("de"))).when(k == 4, F.array(F.lit("xx"))).otherwise(none),
        "content_types": F.when(k == 2, F.array(F.lit(T.MAIN_TABLE))).when(k == 3, F.array(F.lit(T.PLAIN))).otherwise(none),
    }
    return asked.withColumns(lists)


@query
def bm25_topk_filtered(spark, sf_dir):
    chunks = corpus.document_chunks(spark, sf_dir)
    return retrieve.bm25_topk(filtered_queries(spark, sf_dir), index.build_bm25(chunks), TOP_K, chunks=chunks)


@query
def vector_topk_filtered(spark, sf_dir):
    return retrieve.vector_topk(filtered_queries(spark, sf_dir), corpus.document_vectors(spark, sf_dir), TOP_K, corpus.document_chunks(spark, sf_dir))


@query
def retrieve_filtered(spark, sf_dir):
    """The whole chain: expansion, filters on both legs, fusion, diversity, reranking and labels."""
    chunks = corpus.document_chunks(spark, sf_dir)
    synonyms = spark.createDataFrame(SYNONYMS, "ord int, alias string, canonical string")
    made = retrieve.retrieve(filtered_queries(spark, sf_dir), chunks, index.build_bm25(chunks), corpus.document_vectors(spark, sf_dir), TOP_K, synonyms=synonyms)
    return made.select("query_id", "rank", "chunk_index", "relevance_score", "relevance", "rerank_score", "source_file", "category")


@query
def label_relevance(spark, sf_dir):
    return retrieve.label_relevance(fused(spark, sf_dir)).select("query_id", "rank", "chunk_index", "relevance_score", "relevance")


@query
def search_citations(spark, sf_dir):
    return retrieve.citations(hits(spark, sf_dir)).select("query_id", "rank", "source_file", "section_path", "content_type", "relevance_score", "relevance", "excerpt")


@query
def filename_boost(spark, sf_dir):
    files = corpus.table(spark, sf_dir, "documents").select(F.concat(F.element_at(F.split("text", "\n"), 1), F.lit(".md")).alias("source_file"))
    asked = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieve.filename_boost(asked, files)


@query
def rerank(spark, sf_dir):
    texts = fused(spark, sf_dir).withColumnRenamed("fused_rank", "rank").join(corpus.document_chunks(spark, sf_dir).select("chunk_index", "content"), "chunk_index")
    asked = texts.join(corpus.benchmark_queries(spark, sf_dir).select("query_id", "query"), "query_id")
    return retrieve.rerank(asked, TOP_K).select("query_id", "rank", "chunk_index", "rerank_score")


def placed_vectors(spark, sf_dir, spill: int, part_rows: int = vectors.PART_ROWS) -> vectors.VectorLayout:
    """The documents' vectors among 128 centres."""
    given = corpus.document_vectors(spark, sf_dir)
    return vectors.build_layout(given, vectors.fit_centers(given, 128)[0], spill, part_rows)


@query
def vector_bounds(spark, sf_dir):
    """The same as vector_topk, by rings of a layout that may hold as good a vector as the k-th best."""
    return vectors.bounded_topk(corpus.benchmark_queries(spark, sf_dir), placed_vectors(spark, sf_dir, 1, 100), TOP_K)[0]


@query
def ivf_topk(spark, sf_dir):
    """A quarter of the clusters is probed, and each vector lies in three of them."""
    return vectors.ivf_topk(corpus.benchmark_queries(spark, sf_dir), placed_vectors(spark, sf_dir, 3), TOP_K, nprobe=32)


@query
def ivf_recall(spark, sf_dir):
    """How many neighbours the exact search finds, and whether the clusters find nine tenths of them or more."""
    asked, keys = corpus.benchmark_queries(spark, sf_dir), ["query_id", "chunk_index"]
    exact = nearest(spark, sf_dir, TOP_K).select(*keys)
    near = vectors.ivf_topk(asked, placed_vectors(spark, sf_dir, 3), TOP_K, nprobe=32).select(*keys, F.lit(True).alias("found"))
    both = exact.join(near, keys, "left").agg(F.count(F.lit(1)).alias("n_neighbours"), F.count("found").alias("n_found"))
    return both.select("n_neighbours", (F.col("n_found") >= 0.9 * F.col("n_neighbours")).alias("enough"))


# ---- answers


@query
def followup_enrich(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations")
    short = F.when(F.col("turn") % 4 == 2, F.substring("text", 1, 7)).otherwise(F.col("text"))
    return answer.followup_enrich(turns.withColumn("text", short))


@query
def history_window(spark, sf_dir):
    made = answer.history_window(corpus.table(spark, sf_dir, "conversations"), 3)
    said = F.array_join(F.transform("history", lambda h: F.concat(h["role"], F.lit(":"), h["text"])), "|")
    return made.select("conv_id", "turn", F.size("history").cast("long").alias("n_history"), F.md5(said).alias("history_md5"))


@query
def build_context(spark, sf_dir):
    return answer.build_context(hits(spark, sf_dir)).select("query_id", F.md5("context").alias("context_md5"))


@query
def build_messages(spark, sf_dir):
    context = answer.build_context(hits(spark, sf_dir))
    asked = corpus.benchmark_queries(spark, sf_dir).select("query_id", "query").join(context, "query_id").withColumn("history", F.array(F.struct(F.lit("user").alias("role"), F.lit("hello").alias("text"))))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "|")
    return answer.build_messages(asked).select("query_id", F.size("messages").cast("long").alias("n_messages"), F.md5(said).alias("messages_md5"))


def page_hits(spark, sf_dir) -> DataFrame:
    """Blocks of the pages as hits of a query, one query per page: the words of its heading."""
    pages = corpus.markdown_pages(spark, sf_dir)
    blocks = headed(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "seq", F.col("title").alias("query"), F.col("body").alias("content"), F.length("body").alias("n"))
    ranked = blocks.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("seq")))
    ranked = ranked.withColumn("relevance", F.when(F.col("n") % 2 == 0, "direct").otherwise("indirect")).withColumn("image_ids", F.array(F.concat(F.lit("a b/"), F.col("n").cast("string"), F.lit(".png"))))
    return ranked.join(pages.select(F.col("doc_id").alias("query_id"), "category"), "query_id")


@query
def source_images(spark, sf_dir):
    return answer.source_images(page_hits(spark, sf_dir))


@query
def image_intent(spark, sf_dir):
    return answer.image_intent(page_hits(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 3 == 0, F.concat("query", F.lit(" 附图"))).otherwise(F.col("query"))))


def table_hits(spark, sf_dir) -> DataFrame:
    """Sheets as hits: one query per document, the brands are what is asked for."""
    sheets = parse.rows_to_markdown(corpus.sheet_rows(spark, sf_dir))
    parts = sheets.select(F.col("doc_id").alias("query_id"), F.posexplode(F.split("content", "\n## ")).alias("pos", "content"))
    hit = parts.select("query_id", (F.col("pos") + 1).alias("rank"), "content", F.lit("widget bolt Brand").alias("query"), F.when(F.col("pos") % 2 == 0, "direct").otherwise("indirect").alias("relevance"))
    return hit.withColumn("relevance_score", F.round(1.0 / (F.col("rank") + 20), 6))


@query
def source_tables(spark, sf_dir):
    return answer.source_tables(table_hits(spark, sf_dir))


@query
def media_sections(spark, sf_dir):
    return answer.media_sections(answer.source_images(page_hits(spark, sf_dir)), answer.source_tables(table_hits(spark, sf_dir)))


@query
def source_list(spark, sf_dir):
    return answer.source_list(hits(spark, sf_dir))


# ---- audit


@query
def audit_report(spark, sf_dir):
    chunks = corpus.document_chunks(spark, sf_dir)
    checks = audit.chunk_checks(chunks).unionByName(audit.vector_check(corpus.document_vectors(spark, sf_dir), 64)).unionByName(audit.lexical_check(index.doc_stats(chunks)))
    return checks


@query
def audit_retrievability(spark, sf_dir):
    chunks = corpus.document_chunks(spark, sf_dir)
    return audit.self_retrieval(chunks, index.build_bm25(chunks), 20)


@query
def audit_run(spark, sf_dir):
    chunks = corpus.document_chunks(spark, sf_dir)
    checks = audit.run_audit(chunks, index.build_bm25(chunks), index.doc_stats(chunks), corpus.document_vectors(spark, sf_dir), 64)
    return audit.report(checks)


# ---- streaming


def dropped_pages(spark, sf_dir, batches: int = 1) -> str:
    """The pages in a drop folder, ingested in so many batches; the folder."""
    at = tables.scratch_path(spark, "ingest")
    corpus.markdown_pages(spark, sf_dir).repartition(batches, "doc_id").write.parquet(f"{at}/drop")
    ingest.ingest_stream(spark, f"{at}/drop", f"{at}/out", f"{at}/checkpoint", files_per_batch=1).awaitTermination()
    return at


CHUNK_COLUMNS = ["seq", "category", "source_file", "section_path", "content_type", "content", "split_strategy", "has_image"]


def without_numbers(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("image_ids", F.array_join("image_ids", ","))


@query
def ingest_stream(spark, sf_dir):
    """The pages, dropped as a stream, as chunks without their numbers; the same as from one batch."""
    chunks = spark.read.parquet(f"{dropped_pages(spark, sf_dir)}/out/chunks")
    return without_numbers(chunks).select("doc_id", *CHUNK_COLUMNS, "image_ids", "enriched_content")


@query
def ingest_terms(spark, sf_dir):
    """Term statistics after several batches, summed over the deltas; the same as over all chunks at once."""
    terms = ingest.corpus_statistics(spark, f"{dropped_pages(spark, sf_dir, 3)}/out").terms
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def ingest_files(spark, sf_dir):
    """The pages of each host as one text file in a drop folder, as chunks, and whether each has its vector in a cluster."""
    at = tables.scratch_path(spark, "files")
    pages = F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("content", F.lit("")).alias("text"))))
    joined = F.array_join(F.transform(pages, lambda p: p["text"]), "\n\n")
    host = F.regexp_extract("source_file", "//([^/]+)", 1)
    texts = corpus.markdown_pages(spark, sf_dir).groupBy(F.concat(host, F.lit(".md")).alias("name")).agg(joined.alias("value"))
    texts.write.partitionBy("name").text(f"{at}/drop")
    centers, _ = vectors.fit_centers(corpus.document_vectors(spark, sf_dir), 16)
    stored_as = F.regexp_extract("path", "/name=([^/]+)/", 1)
    ingest.ingest_files(spark, f"{at}/drop", f"{at}/out", f"{at}/checkpoint", centers=centers, category="web", name=stored_as).awaitTermination()
    placed = spark.read.parquet(f"{at}/out/vectors").select("chunk_index", (F.col("cluster_id") >= 0).alias("placed"))
    chunks = spark.read.parquet(f"{at}/out/chunks").join(placed, "chunk_index", "left")
    return without_numbers(chunks).select(*CHUNK_COLUMNS, "image_ids", "enriched_content", "placed")
