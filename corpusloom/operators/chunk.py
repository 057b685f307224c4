"""Splitting Markdown documents into typed, section-labelled chunks.

A splitter turns a text into an array of (title, body) blocks; merging and labelling then run over blocks
(doc_id, seq, title, body) with windows per document, all on one partitioning by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import text as T
from corpusloom.operators import inline
from corpusloom.sources.tables import checkpointed

BLOCKS = "array<struct<title:string,body:string>>"
BRACKET = r"【[^】]+】"
HEADING = r"^#{1,2}[ \t]+\S"
SUBHEADING = r"^###[ \t]+\S"
NUMBERED = rf"^(?:[{T.CN}]+、|[0-9]+(?:\.[0-9]+)*[ \t]+[^0-9])"
ITEM = r"(?U)^\d+[、.．)\s]"
MIN_LENGTH = 50


def block(title: Column, body: Column) -> Column:
    return F.struct(title.alias("title"), body.alias("body"))


def is_title_row(line: Column) -> Column:
    """A table row with text of ten characters or more in one cell and nothing in the others."""
    cells = F.filter(F.transform(F.split(line, r"\|", -1), T.py_strip), lambda x: x != "")
    return line.startswith("|") & (F.size(cells) == 1) & (F.length(F.element_at(F.concat(cells, F.array(F.lit(""))), 1)) >= 10)


def choose_strategy(text: Column) -> Column:
    """BRACKET, TABLE, H2, CN+DIGIT or NL, whichever applies first."""
    rows = F.filter(T.lines(text), lambda x: T.py_strip(x).startswith("|"))
    table = (F.size(rows) >= 4) & (F.size(rows) >= F.size(T.lines(text)) * F.lit(0.3)) & F.exists(rows, is_title_row)
    numbered = text.rlike(rf"(?m)^[{T.CN}]+、[ \t]*\S") | text.rlike(r"(?m)^[0-9]+(\.[0-9]+)*[ \t]+\S")
    return (
        F.when(F.regexp_count(text, F.lit(BRACKET)) >= 2, "BRACKET").when(table, "TABLE").when(text.rlike(r"(?m)^#{2,3}[ \t]+\S"), "H2")
        .when(numbered, "CN+DIGIT").otherwise("NL")
    )


def _first_line(c: Column) -> Column:
    return T.py_strip(F.substring_index(c, "\n", 1))


def _after_first(c: Column) -> Column:
    return T.py_strip(F.when(c.contains("\n"), F.substring(c, F.length(F.substring_index(c, "\n", 1)) + 2, F.length(c))).otherwise(""))


def _denoised(body: Column) -> Column:
    return T.let(body, lambda b: F.when(T.is_noise(b), "").otherwise(b))


def _titled(p: Column, pattern: str) -> Column:
    """A part as a block: under its first line if that is a heading, else without a title."""
    headed = block(_first_line(p), _denoised(_after_first(p)))
    return F.when(p.rlike(pattern), headed).otherwise(block(F.lit(""), _denoised(T.py_strip(p))))


def split_brackets(text: Column) -> Column:
    """A block per bracketed passage, titled by its first line; what follows it goes to it, what precedes the first is dropped."""
    gaps = F.split(text, BRACKET, -1)

    def one(b: Column, i: Column) -> Column:
        inner = T.py_strip(F.substring(b, F.lit(2), F.length(b) - 2))
        gap = T.py_strip(F.get(gaps, i + 1))
        return block(_first_line(inner), F.when(gap == "", inner).otherwise(F.concat(inner, F.lit("\n"), gap)))

    return F.transform(F.regexp_extract_all(text, F.lit(f"({BRACKET})"), F.lit(1)), one)


def split_subheadings(title: Column, body: Column) -> Column:
    """A block split at ``###``; children are titled ``parent > ### child``."""

    def one(p: Column) -> Column:
        child = F.when(title == "", _first_line(p)).otherwise(F.concat(title, F.lit(" > "), _first_line(p)))
        return F.when(p.rlike(SUBHEADING), block(child, _denoised(_after_first(p)))).otherwise(block(title, T.py_strip(p)))

    kept = F.filter(F.split(body, rf"(?m)(?={SUBHEADING})"), lambda p: p.rlike(SUBHEADING) | ~T.is_noise(p))
    return F.when(body.rlike(f"(?m){SUBHEADING}"), F.transform(kept, one)).otherwise(F.array(block(title, body)))


def split_headings(text: Column) -> Column:
    """Blocks at ``#`` and ``##``, split again at ``###``; a text before the first heading is a block of its own."""
    found = F.transform(F.split(text, rf"(?m)(?={HEADING})"), lambda p: _titled(p, HEADING))
    found = F.filter(found, lambda b: (b["title"] != "") | (b["body"] != ""))
    return F.flatten(F.transform(found, lambda b: split_subheadings(b["title"], b["body"])))


def split_numbered(text: Column) -> Column:
    """Blocks at numbered headings; the marker line is the title."""
    found = F.transform(F.split(text, f"(?m)(?={NUMBERED})"), lambda p: _titled(p, NUMBERED))
    return F.filter(found, lambda b: (b["title"] != "") | (b["body"] != ""))


def split_blank_lines(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, r"\n(?U)\s*\n"), T.py_strip), lambda p: (p != "") & ~T.is_noise(p))
    return F.transform(parts, lambda p: block(F.lit(""), p))


RULE_ROW = r"(?U)^\|[\s\-:]+\|\s*$"


def table_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line, kind (rule, text, title or data), name (of a title row), and seg, which counts the text lines and title rows so far.

    Also what is known at a line: ``header``, the first data row of the document if it lies before, and ``rule``, the latest rule row before.
    """
    each = docs.select("doc_id", F.posexplode(T.lines(F.col("content"))).alias("pos", "line")).withColumn("row", T.py_strip(F.col("line")))
    kind = F.when(F.col("row").rlike(RULE_ROW), "rule").when(~F.col("row").startswith("|"), "text").when(is_title_row(F.col("row")), "title").otherwise("data")
    cells = F.filter(F.transform(F.split("row", r"\|", -1), T.py_strip), lambda x: x != "")
    name = F.rtrim(F.rtrim(F.get(cells, F.lit(0)), F.lit("：")), F.lit(":"))
    typed = each.withColumn("kind", kind).withColumn("name", F.when(F.col("kind") == "title", name))
    doc = W.partitionBy("doc_id").orderBy("pos")
    before = doc.rowsBetween(W.unboundedPreceding, -1)
    opens = F.col("kind").isin("text", "title")
    return typed.select(
        "doc_id", "pos", "line", "kind", "name", F.count(F.when(opens, 1)).over(doc).alias("seg"),
        F.first(F.when(F.col("kind") == "data", F.col("line")), True).over(before).alias("header"), F.last(F.when(F.col("kind") == "rule", F.col("line")), True).over(before).alias("rule"),
    )


def split_table_sections(docs: DataFrame, keep_trailing: bool = False) -> DataFrame:
    """doc_id, seq, title, body: the pipe tables of docs (doc_id, content) split at their title rows.

    A text line or title row opens a segment, whose rows are a block if there are any. Blocks under a title row begin with the first data row of the
    document and the latest rule row, so a title row that another one follows is a block as soon as there is one of these. A short title, or one
    of an area, is put behind the title before it; a text line behind a block ends that chain. Text lines since the last block lead the next one.
    Noise goes, and a text in which nothing is found stays whole. Text after the last table is dropped unless ``keep_trailing``.
    """
    rows = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin("rule", "data"), F.struct("pos", "line")))), lambda r: r["line"])
    first = lambda c: F.min_by(c, "pos")
    segs = table_lines(docs).groupBy("doc_id", "seg").agg(first("kind").alias("kind"), first("name").alias("name"), first("line").alias("line"), first("header").alias("header"), first("rule").alias("rule"), rows.alias("rows"))
    opened = F.when(F.col("kind") == "title", F.filter(F.array("header", "rule"), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    segs = segs.withColumn("rows", F.concat(opened, "rows"))
    doc = W.partitionBy("doc_id").orderBy("seg")
    so_far = doc.rowsBetween(W.unboundedPreceding, 0)
    had = F.lag(F.size("rows") > 0, 1, False).over(doc)
    segs = segs.withColumn("had", had).withColumn("lead_of", F.count(F.when(F.col("had"), 1)).over(doc))
    segs = segs.withColumn("chain", F.count(F.when((F.col("kind") == "text") & F.col("had"), 1)).over(doc))
    in_chain = W.partitionBy("doc_id", "chain").orderBy("seg")
    under = (F.col("name").endswith("区域") | (F.length("name") <= 6)) & (F.coalesce(F.max(F.length("name")).over(in_chain.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) > 0)
    segs = segs.withColumn("base", F.count(F.when(F.col("name").isNotNull() & ~under, 1)).over(in_chain))
    names = F.collect_list("name").over(W.partitionBy("doc_id", "chain", "base").orderBy("seg").rowsBetween(W.unboundedPreceding, 0))
    texts = F.collect_list(F.when(F.col("kind") == "text", F.col("line"))).over(W.partitionBy("doc_id", "lead_of").orderBy("seg").rowsBetween(W.unboundedPreceding, 0))
    made = segs.select(
        "doc_id", "seg", F.array_join(names, "-").alias("title"), T.py_strip(F.array_join(texts, "\n")).alias("lead"), (F.size("rows") > 0).alias("table"), T.py_strip(F.array_join("rows", "\n")).alias("body"),
        (F.col("seg") == F.max("seg").over(W.partitionBy("doc_id"))).alias("last"),
    )
    led = F.when(T.is_noise(F.col("lead")), F.col("body")).otherwise(F.concat("lead", F.lit("\n\n"), "body"))
    found = made.where(F.col("table") & ~T.is_noise(F.col("body"))).select("doc_id", "seg", "title", led.alias("body"))
    if keep_trailing:
        tail = made.where(F.col("last") & ~F.col("table") & (F.col("lead") != "") & ~T.is_noise(F.col("lead")))
        found = found.unionByName(tail.select("doc_id", "seg", F.lit("").alias("title"), F.col("lead").alias("body")))
    whole = docs.select("doc_id", T.py_strip(F.col("content")).alias("body")).where("body != ''").join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    both = found.unionByName(whole.select("doc_id", F.lit(0).cast("long").alias("seg"), F.lit("").alias("title"), "body"))
    return both.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("seg")) - 1).alias("seq"), "title", "body")


def explode_blocks(docs: DataFrame, blocks: Column, *keep: str) -> DataFrame:
    out = docs.select("doc_id", *keep, F.posexplode(blocks).alias("seq", "b"))
    return out.select("doc_id", *keep, "seq", "b.title", "b.body")


def _document() -> W:
    return W.partitionBy("doc_id").orderBy("seq")


def _joined(df: DataFrame, keys: list[str], separator: str) -> DataFrame:
    """Groups of neighbouring blocks as one: bodies joined, the first title that is not empty, the first seq."""
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda s: s["body"])
    title = F.coalesce(F.min_by(F.when(F.col("title") != "", F.col("title")), F.when(F.col("title") != "", F.col("seq"))), F.lit(""))
    made = df.groupBy("doc_id", *keys).agg(F.min("seq").alias("seq"), title.alias("title"), F.array_join(bodies, separator).alias("body"))
    return made.select("doc_id", "seq", "title", "body")


def merge_short(blocks: DataFrame, shorter_than: int = MIN_LENGTH) -> DataFrame:
    """Noise dropped, and each run of short blocks merged into one."""
    clean = blocks.withColumn("body", T.py_strip(F.col("body"))).where(~T.is_noise(F.col("body")))
    long = (F.length("body") >= shorter_than).cast("int")
    marked = clean.withColumn("long", long).withColumn("run", F.sum("long").over(_document()))
    return _joined(marked, ["run", "long"], "\n\n")


def merge_numbered_items(blocks: DataFrame) -> DataFrame:
    """Blocks that start like ``1、`` or ``2.`` appended to the block before them, which keeps its title."""
    stripped = blocks.withColumn("body", T.py_strip(F.col("body")))
    starts = (~F.col("body").rlike(ITEM)).cast("int")
    first = F.row_number().over(_document()) == 1
    grouped = stripped.withColumn("grp", F.sum(F.when(first, 1).otherwise(starts)).over(_document()))
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda s: s["body"])
    made = grouped.groupBy("doc_id", "grp").agg(F.min("seq").alias("seq"), F.min_by("title", "seq").alias("title"), F.array_join(bodies, "\n").alias("body"))
    return made.select("doc_id", "seq", "title", "body")


def carry_section(blocks: DataFrame) -> DataFrame:
    """section_path: the block's own heading, else its title, else the last one known; put before the body unless there."""
    own = F.coalesce(T.detect_section(F.col("body")), F.when(F.col("title") != "", F.col("title")))
    carried = F.last(own, ignorenulls=True).over(_document().rowsBetween(W.unboundedPreceding, 0))
    out = blocks.withColumn("section_path", F.coalesce(carried, F.lit("")))
    headed = (F.col("section_path") != "") & ~F.col("body").startswith(F.col("section_path"))
    content = F.when(headed, F.concat("section_path", F.lit("\n\n"), "body")).otherwise(F.col("body"))
    return out.withColumn("content", content)


def enrich_image_chunks(chunks: DataFrame, n_chars: int = 200) -> DataFrame:
    """enriched_content for chunks with images: the start of the neighbours that have none, after the chunk."""
    near = lambda f: F.when(~f("has_image").over(_document()), F.substring(f("content").over(_document()), 1, n_chars))
    both = chunks.withColumn("__near", F.when(F.col("has_image"), F.array_compact(F.array(near(F.lag), near(F.lead)))))
    text = F.when(F.size("__near") > 0, F.concat("content", F.lit("\n\n"), F.array_join("__near", "\n")))
    return both.withColumn("enriched_content", text).drop("__near")


def dense_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a dense number from 0 in the given order.

    Rows are ranged over partitions and sorted there; only the number of rows of each partition comes to the driver.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.withColumn("__place", F.monotonically_increasing_id()))
    part, row = F.shiftright("__place", 33).cast("int"), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    start = F.get(F.array(*[F.lit(x).cast("long") for x in offsets or [0]]), part)
    return placed.withColumn(name, start + row).drop("__place")


def documents_to_blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, category, source_file, content) -> doc_id, strategy, seq, title, body after splitting. With a column ``strategy`` that one counts."""
    text = F.col("content")
    chosen = docs if "strategy" in docs.columns else docs.withColumn("strategy", choose_strategy(text))
    chosen = chosen.where(text.isNotNull()).select("doc_id", "content", "strategy")
    splits = F.when(F.col("strategy") == "BRACKET", split_brackets(text)).when(F.col("strategy") == "H2", split_headings(text))
    splits = splits.when(F.col("strategy") == "CN+DIGIT", split_numbered(text)).when(F.col("strategy") == "NL", split_blank_lines(text))
    plain = explode_blocks(chosen.where("strategy != 'TABLE'"), splits, "strategy")
    parted = split_table_sections(chosen.where("strategy = 'TABLE'")).withColumn("strategy", F.lit("TABLE"))
    return plain.unionByName(parted)


def chunk_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, category, source_file, content) -> the chunks table, numbered by category, file and place.

    Texts with their images and strategies are written once, and so are the blocks they are split into.
    """
    inlined = inline.embed_images_inline(docs.select("doc_id", "category", "source_file", "content"))
    docs = checkpointed(inlined.withColumn("strategy", choose_strategy(F.col("content"))))
    blocks = checkpointed(documents_to_blocks(docs))
    plain = blocks.where("strategy != 'BRACKET'").select("doc_id", "seq", "title", "body")
    merged = merge_numbered_items(merge_short(plain)).unionByName(blocks.where("strategy = 'BRACKET'").select("doc_id", "seq", "title", "body"))
    carried = carry_section(merged).withColumn("content_type", T.classify_content(F.col("body")))
    with_images = carried.withColumn("image_ids", T.image_ids(F.col("content"))).withColumn("has_image", F.size("image_ids") > 0)
    chunks = enrich_image_chunks(with_images).drop("title", "body")
    about = docs.select("doc_id", "category", "source_file", F.col("strategy").alias("split_strategy"))
    numbered = dense_index(chunks.join(about, "doc_id"), ["category", "source_file", "doc_id", "seq"], "chunk_index")
    return numbered.select(
        "chunk_index", "doc_id", "seq", "category", "source_file", "section_path", "content_type", "content", "split_strategy", "has_image", "image_ids", "enriched_content",
    )


def image_bindings(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_file, chunk_index, pos, description, path, markdown, bound: images of chunks, then those in no chunk."""
    refs = lambda df, *keep: df.select(*keep, F.posexplode(T.image_refs(F.col("content"))).alias("pos", "i")).select(*keep, "pos", "i.*")
    bound = refs(chunks, "source_file", "chunk_index").withColumn("bound", F.lit(True))
    loose = refs(docs, "source_file").join(bound.select("source_file", "path"), ["source_file", "path"], "left_anti")
    return bound.unionByName(loose.withColumn("chunk_index", F.lit(None).cast("long")).withColumn("bound", F.lit(False)))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and image references by file, strategy and content type."""
    return chunks.groupBy("source_file", "split_strategy", "content_type").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.size("image_ids")).alias("n_images"))
