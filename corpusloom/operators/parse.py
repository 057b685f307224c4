"""From dropped files, sheet rows and word elements to Markdown documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Which parser reads which suffix, and what a listing admits.
PARSERS = {
    ".docx": "python-docx", ".pdf": "kreuzberg", ".pptx": "kreuzberg", ".ppt": "kreuzberg", ".doc": "kreuzberg", ".xls": "openpyxl_xlrd",
    ".xlsx": "openpyxl_xlrd", ".xlsm": "openpyxl_xlrd", ".txt": "txt_direct", ".md": "txt_direct",
}
FALLBACK = {"kreuzberg": "zhipu"}
ADMITTED = (".docx", ".pdf", ".pptx", ".xls", ".xlsx", ".txt", ".md", ".doc")
NO_CAPTION = (".wmf", ".emf", ".svg", ".svgz")


def describe_files(files: DataFrame) -> DataFrame:
    """files (path, modificationTime, length, ...) with stored name, original name, suffix and stem; admitted ones only."""
    stored = F.element_at(F.split("path", "/"), -1)
    named = files.withColumn("filename", stored).withColumn("original", F.regexp_replace("filename", r"^[0-9a-f]{8}_", ""))
    named = named.withColumn("ext", F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1)))
    return named.where(F.col("ext").isin(*ADMITTED)).withColumn("stem", F.regexp_replace("filename", r"\.[^.]*$", ""))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a drop folder, newest first."""
    return describe_files(spark.read.format("binaryFile").load(path)).orderBy(F.desc("modificationTime"), "filename")


def parse_text(files: DataFrame) -> DataFrame:
    """content of text files: UTF-8 with bad bytes replaced, under a heading with the stem; char_count."""
    body = F.make_valid_utf8(F.col("content").cast("string"))
    out = files.withColumn("content", F.concat(F.lit("# "), "stem", F.lit("\n\n"), body))
    return out.withColumn("char_count", F.length("content").cast("long"))


def parser_for(ext: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for suffix, name in PARSERS.items():
        chosen = F.when(ext == suffix, name).otherwise(chosen)
    return F.coalesce(chosen, F.lit("unknown"))


def route_manifest(files: DataFrame) -> DataFrame:
    """files (filename, ext, content: what the first parser made of it) with parser, status and char_count."""
    first = parser_for(F.col("ext"))
    empty = F.trim(F.coalesce("content", F.lit(""))) == ""
    second = F.lit(None).cast("string")
    for name, other in FALLBACK.items():
        second = F.when((first == name) & empty, other).otherwise(second)
    routed = files.withColumn("parser", F.coalesce(second, first))
    status = F.when(F.col("parser") == "unknown", F.concat(F.lit("error: unsupported format "), "ext")).otherwise("success")
    return routed.withColumn("status", status).withColumn("char_count", F.length(F.coalesce("content", F.lit(""))).cast("long"))


def pipe_table(rows: Column) -> Column:
    """A Markdown table of an array of cell arrays, all padded to the widest; the first row is the header."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    drawn = F.transform(rows, lambda r: line(pad(r)))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(rule), F.slice(drawn, 2, 1 << 30)), "\n")


def rows_to_markdown(rows: DataFrame) -> DataFrame:
    """rows (doc_id, stem, sheet, sheet_no, row_no, cells) -> doc_id, content.

    Empty rows go. A row with its first cell only is a ``###`` heading and begins a new table; an empty sheet
    gets a placeholder.
    """
    cells = F.transform("cells", lambda c: F.coalesce(c, F.lit("")))
    full = rows.withColumn("cells", cells).withColumn("kept", F.exists("cells", lambda c: c != ""))
    head = (F.size("cells") > 0) & (F.get("cells", F.lit(0)) != "") & ~F.exists(F.slice("cells", 2, 1 << 30), lambda c: c != "")
    sheet = W.partitionBy("doc_id", "sheet_no").orderBy("row_no")
    marked = full.where("kept").withColumn("head", head).withColumn("part", F.sum(F.col("head").cast("int")).over(sheet))
    in_order = F.array_sort(F.collect_list(F.struct("row_no", "cells", "head")))
    parts = marked.groupBy("doc_id", "sheet_no", "part").agg(in_order.alias("rows"))
    title = F.regexp_replace(F.get("rows", F.lit(0))["cells"][0], "：+$", "")
    table = F.transform(F.filter("rows", lambda r: ~r["head"]), lambda r: r["cells"])
    heading = F.when(F.get("rows", F.lit(0))["head"], F.concat(F.lit("### "), F.regexp_replace(title, ":+$", ""), F.lit("\n")))
    drawn = parts.select("doc_id", "sheet_no", F.struct("part", F.concat_ws("\n", heading, F.when(F.size(table) > 0, F.concat(pipe_table(table), F.lit("\n")))).alias("md")).alias("p"))
    bodies = drawn.groupBy("doc_id", "sheet_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["md"]), "\n").alias("body"))
    sheets = rows.select("doc_id", "stem", "sheet", "sheet_no").distinct().join(bodies, ["doc_id", "sheet_no"], "left")
    text = F.concat(F.lit("## "), "sheet", F.lit("\n\n"), F.coalesce("body", F.lit("（空表）\n")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sheet_no", text.alias("text")))), lambda s: s["text"])
    out = sheets.groupBy("doc_id", "stem").agg(F.array_join(ordered, "\n").alias("text"))
    return out.select("doc_id", F.concat(F.lit("# "), "stem", F.lit("\n\n"), "text").alias("content"))


def heading_level(style: Column, outline: Column) -> Column:
    """Level by style name (its first digit, 1 without), else by outline level; 0 for running text; 6 at most."""
    digit = F.regexp_extract(style, r"(\d)", 1)
    by_style = F.when(digit == "", 1).otherwise(F.least(digit.cast("int"), F.lit(6)))
    return F.when(F.lower(style).rlike("^(heading|标题)"), by_style).when(outline.isNotNull(), F.least(outline + 1, F.lit(6))).otherwise(0)


def elements_to_markdown(elements: DataFrame) -> DataFrame:
    """elements (doc_id, seq, kind, style, outline_level, runs, rows) -> doc_id, content, in document order."""
    plain = F.trim(F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    star = lambda r: F.repeat(F.lit("*"), F.when(F.coalesce(r["bold"], F.lit(False)), 2).otherwise(0) + F.when(F.coalesce(r["italic"], F.lit(False)), 1).otherwise(0))
    rich = F.array_join(F.transform(F.filter("runs", lambda r: r["text"] != ""), lambda r: F.concat(star(r), r["text"], star(r))), "")
    level = heading_level(F.coalesce("style", F.lit("")), F.col("outline_level"))
    para = F.when(plain == "", None).when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), plain, F.lit("\n"))).otherwise(F.concat(rich, F.lit("\n")))
    filled = F.filter("rows", lambda r: F.exists(r, lambda c: F.trim(c) != ""))
    flat = F.transform(filled, lambda r: F.transform(r, lambda c: F.replace(c, F.lit("\n"), F.lit(" "))))
    table = F.when(F.size(flat) > 0, F.concat(pipe_table(flat), F.lit("\n")))
    drawn = elements.select("doc_id", F.struct("seq", F.when(F.col("kind") == "table", table).otherwise(para).alias("md")).alias("e")).where("e.md IS NOT NULL")
    ordered = F.transform(F.array_sort(F.collect_list("e")), lambda e: e["md"])
    return drawn.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("content"))


def media_inventory(files: DataFrame) -> DataFrame:
    """One row per media entry of each Office container: file, filename, ext, size, source; clashing names get a number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, content in zip(pdf["filename"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as box:
                        entries = sorted((i for i in box.infolist() if i.filename.startswith(("word/media/", "ppt/media/")) and not i.is_dir()), key=lambda i: i.filename)
                        rows += [(name, i.filename.rsplit("/", 1)[-1], i.file_size, i.filename) for i in entries]
                except (zipfile.BadZipFile, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["file", "name", "size", "source"])

    found = files.select("filename", "content").mapInPandas(run, "file string, name string, size long, source string")
    found = found.withColumn("ext", F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)))
    n = F.row_number().over(W.partitionBy("file", "name").orderBy("source")) - 1
    numbered = F.when(n > 0, F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_"), n, F.regexp_extract("name", r"(\.[^.]*)$", 1))).otherwise(F.col("name"))
    return found.select("file", numbered.alias("filename"), "ext", "size", "source")


def worth_keeping(media: DataFrame, least: int = 256) -> DataFrame:
    """media without the scraps of PDF pages: embedded images there below ``least`` bytes."""
    scrap = (F.lower("file_ext") == ".pdf") & (F.col("size") < least) & ~F.coalesce("is_page_render", F.lit(False))
    return media.where(~F.coalesce(scrap, F.lit(False)))


def image_only(files: DataFrame, media: DataFrame, short: int = 100) -> DataFrame:
    """file, n_media and image_only for files (file, file_ext, text): a PDF with a rendered page and fewer than ``short`` characters of text."""
    held = media.groupBy("file").agg(F.count(F.lit(1)).alias("n_media"), F.coalesce(F.bool_or("is_page_render"), F.lit(False)).alias("rendered"))
    both = files.join(held, "file", "left")
    text = F.length(F.trim(F.coalesce("text", F.lit(""))))
    flag = (F.lower("file_ext") == ".pdf") & F.coalesce("rendered", F.lit(False)) & (text < short)
    return both.select("file", F.coalesce("n_media", F.lit(0).cast("long")).alias("n_media"), F.coalesce(flag, F.lit(False)).alias("image_only"))


def caption_candidates(media: DataFrame, min_size: int = 8192, per_file: int = 5) -> DataFrame:
    """The largest images of each file that are worth a caption: file, filename, size, place."""
    fit = media.where((F.col("size") >= min_size) & ~F.coalesce("is_page_render", F.lit(False)) & ~F.col("ext").isin(*NO_CAPTION))
    place = F.row_number().over(W.partitionBy("file").orderBy(F.desc("size"), "filename"))
    return fit.select("file", "filename", "size", place.alias("place")).where(F.col("place") <= per_file)
