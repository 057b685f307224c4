"""Images of a trailing attachment section, moved to where the text speaks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.functions import text as T

#: What the attachment section, its note, figure numbers, pointers to drawings and case lines look like.
SECTION = r"(?s)(?:##\s+)?图片附件\s*\n.*?(?=\n##\s|\z)"
COUNT_NOTE = r"\n*本文件[共包含]*\s*\d+\s*[张个]图片[。，]?\s*\n*"
FIGURE, FIGURE_CN = r"图\s*(\d+)", rf"附图\s*([{T.CN}]+)"
POINTER = "参考大样图|参考图|示意图|见附图|详见附图|如下图所示"
CASE = rf"^情况[{T.CN}]+[：:]"
NEAR = 800  # characters behind a pointer in which its case lines lie

IMAGE_AT = "array<struct<line:int,turn:int,image:string>>"


def anchors(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, images, text): its lines, and which of them numbers figures, points at a drawing, is a case or a heading.

    Lines are numbered from 0 and have the place where they start, so that what lies near a pointer is found among case lines.
    """
    each = docs.select("doc_id", "images", F.posexplode(T.lines(F.col("text"))).alias("i", "line"))
    width = F.length("line") + 1
    each = each.withColumn("behind", F.sum(width).over(W.partitionBy("doc_id").orderBy("i"))).withColumn("start", F.col("behind") - width)
    some = lambda kept, *what: F.array_sort(F.collect_list(F.when(kept, F.struct("i", *what))))
    numbers = F.transform(F.regexp_extract_all("line", F.lit(FIGURE)), lambda x: x.try_cast("int"))
    numerals = F.regexp_extract_all("line", F.lit(FIGURE_CN))
    points = F.regexp_count("line", F.lit(POINTER))
    return each.groupBy("doc_id").agg(
        F.first("images").alias("images"), some(F.lit(True), "line").alias("lines"),
        some(F.size(numbers) > 0, numbers.alias("named")).alias("figures"), some(F.size(numerals) > 0, numerals.alias("named")).alias("figures_cn"),
        some(points > 0, points.alias("times"), "behind").alias("pointers"), some(F.col("line").rlike(CASE), "start").alias("cases"), some(F.col("line").rlike(r"^##[ \t]+\S")).alias("heads"),
    )


def _figure_lines(images: Column) -> Column:
    """For each image the first line that names it by number, or else by numeral; null where none does."""
    first = lambda found, name: F.get(F.filter(found, lambda f: F.array_contains(f["named"], name)), F.lit(0))["i"]
    numeral = lambda k: F.when(k < 10, F.substring(F.lit(T.CN), k + 1, F.lit(1))).otherwise("")
    return F.transform(images, lambda m, k: F.coalesce(first(F.col("figures"), k + 1), first(F.col("figures_cn"), numeral(k))))


def _pointer_lines(n_free: Column) -> Column:
    """The lines that take the free images one after the other: a pointer's case lines if there are images for all of them, else its own line."""
    near = lambda p: F.transform(F.filter("cases", lambda c: (c["start"] >= p["behind"]) & (c["start"] < p["behind"] + NEAR)), lambda c: c["i"])
    asked = F.flatten(F.transform("pointers", lambda p: F.array_repeat(F.struct(p["i"].alias("i"), near(p).alias("cases")), p["times"].cast("int"))))

    def take(taken: Column, p: Column) -> Column:
        left = n_free - F.size(taken)
        mine = F.when((F.size(p["cases"]) > 0) & (F.size(p["cases"]) <= left), p["cases"]).otherwise(F.array(p["i"]))
        return F.when(left > 0, F.concat(taken, mine)).otherwise(taken)

    return F.aggregate(asked, F.array().cast("array<int>"), take)


def _spliced(inserts: Column, rest: Column) -> Column:
    """The lines with each image behind its line; what is left without headings goes to the end."""
    last = F.size("lines") - 1

    def line(x: Column) -> Column:
        at_end = x["i"] == last
        here = F.transform(F.filter(inserts, lambda p: p["line"] == x["i"]), lambda p: F.struct(F.when(at_end, p["turn"]).otherwise(-p["turn"]).alias("turn"), p["image"].alias("image")))
        images = lambda found: F.array_join(F.transform(F.array_sort(found), lambda p: p["image"]), "\n")
        put = lambda found: F.when(F.size(found) == 0, x["line"]).when(at_end, F.concat(x["line"], images(found), F.lit("\n"))).otherwise(F.concat(x["line"], F.lit("\n"), images(found)))
        return T.let(here, put)

    text = F.array_join(F.transform("lines", line), "\n")
    return F.when(F.size(rest) > 0, F.concat(text, F.lit("\n\n"), F.array_join(rest, "\n"))).otherwise(text)


def embed_images_inline(docs: DataFrame) -> DataFrame:
    """docs (doc_id, content, ...) with the images of an attachment section moved to the text, and the section gone.

    An image goes behind the first line that names its number. The other images go, in order, to lines that point at a drawing: one to each mention, or one
    to each case line that begins within NEAR characters if there are enough. What is left goes round the ``##`` headings, or to the end. Places are those of the text
    without its attachments. Of several images behind one line those of headings come first, then of pointers, then of numbers, each in the order of
    their names; behind a last line the other way round. Texts without such images, null among them, stay as they are. doc_id is unique.
    """
    section = F.regexp_extract("content", SECTION, 0)
    images = F.transform(T.image_refs(section), lambda m: m["markdown"])
    has = F.coalesce(F.col("content").contains("图片附件") & (F.size(images) > 0), F.lit(False))
    text = F.regexp_replace(F.rtrim(F.regexp_replace("content", SECTION, ""), F.lit(T.WHITE)), COUNT_NOTE, "\n")
    some = docs.where(has)
    found = anchors(some.select("doc_id", images.alias("images"), text.alias("text"))).withColumn("figure_line", _figure_lines(F.col("images")))
    free = F.filter(F.sequence(F.lit(0), F.size("images") - 1), lambda k: F.get("figure_line", k).isNull())
    found = found.withColumn("free", free).withColumn("pointed", _pointer_lines(F.size("free"))).withColumn("rest", F.slice("free", F.size("pointed") + 1, F.greatest(F.size("free") - F.size("pointed"), F.lit(0))))
    place = lambda line, turn, k: F.struct(line.alias("line"), F.lit(turn).alias("turn"), F.get("images", k).alias("image"))
    named = F.filter(F.transform("figure_line", lambda line, k: place(line, 1, k)), lambda p: p["line"].isNotNull())
    pointed = F.transform("pointed", lambda line, f: place(line, 2, F.get("free", f)))
    heads = F.size("heads")
    around = F.when(heads > 0, F.transform("rest", lambda k, r: place(F.get("heads", F.pmod(r, heads))["i"], 3, k))).otherwise(F.array().cast(IMAGE_AT))
    left = F.when(heads > 0, F.array().cast("array<string>")).otherwise(F.transform("rest", lambda k: F.get("images", k)))
    made = found.select("doc_id", "lines", F.concat(named, pointed, around).alias("inserts"), left.alias("at_end"))
    made = made.select("doc_id", _spliced(F.col("inserts"), F.col("at_end")).alias("inlined"))
    moved = some.join(made, "doc_id").withColumn("content", F.col("inlined")).select(*docs.columns)
    return docs.where(~has).unionByName(moved)
