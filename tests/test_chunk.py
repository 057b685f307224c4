import random
import re

from corpusloom.operators import chunk as c
from pyspark.sql import functions as F

TABLE = "# doc\n| 户型 | 负荷 |\n| --- | --- |\n| a | 1 |\n| 住宅户内用电需要系数表： |  |\n| b | 2 |\n| 这是一个成都重庆昆明区域 |  |\n| d | 4 |\ntail"


def blocks(spark, expression, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, content string")
    return [(r.title, r.body) for r in c.explode_blocks(df, expression(F.col("content"))).orderBy("seq").collect()]


def parted(spark, text, **options):
    found = c.split_table_sections(spark.createDataFrame([(1, text)], "doc_id long, content string"), **options)
    return [(r.title, r.body) for r in found.orderBy("seq").collect()]


def test_brackets(spark):
    text = "lost 【 甲\n一 】 after\n【乙】\n![x](images/a.png)"
    assert blocks(spark, c.split_brackets, text) == [("甲", "甲\n一\nafter"), ("乙", "乙\n![x](images/a.png)")]


def test_headings(spark):
    text = "pre text\n# One\nbody\n## Two\nintro\n### Sub a\nx\n### Sub b\n3 / 4\n## Three\nnull\n#nospace"
    assert blocks(spark, c.split_headings, text) == [
        ("", "pre text"), ("# One", "body"), ("## Two", "intro"), ("## Two > ### Sub a", "x"), ("## Two > ### Sub b", ""), ("## Three", "null\n#nospace"),
    ]


def test_numbered_and_blank_lines(spark):
    assert blocks(spark, c.split_numbered, "start\n一、甲\nx\n1.2 乙\ny\n3 4 5") == [("", "start"), ("一、甲", "x"), ("1.2 乙", "y\n3 4 5")]
    assert blocks(spark, c.split_blank_lines, "a\n \nb\n\n1 / 2\n\n\nc") == [("", "a"), ("", "b"), ("", "c")]


def test_table_sections(spark):
    head = "| 户型 | 负荷 |\n"  # a rule row over several columns counts as data, one over a single column is repeated
    want = [("", "# doc\n\n" + head + "| --- | --- |\n| a | 1 |"), ("住宅户内用电需要系数表", head + "| b | 2 |"), ("住宅户内用电需要系数表-这是一个成都重庆昆明区域", head + "| d | 4 |")]
    assert parted(spark, TABLE) == want
    assert parted(spark, TABLE, keep_trailing=True) == [*want, ("", "tail")]
    single = "| 名称 |\n| --- |\n| a |\n| 住宅户内用电需要系数 |\n| b |"
    assert parted(spark, single) == [("", "| 名称 |\n| --- |\n| a |"), ("住宅户内用电需要系数", "| 名称 |\n| --- |\n| b |")]
    assert parted(spark, "just text") == [("", "just text")] and parted(spark, " \n") == [] == parted(spark, None)


def sections(text):
    """The rules line by line."""
    out, title, header, rule, lead, body = [], "", "", "", [], []
    noise = lambda t: t.strip() in ("", "null") or re.match(r"\|[\s\-|]+\|\s*$", t.strip())

    def close():
        if body and not noise("\n".join(body)):
            head = "\n".join(lead).strip()
            out.append((title, ("" if noise(head) else head + "\n\n") + "\n".join(body).strip()))
        return bool(body)

    for line in text.split("\n"):
        row = line.strip()
        cells = [x.strip() for x in row.split("|") if x.strip()]
        if row[:1] == "|" and len(row) > 2 and row.endswith("|") and set(row[1:-1]) <= set(" -:"):
            rule = line
            body.append(line)
        elif not row.startswith("|"):
            if close():
                title, lead = "", []
            body = []
            lead = [*lead, line]
        elif len(cells) == 1 and len(cells[0]) >= 10:
            if close():
                lead = []
            name = cells[0].rstrip("：").rstrip(":")
            title = f"{title}-{name}" if title and (name.endswith("区域") or len(name) <= 6) else name
            body = [x for x in (header, rule) if x]
        else:
            header = header or line
            body.append(line)
    close()
    return out or ([("", text.strip())] if text.strip() else [])


def test_table_sections_against_the_rules_line_by_line(spark):
    rng = random.Random(3)
    kinds = ["| a | b |", "| --- |", "| - | - |", "some text", "", "null", "| a title of a section |  |", "| the area in the 区域： |  |", "|  | short：：：：：： |", "| another title row: |", " | x | y |", "| :: |"]
    texts = {i: "\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 14))) for i in range(400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, content string").repartition(3)
    got = {}
    for r in sorted(c.split_table_sections(df).collect(), key=lambda r: (r.doc_id, r.seq)):
        got.setdefault(r.doc_id, []).append((r.title, r.body))
    assert {i: b for i, b in got.items()} == {i: b for i, t in texts.items() if (b := sections(t))}


def test_strategies(spark):
    texts = {"【a】【b】": "BRACKET", "【a】 ## x": "NL", TABLE: "TABLE", "a\n## b": "H2", "# only h1": "NL", "一、x": "CN+DIGIT", "1.1 x": "CN+DIGIT", "plain": "NL"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.s for r in df.select("t", c.choose_strategy(F.col("t")).alias("s")).collect()} == texts


def test_merges(spark):
    long = "x" * 60
    rows = [(1, 0, "", "short a"), (1, 1, "T", "short b"), (1, 2, "L", long), (1, 3, "", "null"), (1, 4, "E", "end"), (2, 0, "A", long), (2, 1, "B", "1、 item " + long), (2, 2, "C", "2) item " + long)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, title string, body string")
    short = sorted((r.doc_id, r.seq, r.title, r.body) for r in c.merge_short(df.where("doc_id = 1")).collect())
    assert short == [(1, 0, "T", "short a\n\nshort b"), (1, 2, "L", long), (1, 4, "E", "end")]
    items = [tuple(r) for r in c.merge_numbered_items(df.where("doc_id = 2")).collect()]
    assert items == [(2, 0, "A", f"{long}\n1、 item {long}\n2) item {long}")]


def test_documents_end_to_end(spark):
    long = "words that go on for a while, " * 4
    docs = [(1, "b", "f2.md", f"## A\n{long}![x](images/p.png)\n## B\n{long}"), (2, "a", "f1.md", f"{long}\n\n{long}y"), (3, "b", "f2.md", None)]
    df = spark.createDataFrame(docs, "doc_id long, category string, source_file string, content string")
    chunks = c.chunk_documents(df).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.doc_id, r.section_path, r.has_image, r.split_strategy) for r in chunks] == [
        (0, 2, "", False, "NL"), (1, 2, "", False, "NL"), (2, 1, "## A", True, "H2"), (3, 1, "## B", False, "H2"),
    ]
    assert chunks[2].content.startswith("## A\n\nwords") and chunks[2].image_ids == ["p.png"]
    assert chunks[2].enriched_content == chunks[2].content + "\n\n" + chunks[3].content[:200] and chunks[3].enriched_content is None


def test_index_is_dense_for_any_partitioning(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k")).repartition(9)
    rows = c.dense_index(df, ["k"], "n").collect()
    assert all(r.k == r.n for r in rows) and len(rows) == 500
    assert c.dense_index(df.limit(0), ["k"], "n").count() == 0
