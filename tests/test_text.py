import random
import tracemalloc

import pyarrow as pa
import pytest
from corpusloom.functions import helpers
from corpusloom.functions import text as T
from corpusloom.operators import inline
from pyspark.sql import functions as F


def values(spark, expression, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    return [r.v for r in df.select("id", expression(F.col("x")).alias("v")).orderBy("id").collect()]


NOISE = [
    (None, True), ("", True), (" 　", True), ("3 / 10", True), ("3 of 10", False), ("第3页/第9页", True), ("第3页 共9页", True), ("第3页" + "长" * 30, False),
    ("null", True), ("nullable", False), ("· · —", True), ("- a", False), ("本文件共提取 3 张图", True), ("### 图片描述", True), ("### 图片" + "长" * 40, False),
    ("![a](x/render.png)", False), ("![page 3 render.png](images/a.png)", True), ("![a](x/other.png)", False), ("title .... 3", True), ("| --- | --- |", True), ("| a | --- |", False),
    ("1.1 a 3\n1.2 b 4\n2 c 12", True), ("1.1 a 3\n1.2 b 4", False),
]


def test_noise(spark):
    assert values(spark, T.is_noise, [t for t, _ in NOISE]) == [e for _, e in NOISE]


def test_sections(spark):
    texts = ["## A b\nx", "### C", "一、总体要求", "第三章 供电", "二 供配电系统", "1.2.3 title", "总则", "plain", "## render.png", "## x....", "#### d", None]
    want = ["## A b", "### C", "一、总体要求", "第三章 供电", "二 供配电系统", "1.2.3 title", "总则", None, None, None, None, None]
    assert values(spark, T.detect_section, texts) == want


def test_content_types(spark):
    texts = [
        "| a | b |\n| c | d |", "a\tb\nc\td", "k: v\nl: w\nm：x\nn: y", "see #REF!", "| （含） | a |\n| （含） | b |\n| （不含） | c |", "灯具不应外露", "图片附件 x", "plain words", "| a |\nb",
    ]
    assert values(spark, T.classify_content, texts) == [T.MAIN_TABLE, T.MAIN_TABLE, T.MAIN_TABLE, T.MAIN_TABLE, T.SUB_TABLE, T.RULE, T.IMAGE_TEXT, T.PLAIN, T.PLAIN]


def test_clean_ups(spark):
    assert values(spark, T.strip_tables, ["a\n| x | y |\n\n| z |\n\nb\n\n\n\nc", "no table", "| a | b |"]) == ["a\nb\n\nc", "no table", ""]
    assert values(spark, T.strip_strikethrough, ["~~a\nb~~ c ~~d"]) == ["a\nb c ~~d"]
    assert values(spark, T.normalize_tildes, ["2~3～4"]) == ["2-3-4"]
    assert values(spark, T.images_to_placeholder, ["x ![图 a](images/b/c.png) y"]) == ["x 【附图：图 a】 y"]
    assert values(spark, lambda c: T.rewrite_image_urls(c, F.lit("强 电")), ["![a](images/b c/图.png) and ![d](images/e*.png)", "none"]) == [
        "![a](/api/images/%E5%BC%BA%20%E7%94%B5/b%20c/%E5%9B%BE.png) and ![d](/api/images/%E5%BC%BA%20%E7%94%B5/e%2A.png)", "none",
    ]
    assert values(spark, lambda c: T.desensitize(c, [("ab", "X"), ("abc", "ab")]), ["abc ab"]) == ["X X"]
    assert values(spark, T.normalize_dirname, ["★a （b）  c__.", "【】", "x.md"]) == ["a_b_c", "document", "x.md"]


def test_tokens_and_embedding_text(spark):
    assert values(spark, lambda c: T.content_tokens(c, ["the"]), ["the cat a cat sat", None]) == [["cat", "sat"], []]
    assert values(spark, lambda c: helpers.dictionary_tokens(c, ["电涌保护器", "保护"]), ["电涌保护器SPD怎么保护", None]) == [["电涌保护器", "SPD", "怎", "么", "保护"], []]
    assert values(spark, lambda c: T.embed_text(F.lit("t"), F.lit(""), F.lit("f.md"), c), ["b"]) == ["t： | 来源: f\n\nb"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("no images", "no images"),
        ("见图 2 处\n续\n\n图片附件\n![a](images/1.png)\n![b](images/2.png)", "见图 2 处\n![b](images/2.png)\n续\n\n![a](images/1.png)"),
        ("附图一\n图片附件\n![a](images/1.png)", "附图一![a](images/1.png)\n"),
        ("参考图\n情况一：x\n情况二：y\n图片附件\n![a](images/1.png)\n![b](images/2.png)", "参考图\n情况一：x\n![a](images/1.png)\n情况二：y![b](images/2.png)\n"),
        ("## A\nx\n## B\ny\n图片附件\n![a](images/1.png)\n![b](images/2.png)\n![c](images/3.png)", "## A\n![a](images/1.png)\n![c](images/3.png)\nx\n## B\n![b](images/2.png)\ny"),
    ],
)
def test_inline_images(spark, text, want):
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "图片附件\nno image", "z")], "doc_id long, content string, lines string")
    got = {r.doc_id: (r.content, r["lines"]) for r in inline.embed_images_inline(docs).collect()}
    assert got == {1: (want, "x"), 2: (None, "y"), 3: ("图片附件\nno image", "z")}


def test_hashed_vectors_are_unit_and_stable(spark):
    rows = values(spark, lambda c: helpers.embed(c, 32), ["some text", "some text", "other", "", None])
    assert rows[0] == rows[1] != rows[2] and abs(sum(x * x for x in rows[0]) - 1) < 1e-5 and not any(rows[3]) and not any(rows[4])


def test_the_likeliest_cut_against_all_cuts():
    rng = random.Random(1)
    for _ in range(300):
        costs = {"".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 3))): rng.choice([0.5, 1.0, 2.0, 3.5]) for _ in range(rng.randint(0, 8))}
        run = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 8)))
        ways = []
        for bits in range(1 << len(run) - 1):
            ends = [i + 1 for i in range(len(run) - 1) if bits >> i & 1] + [len(run)]
            words = [run[a:b] for a, b in zip([0, *ends], ends)]
            each = [costs.get(w, 4.0 if len(w) == 1 else None) for w in words]
            if None not in each:
                ways.append((round(sum(each), 6), len(words), [-len(w) for w in words], words))
        assert helpers.best_path(run, costs, max(map(len, costs), default=1), 4.0) == min(ways)[3]


def test_overlapping_words(spark):
    cut = lambda c: helpers.weighted_tokens(c, {"配电": 40, "系统照明": 50, "配电系统": 10, "照明": 5})
    assert values(spark, cut, ["配电系统照明 SPD x_1 配电箱", None, ""]) == [["配电", "系统照明", "SPD", "x", "1", "配电", "箱"], [], []]


def test_tokens_of_few_texts_are_held_at_a_time():
    rng = random.Random(3)
    words = ["cable", "größe", "x_1", "配电系统照明", "size"]
    texts = pa.array([None, "", " _ "] + [" ".join(rng.choices(words, k=4000)) for _ in range(512)])
    pieces = []
    tracemalloc.start()
    made = helpers.joined_tokens(texts, lambda run: pieces.append(run) or [run[:4], run[4:]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6  # as lists, all tokens of these texts took 136 MB
    assert made[:3].to_pylist() == [None] * 3 and pieces == ["配电系统照明"]
    spaced = texts[3].as_py().replace("x_1", "x 1").replace("配电系统照明", "配电系统 照明")
    assert made[3].as_py().split(T.BETWEEN) == spaced.split(" ")
