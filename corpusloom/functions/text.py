"""Text predicates, classifiers and clean-ups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels, keyword lists and stop words that results depend on. All are default arguments.
IMAGE_TEXT, MAIN_TABLE, SUB_TABLE, RULE, PLAIN = "图片描述", "参数表", "副表", "设计规则", "说明文本"
IMAGE_WORDS = "GLM-5V-Turbo|通过.*视觉模型.*描述|图片附件"
RULE_WORDS = (
    "不应|不得|严禁|禁止|禁用|慎用|切勿|务必|必须|应按|应设|应采用|应配置|宜[^用]|不宜|优先执行|参照执行|按.*标准执行|配置标准|原则上"
)
SECTION_WORDS = "总则|适用范围|编制说明|前言|编制目的|使用说明|原则|依据|引用|术语|目录"
CN = "一二三四五六七八九十"
ANSWER_STOP_WORDS = (
    "的 是 在 有 和 与 不 了 就 也 都 要 把 被 让 从 到 对 为 以 及 或 等 而 且 但 所 其 之 则 将 已 还 又 再 才 只 可 "
    "怎么 如何 什么 哪些 为什么 吗 呢 吧 啊 哦 嗯 有没有 没有 是否 是不是 能不能 可不可以 请问 这个 那个 哪个 一下 我 你 可以 需要 应该 怎样 "
    "什么样 参考 图片 附图 大样 大样图 标准 取值 要求 规范 规定 做法 尺寸 麻烦 帮忙 告诉 说明 解释 介绍 了解 系统 设计"
).split()
QUERY_STOP_WORDS = (
    "怎么 如何 什么 哪些 为什么 这个 那个 一下 吗 呢 吧 系统 设计 要求 标准 规范 规定 做法 配置 考虑 应 宜 可 不应 不宜 不得 是否 怎样 什么样 如何设计"
).split()
TOKEN = r"[\p{L}\p{N}]+"
BETWEEN = "\u0001"  # parts tokens in one string; no token holds it
IMAGE = r"!\[([^\]]*)\]\(images/([^)]+)\)"


#: Fixed value: all characters with the Unicode property White_Space.
WHITE = "\t\n\u000b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for each row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def py_strip(c: Column) -> Column:
    """Without white space of any kind at both ends; ``trim`` removes spaces only."""
    return F.btrim(c, F.lit(WHITE))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def is_toc_block(text: Column) -> Column:
    """At least three lines with text, 60 % of which look like ``1.2 title 34``."""

    def listed(filled: Column) -> Column:
        entries = F.filter(filled, lambda x: x.rlike(r"(?U)^\d+(\.\d+)*\s+\S.*\d{1,3}$"))
        return (F.size(filled) >= 3) & (F.size(entries) >= F.size(filled) * F.lit(0.6))

    return let(F.filter(F.transform(lines(text), py_strip), lambda x: x != ""), listed)


#: What page numbers, dot lines, extraction notes, rendered pages and rule rows look like.
NOISE = (
    r"\d+\s*/\s*\d+$", r"第\d+页\s*/\s*第\d+页$", "null$", r"[.\s·•\-—]+$", r"本文件(共)?提取\s*\d+\s*[张个]", r"!\[.*render\.png\]", r"\|[\s\-|]+\|\s*$"
)


def is_noise(text: Column) -> Column:
    """Page numbers, dot lines, contents pages and the like; null counts as empty, and empty text is noise."""

    def noise(t: Column) -> Column:
        short = (F.length(t) < 30) & t.rlike(r"(?U)^#{1,3}\s*图片") | (F.length(t) < 25) & t.rlike(r"(?U)^第\d+页")
        toc = t.contains("\n") & is_toc_block(t)
        return (t == "") | t.contains("....") | t.rlike(f"(?U)^(?:{'|'.join(NOISE)})") | short | toc

    return let(py_strip(F.coalesce(text, F.lit(""))), noise)


def image_refs(text: Column) -> Column:
    """description, path and markdown of every image reference, in order."""
    parts = [F.regexp_extract_all(text, F.lit(IMAGE), F.lit(k)) for k in (1, 2, 0)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("description", "path", "markdown"), strict=True)])
    return F.transform(zipped, lambda z: F.struct(z["description"].alias("description"), z["path"].alias("path"), z["markdown"].alias("markdown")))


def image_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IMAGE), F.lit(2))


def detect_section(text: Column, words: str = SECTION_WORDS) -> Column:
    """The first line if it is a heading of one of the known forms, else null."""
    #: The forms of headings, and what headings never hold.
    forms = [
        r"##[ \t]+.+$", r"###[ \t]+.+$", rf"[{CN}]+、[ \t]*.+$", rf"第[{CN}百\d]+章[ \t]*.+$", rf"[{CN}]+[ \t]{{1,5}}[^\d\s].{{1,40}}$",
        r"[0-9]+(\.[0-9]+)*[ \t]+.+$", rf"({words})$",
    ]
    bad = r"图片描述|第\s*\d+\s*页|render|page\d+|\.\.\.\."
    heading = lambda first: F.when(first.rlike(f"(?U)^(?:{'|'.join(forms)})") & ~first.rlike(bad), first)
    return let(py_strip(F.element_at(lines(text), 1)), heading)


def classify_content(text: Column, image_words: str = IMAGE_WORDS, rule_words: str = RULE_WORDS) -> Column:
    """One of five labels: image description, main table, sub-table, design rule or plain text."""

    def table(rows: Column) -> Column:
        """The label of a table, else null. ``rows``: the lines of the text."""
        count = lambda test: F.size(F.filter(rows, test))
        piped = count(lambda x: x.contains("|") & (F.length(py_strip(x)) > 5))
        pairs = count(lambda x: (x.contains(":") | x.contains("：")) & py_strip(x).rlike(r"^[^\s：:]+\s*[：:]\s*\S"))
        with_word = lambda word: count(lambda x: x.contains("|") & x.contains(word))
        found = (piped >= 2) | (count(lambda x: x.contains("\t")) >= 2) | (pairs >= 4) | text.contains("#DIV/0!") | text.contains("#REF!")
        return F.when(found, F.when(with_word("（含）") > with_word("（不含）"), SUB_TABLE).otherwise(MAIN_TABLE))

    label = F.when(text.rlike(image_words), IMAGE_TEXT).otherwise(let(lines(py_strip(text)), table))
    return F.coalesce(label, F.when(text.rlike(rule_words), RULE).otherwise(PLAIN))


def strip_tables(text: Column) -> Column:
    """Without pipe tables and the blank lines after them; three line ends or more become two.

    Blank and piped lines go if the last line before them that is neither, or is a row, is a row. The rows in front of
    that line are known from the rows' and the plain lines' numbers, so each line is looked at once.
    """

    def without(rows: Column) -> Column:
        kind = F.transform(rows, lambda x: let(py_strip(x), lambda t: F.when(t.startswith("|") & F.substring(t, 2, 1 << 30).contains("|"), 2).when((t == "") | t.startswith("|"), 1).otherwise(0)))
        return F.array_join(let(kind, lambda k: F.transform(F.filter(F.arrays_zip(rows.alias("line"), _inside(k).alias("gone")), lambda z: ~z["gone"]), lambda z: z["line"])), "\n")

    kept = F.when(text.contains("|"), let(lines(text), without)).otherwise(text)
    return F.regexp_replace(py_strip(kept), r"\n{3,}", "\n\n")


def _inside(kinds: Column) -> Column:
    """For each line whether it belongs to a table; kinds: 2 a row, 1 blank or piped, 0 other."""
    code = F.array_join(F.transform(kinds, lambda k: k.cast("string")), "")
    runs = F.regexp_extract_all(code, F.lit("2[12]*|0[01]*|1+"), F.lit(0))  # a row and what follows it, or what is outside
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r.startswith("2"), F.length(r))))


def strip_strikethrough(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)~~(.+?)~~", "$1")


def normalize_tildes(c: Column) -> Column:
    return F.translate(c, "～~", "--")


def images_to_placeholder(c: Column) -> Column:
    return F.regexp_replace(c, r"!\[([^\]]*)\]\(images/[^)]+\)", "【附图：$1】")


def quote_path(c: Column) -> Column:
    """Percent-encoded, slashes kept."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def rewrite_image_urls(text: Column, category: Column) -> Column:
    """Image links under /api/images/{category}/, percent-encoded."""
    link = r"\]\(images/([^)]+)\)"
    gaps = F.split(text, link, -1)
    links = F.concat(F.transform(F.regexp_extract_all(text, F.lit(link), F.lit(1)), lambda p: F.concat(F.lit("](/api/images/"), quote_path(category), F.lit("/"), quote_path(p), F.lit(")"))), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, links, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def desensitize(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements, longest pattern first, each on the result of the one before."""
    for old, new in sorted(rules, key=lambda r: -len(r[0])):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def normalize_dirname(c: Column, rules: list[tuple[str, str]] = ()) -> Column:
    c = F.regexp_replace(desensitize(c, list(rules)), "[★☆（）【】《》]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", "_"), "_+", "_")
    c = F.regexp_replace(c, r"^[_.]+|[_.]+$", "")
    return F.when(c == "", "document").otherwise(c)


def tokenize(c: Column) -> Column:
    """Runs of letters and digits, case kept."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))


def content_tokens(c: Column, stop: list[str] = ANSWER_STOP_WORDS) -> Column:
    """Tokens of two characters or more that are no stop words, in order of first use."""
    stops = F.array(*[F.lit(s) for s in stop])
    return F.array_distinct(F.filter(tokenize(c), lambda x: (F.length(x) >= 2) & ~F.array_contains(stops, x)))


def embed_text(content_type: Column, section: Column, source: Column, body: Column) -> Column:
    """What is embedded for a chunk: type, section and source in front of the body, parts left out when empty."""
    e = lambda c: F.coalesce(c, F.lit(""))
    label = F.when(e(content_type) != "", F.concat(content_type, F.lit("："))).otherwise("")
    name = F.replace(e(source), F.lit(".md"), F.lit(""))
    return F.concat(label, e(section), F.when(name != "", F.concat(F.lit(" | 来源: "), name)).otherwise(""), F.lit("\n\n"), e(body))
