import itertools
import random
import time

import numpy as np

from corpusloom.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class='cookie-notice'>We use cookies to make this
site much better for everyone.</div><!-- ad --><div class="ad">Buy now, this is a very good offer.</div>
<article><h1>The  title &amp; more</h1><p><b>Bold start of a paragraph<br><p>Second paragraph&nbsp;here,
over two lines.<ul><li>One</li><li>Two</li></ul><form><p>Your mail</p></form><aside>Read on</aside>
<section class="comments"><article><p>I think this is a long and wrong article.</p></article></section></article>
<div class=sidebar><p>Read also this very nice other article on our pages today.</p></div><footer>&copy; us</footer></body></html>"""


def test_article_without_the_rest():
    assert h.main_text(PAGE).split("\n") == ["The title & more", "Bold start of a paragraph", "Second paragraph here, over two lines.", "One", "Two"]


def test_page_without_article_element():
    body = "<p>" + "A long sentence that says a lot about its matter, and goes on. " * 3 + "</p>"
    page = f"<body><div class=menu><a href=/>Start</a> <a href=/b>Blog</a></div><div>{body}<p>Short.</p>{body}</div><div><a href=/x>more links</a></div></body>"
    assert len(h.main_text(page).split("\n")) == 3 and "Blog" not in h.main_text(page) and "more links" not in h.main_text(page)


def test_odd_input():
    for page in (None, "", "<", "<p", "text only, quite a bit of it, more than a few words.", "<script>x", "<!--", "</p></div>", "<a><b>", '<p title="a>b">x</p>'):
        assert isinstance(h.main_text(page), str)
    assert h.main_text("<article><p>" + "word " * 50_000 + "&am") == ("word " * 50_000 + "&am")
    assert h.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 7)
        source, sink = ([rng.choice([0, rng.random() * 3]) for _ in range(n)] for _ in range(2))
        edges = {(i, j): rng.random() * 2 for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def price(kept, source=source, sink=sink, edges=edges):
            cut = sum(w for (i, j), w in edges.items() if kept[i] != kept[j])
            return cut + sum(b if k else a for k, a, b in zip(kept, source, sink, strict=True))

        best = min(map(price, itertools.product([False, True], repeat=n)))
        assert abs(price(h.minimum_cut(source, sink, edges)) - best) < 1e-6


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (3, "v", "", None), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars, r.text == h.main_text(PAGE)) for r in h.extract(pages).collect())
    n = len(h.main_text(PAGE))
    assert got == [(1, n, True), (1, n, True), (2, 0, False), (3, 0, False)]
    assert h.extract(pages.limit(0)).count() == 0


def by_threshold(page):
    return [b.text for b in h.blocks_of(page) if (c := h.costs(b))[0] > c[1]]


def test_cut_mends_what_a_threshold_gets_wrong():
    long = "A long sentence that says a lot about its matter, and goes on and on. " * 3
    linked, plain = '<p><a href="/s">Source of the figures</a></p>', "<p>One plain sentence of middling length, here.</p>"
    content = f"<div><p>{long}</p><p>{long}</p>{linked}<p>{long}</p></div>"
    links = "".join(f'<p><a href="/{k}">Another page of ours, number {k}</a></p>' for k in range(4))
    page = f"<body>{content}<div>{links}{plain}{links}</div></body>"
    kept = h.main_text(page).split("\n")
    assert "Source of the figures" in kept and "Source of the figures" not in by_threshold(page)
    assert "One plain sentence of middling length, here." not in kept and "One plain sentence of middling length, here." in by_threshold(page)
    assert kept == [long.strip(), long.strip(), "Source of the figures", long.strip()]


def test_classifier_learns_from_the_pages():
    rng = random.Random(3)
    pages = []
    for _ in range(60):
        texts = "".join("<p>" + " ".join(["word"] * rng.randint(20, 80)) + ".</p>" for _ in range(5))
        menu = "".join(f"<li><a href=/{k}>word word</a></li>" for k in range(6))
        pages.append(f"<nav><ul>{menu}</ul></nav><article>{texts}</article><footer>word word</footer>")
    examples = np.array([e for page in pages for e in h.examples_of(page)])
    weights = h.taught(examples)
    right = ((examples[:, 1:] @ np.array(weights) > 0) == (examples[:, 0] > 0)).mean()
    assert right > 0.98 and weights != h.UNTAUGHT and h.taught(examples[:0]) == h.UNTAUGHT


def test_long_and_deep_pages_take_little_time():
    n = 5000
    mixed = "".join(f"<div>{'<b>x' * 2}</div><p><a href=/>l{k}</a><p>{'word ' * (k % 40)}" for k in range(n))
    began = time.perf_counter()
    for page in (mixed, "<div>" * n + "deep" + "</div>" * n, '<a href="x>' + "<p>it's" * n, "<article>" + mixed):
        assert isinstance(h.main_text(page), str)
    assert time.perf_counter() - began < 20


def test_clashing_column_names(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x")], "__html long, __page string, html string, text string")
    got = h.extract(pages, keep=("__html", "__page")).first()
    assert (got["__html"], got["__page"], got.text) == (1, "u", h.main_text(PAGE))


def test_sample_of_many_pages(spark):
    page = "<nav><a href=/>Home</a></nav><article><p>" + "word " * 30 + ".</p></article>"
    pages = spark.range(500).selectExpr("id AS page_id", "'u' AS url", f"'{page}' AS html")
    assert h.learn(pages, sample_pages=20, by=("page_id",)) != h.UNTAUGHT
    assert h.extract(pages, sample_pages=20).where("n_chars = 0").count() == 0
