import random
import zlib

import numpy as np
from corpusloom.llm import lang_id as g

WORDS = {"en": "the of and to in that was his with for", "de": "der die und in den von zu das mit sich", "fr": "de la le et les des en un du une"}


def corpus(n=300):
    rng = random.Random(6)
    return [(i, " ".join(rng.choices(WORDS[lang].split(), k=25)), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    rows = g.identify(docs).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 30 and all(r.lang_pred == r.lang for r in held) and all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_teach_nothing(spark):
    rows = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 5 == 0 else lang) for d, t, lang in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert g.identify(docs).where("lang_pred = 'xx'").count() == 0


def test_edges(spark):
    rows = [*corpus(60), (900, None, "en"), (901, "", "en"), (902, "123 !?", None), (903, "the of and", None), (904, "THE OF AND " * 20_000, None), (903, "the of and", None), (None, "der und", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in g.identify(docs).collect()}
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (900, 901, 902))
    assert got[903].lang_pred == got[904].lang_pred == "en" and got[None].lang_pred == "de" and got[None].held_out is False
    assert g.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in g.identify(docs.where("lang IS NULL")).collect()} == {"und"}


def test_vectors_follow_the_definition():
    codes, counts = g.trigrams("abba")
    points = {c: g.letter_vectors(np.array([c]))[0] for c in (32, ord("a"), ord("b"))}
    total = sum(np.roll(points[x], 2) * np.roll(points[y], 1) * points[z] for x, y, z in [(32, 97, 98), (97, 98, 98), (98, 98, 97), (98, 97, 32)])
    assert (counts @ g.bind(codes) == total).all()
    small = g.Vectors(limit=3)
    assert all((small.of(codes) == g.bind(codes)).all() for _ in range(3))


def test_marks_alone_are_no_letters():
    assert g.trigrams("\u0301\u0300 12 \u0e49") is None and g.trigrams("e\u0301") is not None
