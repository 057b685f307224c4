import random

import pytest
from corpusloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("byte_bpe_50k.json")
CASES = [
    "", " ", "a", "a  b", "it's we'll I'M x're 'v 'l!'s", "\n\n x\n", "naïve café été größe", "日本語 テスト", "a\x1c\x1d b",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c<|endoftext", " 　 x", "\x85b", "\x00\x01", "1234 5678ab", "a" * 5000, " " * 3000 + "x",
    "=" * 1000 + "-" * 777, "ab" * 4000, "🤖🤖 👩‍👩‍👧 é", "﻿x�",
]


@pytest.fixture(scope="module")
def pair():
    return bpe.Transducer(PATH), tokenizers.Tokenizer.from_file(PATH)


def ids(machine, text):
    return bpe.np.frombuffer(machine.encode(text), "<i4").tolist()


@pytest.mark.parametrize("text", CASES)
def test_same_as_library(pair, text):
    machine, library = pair
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(machine, text) == want
    assert machine.decode(bpe.np.array(want, "i4")) == library.decode(want, skip_special_tokens=False)


def test_random_texts(pair):
    machine, library = pair
    rng = random.Random(7)
    alphabet = "aabcdeé ß  \n\t.,'!?-=0123日🤖 sSnth"
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 200)))
        assert ids(machine, text) == library.encode(text, add_special_tokens=False).ids


def test_slices_do_not_show(pair, monkeypatch):
    machine, _ = pair
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab're  \n'l1.", k=400)) for _ in range(60)]
    whole = [ids(machine, t) for t in texts]
    monkeypatch.setattr(bpe, "SLICE", 7)
    assert [ids(machine, t) for t in texts] == whole


def test_stream_keeps_a_window(pair):
    machine, library = pair
    text = "".join(random.Random(5).choices("abcdeo", k=20_000))
    assert list(machine.stream(text[k : k + 300].encode() for k in range(0, len(text), 300))) == library.encode(text).ids


def test_bytes_that_are_no_text(pair):
    machine, library = pair
    for tokens in ([223], [136, 64], [64, 136], list(range(0, 256))):
        assert machine.decode(bpe.np.array(tokens, "i4")) == library.decode(tokens, skip_special_tokens=False)


def test_rows(spark):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (1, "hello world", "x"), (None, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in out) == [(0, 1, "q"), (1, 2, "hello world"), (1, 2, "hello world"), (2, 0, ""), (3, 0, "")]
    assert bpe.encode(docs.limit(0), PATH).count() == 0
