import random
import re

from corpusloom.llm import chat_format as c


def test_parse_levels():
    text = "Hi,\nOn Monday Ann wrote:\n> first\n> line\n>> deeper\n\nMy answer\n> > also deeper\nBye"
    body, quotes = c.parse(text)
    assert body == "Hi,\n\nMy answer\nBye"
    assert quotes == [(1, "first\nline"), (2, "deeper"), (2, "also deeper")]
    assert c.parse("a > b\nno quote") == ("a > b\nno quote", [])
    assert c.passage_hash("  A  b\n") == c.passage_hash("a B") and c.passage_hash(" \n") is None


ROWS = [
    ("x", 0, "user", "How do I do this?"), ("x", 1, "assistant", "Like so.\nIn two steps."), ("x", 2, "user", "> how do I DO this?\nAsking again."),
    ("x", 3, "assistant", "> In two steps.\n>> How do I do this?\nThen three."), ("x", 4, "user", "> never written\nok"), ("x", 6, "user", None),
    ("y", 0, "user", "> Like so.\nquoted from elsewhere"), (None, 1, "user", "lost"), ("x", 0, "user", "How do I do this?"), ("y", 1, "user", ""),
]


def test_links_and_threads(spark):
    messages = spark.createDataFrame([(*r, 7) for r in ROWS], "conv_id string, turn long, role string, text string, depth int").repartition(3)
    got = {(r.conv_id, r.turn): r for r in c.format_chat(messages).collect()}
    assert len(got) == 9
    links = {k: (r.reply_to, r.linked_by, r.depth) for k, r in got.items()}
    assert links["x", 0] == (None, None, 0) and links["x", 1] == (0, "turn", 1)
    assert links["x", 2] == (0, "quote", 1) and links["x", 3] == (1, "quote", 2) and links["x", 4] == (3, "turn", 3)
    assert links["x", 6] == (4, "turn", 4) and links["y", 0] == (None, None, 0) and links["y", 1] == (0, "turn", 1)
    assert links[None, 1] == (None, None, None)
    assert got["x", 3].text == "Then three." and got["x", 6].text == "" and got["x", 4].thread == 0
    assert c.format_chat(messages.limit(0)).count() == 0


def test_long_chain(spark):
    rows = [("c", i, "user", f"m{i}") for i in range(300)]
    got = c.format_chat(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.depth, r.thread) for r in got) == [(i, i, 0) for i in range(300)]


def test_render(spark):
    rows = [("c", 1, "assistant", "b"), ("c", 0, "user", "a")]
    chat = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    assert c.render(chat).first().text == "<|user|>\na\n<|assistant|>\nb\n"


def test_links_against_brute_force(spark):
    rng = random.Random(12)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(2, 12)):
            lines = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 3))]
            quotes = []
            for _ in range(rng.randint(0, 2)):
                source = rng.choice(said).split("\n") if said and rng.random() < 0.8 else [" ".join(rng.choices(words, k=3))]
                mark = ">" * rng.randint(1, 3) + " "
                quotes += [mark + x.upper() for x in source if not x.startswith(">")]
            text = "\n".join([*quotes, *lines])
            rows.append((conv, turn, "user", text))
            said.append(text)

    def normal(passage):
        return " ".join(passage.lower().split())

    def pieces(passage):
        return {normal(p): len(p.split()) for p in [passage, *re.split(r"\n\s*\n", passage), *passage.split("\n")] if normal(p)}

    parsed = {(conv, turn): c.parse(text) for conv, turn, _, text in rows}
    want = {}
    for (conv, turn), (_, quotes) in parsed.items():
        found = []
        for level, passage in quotes:
            for words_of, n in pieces(passage).items():
                first = min((t for (k, t), (body, _) in parsed.items() if k == conv and words_of in pieces(body)), default=turn)
                if first < turn:
                    found.append((level, -n, -first))
        want[conv, turn] = (-min(found)[2], "quote") if found else (turn - 1, "turn") if turn else (None, None)
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r.conv_id, r.turn): r for r in c.format_chat(messages).collect()}
    assert {k: (r.reply_to, r.linked_by) for k, r in got.items()} == want
    assert sum(v[1] == "quote" for v in want.values()) > 20
    for (conv, _), r in got.items():  # depth and thread follow the links up
        chain = [r]
        while chain[-1].reply_to is not None:
            chain.append(got[conv, chain[-1].reply_to])
        assert (r.depth, r.thread) == (len(chain) - 1, chain[-1].turn)


def test_very_long_message(spark):
    text = "\n".join(f"line {i}" for i in range(20_000))
    rows = [("c", 0, "user", text), ("c", 1, "user", "\n".join("> " + x for x in text.split("\n")) + "\nyes")]
    got = {r.turn: r for r in c.format_chat(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert (got[1].reply_to, got[1].linked_by, got[1].text) == (0, "quote", "yes") and got[0].text == text


def test_the_turn_before_is_the_last_that_there_is(spark):
    turns = [0, 1, 5, 4095, 4097, 9000, 20_000]
    rows = [(1, t, "user", f"words of {t}") for t in turns] + [(2, 3, "user", "alone"), (2, None, "user", "no turn"), (None, 4, "user", "no conversation"), (2, 9, None, None)]
    got = {(r.conv_id, r.turn): (r.reply_to, r.linked_by) for r in c.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t][0] for t in turns] == [None, *turns[:-1]]
    assert got[2, 9] == (3, "turn") and got[2, None] == (None, None) == got[None, 4] and len(got) == 11


def test_the_query_links_by_its_quotes(spark):
    from corpusloom.llm.registry import op6_chat_format

    rows = op6_chat_format(spark, "/root/testdata/sf0.001").collect()
    given = {(r.conv_id, r.turn): r for r in rows}
    quoting = [r for r in rows if r.conv_id < 0 and r.turn >= 2]
    assert quoting and all(r.linked_by == "quote" and r.n_quotes for r in quoting)
    for r in quoting:  # the quotes are gone, and what is left is the message itself
        assert (r.text or "").strip("\n") == (given[-1 - r.conv_id, r.turn].text or "").strip("\n")
        assert given[-1 - r.conv_id, r.reply_to].text == given[-1 - r.conv_id, r.turn - 2].text  # the one quoted, or an earlier one with the same words
    assert {r.linked_by for r in rows if r.conv_id >= 0} == {"turn", None}
    assert all(r.block == 0 and r.block_chars > 0 and len(r.block_sha256) == 64 for r in rows)


def test_render_in_blocks(spark):
    rows = [("c", t, None if t % 2 else "user", f"m{t}" if t % 5 else None) for t in range(600)] + [("d", None, "user", "x")]
    chat = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    line = lambda t: f"<|user|>\n{f'm{t}' if t % 5 else ''}\n"
    got = {(r.conv_id, r.block): r.text for r in c.render(chat).collect()}
    assert got == {**{("c", b): "".join(line(t) for t in range(256 * b, min(256 * b + 256, 600))) for b in range(3)}, ("d", None): "<|user|>\nx\n"}
