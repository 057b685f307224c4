import random
import re

from corpusloom.llm import line_dedup as d
from pyspark.sql import functions as F


def sentence(rng, n=9):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n)) + ". "


def brute(rows, shortest=4, min_chars=150):
    """Lines of runs that an earlier place has too, counting only runs of at least ``shortest`` lines."""
    cut = {k: re.split(r"(?<=\n)|(?<=[.!?] )", t) for k, t in rows}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r")
    places = {}
    for k in sorted(cut):
        for i in range(len(cut[k]) - shortest + 1):
            places.setdefault(tuple(map(key, cut[k][i : i + shortest])), []).append((k, i))
    gone = {}
    for found in places.values():
        for k, i in found[1:]:
            gone.setdefault(k, set()).update(range(i, i + shortest))
    return gone


def test_shared_passages_go_but_for_the_first(spark):
    rng = random.Random(3)
    passage = [sentence(rng) for _ in range(6)]
    rows = []
    for k in range(40):
        own = [sentence(rng) for _ in range(10)]
        if k % 3:
            at = rng.randint(0, 10)
            own[at:at] = passage
        rows.append((k, "".join(own).replace(". ", ".\n", 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert want and 1 not in want
    out = {r.doc_id: r.text for r in d.line_dedup(docs).collect()}
    assert len(out) == 40 and sum("".join(passage)[30:80] in t.replace("\n", " ") for t in out.values()) == 1
    for k, t in rows:  # what repeats goes, and nothing else
        lines = re.split(r"(?<=\n)|(?<=[.!?] )", t)
        assert out[k] == "".join(x for i, x in enumerate(lines) if i not in want.get(k, ()))


def test_copies_repeats_and_edges(spark):
    rng = random.Random(5)
    text = "".join(sentence(rng) for _ in range(8))
    short = "Yes. No. Yes. No. "
    rows = [(5, text), (2, text), (9, text + text), (7, None), (8, ""), (None, text), (11, short), (12, short), (13, "one line only"), (14, text.replace(". ", ".\u0001 "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pos", F.lit("x"))
    out = d.line_dedup(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[2] == text and got[5] == "" and got[9] == "" and got[7] is None and got[8] == "" and got[None] == text
    assert got[11] == short and got[12] == short and got[13] == "one line only"
    assert d.line_dedup(docs.limit(0)).count() == 0


def test_lines_join_to_the_text(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab.!? \n\t\u0001é", k=rng.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    bad = docs.select("text", d.units_of(F.col("text")).alias("l")).where(F.array_join("l", "") != F.col("text")).count()
    assert bad == 0


def test_passages_pasted_mid_sentence(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    rows, pasted = [], []
    for k in range(40):
        n = rng.randint(51, 90)
        passage = [word() for _ in range(n)]
        if k % 2:  # one to three whole sentences within, else one long line
            for at in sorted(rng.sample(range(5, n - 5), 3)):
                passage[at] += "."
        for doc in (k, 100 + k):
            before, after = ([word() for _ in range(rng.randint(20, 70))] for _ in range(2))
            rows.append((doc, " ".join([*before, *passage, *after]) + "."))
            pasted.append((doc, before, after))
    out = {r.doc_id: r.text for r in d.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, before, after in pasted:
        assert out[doc] == (dict(rows)[doc] if doc < 100 else " ".join([*before, *after]) + ".")


def test_one_id_with_different_texts(spark):
    rng = random.Random(6)
    p, q, a, b = ("".join(sentence(rng) for _ in range(6)) for _ in range(4))
    docs = spark.createDataFrame([(1, p), (2, q), (5, p + a), (5, b + q), (5, b + q)], "doc_id long, text string")
    assert sorted(r.text for r in d.line_dedup(docs).collect()) == sorted([p, q, a, b, b])


def test_very_long_text(spark):
    rng = random.Random(9)
    passage = "".join(sentence(rng) for _ in range(8))
    text = "".join(sentence(rng) for _ in range(20_000))
    docs = spark.createDataFrame([(1, passage), (2, text + passage + "the " * 50_000)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in d.line_dedup(docs).collect()}
    assert out[1] == passage and out[2].startswith(text) and passage not in out[2] and len(out[2]) < len(text) + 1000


def test_any_column_names(spark):
    passage = " ".join(f"Sentence number {w} of the passage is in both texts." for w in "one two three four five six seven eight nine".split())
    docs = spark.createDataFrame([(1, f"{passage} First.", "a", "b", "c"), (2, f"Second. {passage}", "a", "b", "d")], "doc_id long, text string, line_id0 string, __line_id string, LINE_RUNS0 string")
    cut = d.line_dedup(docs)
    assert cut.columns == docs.columns
    assert {r.doc_id: passage in r.text for r in cut.collect()} == {1: True, 2: False}


def test_no_repeated_passage_of_the_given_table_is_left_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.collect()}
    left = {r.doc_id: " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in d.line_dedup(docs).collect()}
    earlier, runs, kept = set(), 0, 0
    for doc in sorted(words):
        w = words[doc]
        windows = [" ".join(w[i : i + 51]) for i in range(len(w) - 50)]
        start = None
        for i, known in enumerate([*(x in earlier for x in windows), False]):
            if known and start is None:
                start = i
            elif not known and start is not None:
                runs, kept, start = runs + 1, kept + (" ".join(w[start : i + 50]) in left[doc]), None
        earlier.update(windows)
    assert runs > 150 and kept == 0


def test_an_early_text_that_many_repeat(spark):
    rng = random.Random(34)
    passage = "".join(sentence(rng) for _ in range(6))
    own = {k: sentence(rng) for k in range(1, 700)}
    docs = spark.createDataFrame([(0, passage), *((k, own[k] + passage) for k in own)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in d.line_dedup(docs).collect()}
    assert out.pop(0) == passage and out == own


def test_few_shorter_runs_of_the_given_table_are_left_whole(spark):
    """Runs of 16 words or more and 150 characters or more; with fingerprints of two units 22 were left whole."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.collect()}
    left = {r.doc_id: " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in d.line_dedup(docs).collect()}
    earlier, runs = set(), []
    for doc in sorted(words):
        w, start = words[doc], None
        windows = [" ".join(w[i : i + 16]) for i in range(len(w) - 15)]
        for i, known in enumerate([*(x in earlier for x in windows), False]):
            if known and start is None:
                start = i
            elif not known and start is not None:
                runs.append((doc, " ".join(w[start : i + 15])))
                start = None
        earlier.update(windows)
    runs = [(doc, run) for doc, run in runs if len(run) >= 150]
    assert len(runs) > 400 and sum(run in left[doc] for doc, run in runs) < 15


def test_copies_of_texts_of_few_units(spark):
    texts = [" ".join("x" * 70 + f"{n}{k}." for k in range(n)) for n in (2, 3, 4)]
    docs = spark.createDataFrame([(10 * i + k, x) for i, x in enumerate(texts) for k in (0, 1)], "doc_id long, text string").where("length(text) >= 150 OR doc_id < 10")
    out = {r.doc_id: r.text for r in d.line_dedup(docs).collect()}
    assert out == {0: texts[0], 1: texts[0] if len(texts[0]) < 150 else "", 10: texts[1], 11: "", 20: texts[2], 21: ""}
