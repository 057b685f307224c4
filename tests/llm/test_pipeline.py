import random

import corpus_pipeline as c
from test_jaccard_join import brute
from test_quality_rules import base


def documents(spark, path):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(500)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(6, 14))).capitalize() + ". "
    clean = ["".join(sentence() for _ in range(14)).strip() for _ in range(80)]
    passage = "".join(sentence() for _ in range(7))
    # near copies without a run of 150 characters in common, which line dedup would cut out of all but the first
    brief = lambda: [["".join(rng.choices("abcdefghijklm", k=3)) + "." * (k % 11 == 10) for k in range(55)] for _ in range(6)]
    short = brief()
    first = [" ".join(w) for w in short]
    near = [" ".join("new" if k == 27 else x for k, x in enumerate(w)) for w in short]
    texts = clean[6:] + first + near + [t + " " + passage for t in clean[6:9]] + [clean[10]]
    texts += [" ".join(w + "###" for w in rng.choices(words, k=90)) for _ in range(8)] + ["too short", "", None]
    texts[0] += " password=abcdef123456"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return rows


def test_every_stage_and_the_whole(spark, tmp_path):
    rows = documents(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    outs = []
    for _, stage in c.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        outs.append(docs.collect())
        if len(outs) < len(c.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(outs[-1], docs.schema)
    kept = {r.doc_id for r in outs[0]}
    assert kept == {d for d, t, *_ in rows if not base(t)[-1] and "###" not in t}
    assert sum(len(r.text) for r in outs[1]) < sum(len(r.text) for r in outs[0]) and all(r.n_chars == len(r.text) for r in outs[1])
    found = brute([(r.doc_id, r.text) for r in outs[1]])
    assert {r.doc_id for r in outs[2]} == {d for d, (_, k) in found.items() if d == k} and len(outs[2]) == len(outs[1]) - 6
    assert not any("password=" in r.text for r in outs[3]) and any("<assign-secret>" in r.text for r in outs[3])
    tokens = {}
    for r in outs[4]:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens == {r.doc_id: -(-len(r.text) // 4) for r in outs[3]}
    whole = c.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, outs[4]))


def test_rows_without_id_stay(spark, tmp_path):
    rows = documents(spark, tmp_path)
    texts = [rows[20][1], rows[20][1].upper(), " ".join(rows[30][1].split()[::-1]), "", None]
    docs = spark.createDataFrame([(d, t, "en", "s", n) for d, t, _, _, n in rows[15:25]] + [(None, t, "en", "s", len(t or "")) for t in texts], spark.read.parquet(f"{tmp_path}/documents.parquet").schema)
    kept = c.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {*range(15, 25), None}
    assert sorted([r.text for r in kept if r.doc_id is None], key=str) == sorted(texts[2:], key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_any_column_names_and_a_very_long_text(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(5000)]
    prose = lambda n: " ".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(n // 9))
    texts = {1: prose(90), 2: prose(90), 3: prose(60_000)}
    rows = [(i, texts[i], "en", "s", len(texts[i]), "a", "b", "c", "d") for i in (1, 1, 2, 3)]
    names = "doc_id long, text string, lang string, source string, n_chars long, __line_id string, kept_id0 string, line_runs0 string, tile string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    packed = c.run(spark, str(tmp_path)).collect()
    tokens = {}
    for r in packed:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    quarter = lambda i: -(-len(texts[i]) // 4)
    assert tokens == {1: 2 * quarter(1), 2: quarter(2), 3: quarter(3)}  # rows that are the same stay or go together
