import collections
import random
import re

import numpy as np

from corpusloom.llm import quality_rules as q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {k for i, w in enumerate(windows) if w in often for k in range(i, i + 3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), failed


def test_base_features_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["a", "bb", "c#", "é", "x", "<b>", "日本", " ", "x"]
    texts = [None, "", " \n\t", "one", "a a a a", " x ", "a\n\na\na ", "\x0ba\x0cb\rc"]
    texts += ["".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "\t ", "  ", " "]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", q.F.lit("clash"))
    got = {r.doc_id: r for r in q.quality_scores(docs).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
        assert not (r.base_failed and r.kept)


CLEAN = "The quiet river ran past {} old houses, and nobody there could say how long it had. People liked it well enough."


def corpus(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    sentence = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    clean = [" ".join(sentence(rng.randint(5, 15)) for _ in range(12)) for _ in range(300)]
    symbols = [" ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in rng.choices(words, k=120)) for _ in range(30)]
    caps = [" ".join(w.upper() + "!!" for w in rng.choices(words, k=120)) for _ in range(30)]
    pipes = [" | ".join(rng.choices(words, k=120)) for _ in range(30)]
    rows = [(t, True) for t in clean] + [(t, False) for t in symbols + caps + pipes]
    return spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, good boolean")


def test_posterior_separates_damaged_texts(spark):
    docs = corpus(spark)
    wrong = q.quality_scores(docs).join(docs.select("doc_id", "good"), "doc_id").where("kept != good").count()
    assert wrong == 0


def test_filter_agrees_with_scores(spark):
    docs = corpus(spark).withColumn("__x", q.F.lit(1))
    kept = q.filter_quality(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in q.quality_scores(docs).where("kept").collect()}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert q.quality_scores(empty).count() == 0 and q.filter_quality(empty).count() == 0
    alone = spark.createDataFrame([(1, " ".join(CLEAN.format(i) for i in "abcdefg")), (1, None), (None, "x")], "doc_id long, text string")
    assert q.quality_scores(alone).count() == 3


def test_posterior_differs_from_all_must_pass_in_both_directions():
    rng = np.random.default_rng(5)
    good = rng.random(4000) < 0.8
    draw = lambda p_good, p_bad: np.where(good, rng.choice([-1, 0, 1], 4000, p=p_good), rng.choice([-1, 0, 1], 4000, p=p_bad))
    noisy = [draw((0.4, 0.6, 0.0), (0.4, 0.6, 0.0))]
    sound = [draw((0.01, 0.04, 0.95), (0.3, 0.65, 0.05)) for _ in range(5)]
    votes = np.stack([*noisy, *sound], axis=1)
    model = q.expectation_maximisation(votes, np.ones(len(votes)))

    def kept(pattern):
        return model.prior + sum(r[v + 1] for r, v in zip(model.ratios, pattern, strict=True)) >= 0

    assert kept((-1, 1, 1, 1, 1, 1))  # one unreliable rule is against it
    assert not kept((0, 0, 0, 0, 0, 0))  # no rule is against it, but those that speak for sound texts are silent
    right = sum(kept(v) == g for v, g in zip(votes.tolist(), good.tolist(), strict=True))
    passing = sum(bool((v >= 0).all()) == g for v, g in zip(votes, good.tolist(), strict=True))
    assert right > 3950 and right > passing + 500


def test_query_keeps_documents_that_a_rule_is_against(spark):
    from corpusloom.llm.registry import op1_quality_rules

    rows = op1_quality_rules(spark, "/root/testdata/sf0.01").select("kept", "against", "base_failed").collect()
    assert any(r.kept and r.against for r in rows) and not any(r.kept and r.base_failed for r in rows)


def test_patterns_pack_and_unpack(spark):
    votes = [(-1, 0, 1), (1, 1, 1), (0, -1, -1)]
    df = spark.createDataFrame(votes, "a int, b int, c int").withColumn("p", q.pattern_of([q.F.col(k) for k in "abc"]))
    got = df.select(*[v.cast("int").alias(k) for k, v in zip("abc", q.votes_of(q.F.col("p"), 3), strict=True)]).collect()
    assert [tuple(r) for r in got] == votes
