import hashlib
import random
import string

from corpusloom.llm.exact_dedup import exact_dedup


def expected(rows):
    norm = lambda t: (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    best = {k: max(v) for k, v in groups.items()}
    return sorted((d, best[norm(t)], len(groups[norm(t)]), d == best[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows)


def test_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, "A b", "a B", "É", "é", "ÀB", "Àb", "x" * 20_000, "hot text", "HOT TEXT"]
    rows = [(i, rng.choice(texts)) for i in range(400)] + [(1000 + i, f"own {i}") for i in range(50)] + [(5000 + i, "Hot text") for i in range(300)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, keep_id int, run string").repartition(7)
    for fan_in in (2, 16):
        got = sorted(tuple(r) for r in exact_dedup(docs, fan_in=fan_in).collect())
        assert got == expected(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "A"), (3, "a"), (None, "own")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()), key=str)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 1, True)], key=str)
    assert exact_dedup(docs.limit(0)).count() == 0
    assert exact_dedup(docs, keep="min").where("kept").count() == 3
