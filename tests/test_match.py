import random

from corpusloom.operators.match import contained
from corpusloom.operators.retrieve import expand_queries


def test_against_plain_contains(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abä中") for _ in range(rng.randint(1, n)))
    texts = [(i % 90, word(40)) for i in range(200)] + [(500, None), (501, ""), (None, "abab")]
    patterns = [(word(4), 1) for _ in range(80)] + [("", 1), (None, 1)]
    df = spark.createDataFrame(texts, "k long, t string").repartition(3)
    wanted = spark.createDataFrame(patterns, "p string, k int")
    want = sorted(((k, p) for k, t in texts if t is not None for p in {p for p, _ in patterns if p is not None} if p in t), key=str)
    for at_once in (100_000, 7):
        assert sorted((tuple(r) for r in contained(df, "k", "t", wanted, "p", at_once).collect()), key=str) == want
    plan = contained(df, "k", "t", wanted, "p")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_synonyms(spark):
    synonyms = spark.createDataFrame([(1, "cat", "feline"), (2, "ca", "vehicle"), (3, "dog", "canine"), (4, "cats", "feline")], "ord int, alias string, canonical string")
    queries = spark.createDataFrame([(1, "two cats"), (2, "dog canine"), (3, "bird"), (4, None)], "query_id long, query string")
    got = {r.query_id: r.query for r in expand_queries(queries, synonyms).collect()}
    assert got == {1: "two cats feline vehicle feline", 2: "dog canine vehicle", 3: "bird", 4: None}
