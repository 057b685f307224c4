import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from corpusloom.llm.runs import find_runs, periodic_runs


def brute(words):
    """All runs by the definition: every period, every stretch."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text, replant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if replant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def made(rng):
    words = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 4)):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(words))
        words[at:at] = (unit * rng.randint(2, 9))[: rng.randint(4, 60)]
    return words


def test_runs_against_the_definition():
    rng = random.Random(1)
    texts = [made(rng) for _ in range(1500)] + [["a"] * 400, ["a", "b"] * 300 + ["c"] + ["a", "b"] * 50]
    number = {w: k for k, w in enumerate("abcdefgh")}
    got = find_runs([np.array([number[w] for w in t], np.int64) for t in texts])
    assert got == [brute(t) for t in texts]
    assert sum(map(len, got)) > 1000


def test_documents_against_brute_force(spark):
    rng = random.Random(2)
    seps = [" ", "\n", "\t\r", "\x0b", "  \x0c "]
    rows = [(i, "".join(w + rng.choice(seps) for w in made(rng)), 7, "x") for i in range(300)]
    rows += [(1000 + i, " ".join(f"ä{rng.randint(0, 400)}" for _ in range(300)), 1, "y") for i in range(60)]
    rows += [(5, None, 1, "z"), (5, "", 1, "z"), (5, " \n ", 1, "z"), (None, "a " * 20, 1, "z"), (9, "a a a a " * 9, 1, "z"), (9, "a a a a " * 9, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, start string").repartition(5)
    out = periodic_runs(docs, replant=True)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((tuple(r) for r in out.select(*names).collect()), key=str)
    assert got == sorted((expected(d, t) for d, t, *_ in rows), key=str)
    assert {r.collapsed for r in out.where("doc_id IS NULL").collect()} == {"a"}
    assert periodic_runs(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(150_000)]
    words[1000:1000] = words[200:700] * 5
    words[90_000:90_000] = ["x"] * 60_000
    docs = spark.createDataFrame([(3, " ".join(words))], "doc_id long, text string")
    row = periodic_runs(docs).first()
    assert [(r.start, r.length, r.period) for r in row.runs] == [(1000, 2500, 500), (90_000, 60_000, 1)]
    assert row.exponent_milli == 60_000_000
