import random
import re
import string

import numpy as np
import pytest
import xxhash
from corpusloom.llm.simhash import fingerprints, flipped_links, keyed, keys_of, met, near_codewords, similar_fingerprints

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(values):
    """The smallest value that each one reaches by links."""
    values, least = sorted(set(values)), {v: v for v in values}
    links = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                moved = True
    return least


def expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    least = brute(fps)
    ids = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            ids[least[f]] = min(d, ids.get(least[f], d))
    return sorted(((d, f"{f:016x}", ids.get(least[f])) for (d, _), f in zip(rows, fps)), key=str)


def test_codewords():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000, dtype=np.uint32)
    near = near_codewords(words, 23)
    assert near.max() < 4096 and max(len(set(r)) for r in near.tolist()) == 6
    for k in range(23):  # one bit apart: the home codeword of one is near the other
        homes = near_codewords(words ^ np.uint32(1 << k), 23)[:, 0]
        assert (near == homes[:, None]).any(axis=1).all()


def test_all_pairs_within_two_bits_share_a_key():
    rng = random.Random(2)
    for _ in range(60):
        a = rng.getrandbits(64)
        others = [a ^ 1 << i ^ 1 << j for i, j in (rng.sample(range(64), 2) for _ in range(40))] + [a ^ 1 << rng.randrange(64)]
        key, row, home = keys_of(np.array([a, *others], np.uint64))
        homes = set(key[(row == 0) & home].tolist())
        for k in range(1, len(others) + 1):
            assert homes & set(key[row == k].tolist())


def planted(rng, n):
    """Fingerprints with near ones, chains among them, and a crowd in one small ball."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        out.append(rng.choice(out) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    return out


@pytest.mark.parametrize("crowd", [256, 3])
def test_links_against_brute_force(spark, crowd):
    rng = random.Random(3)
    middle = rng.getrandbits(64)
    values = planted(rng, 500) + [middle ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(600)]
    signed = np.array(sorted(set(values)), np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if crowd > 3 else 40)  # keys that go on in the next batch
    try:
        rows = met(keyed(fps, crowd), crowd).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    crowded = sorted({r.a for r in rows if r.b is None})
    links = [(r.a, r.b) for r in rows if r.b is not None]
    if crowded:
        links += [tuple(r) for r in flipped_links(spark.createDataFrame([(v,) for v in crowded], "fp long")).collect()]
    whole = {v % (1 << 64) for v in signed}
    least = {v: v for v in whole}
    for _ in range(80):
        for a, b in links:
            a, b = a % (1 << 64), b % (1 << 64)
            assert (a ^ b).bit_count() <= 2
            least[a] = least[b] = min(least[a], least[b])
    assert least == brute(whole)
    assert (crowd == 256) or len(crowded) > 100


def test_documents_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ä", "É", "é", "ab", "AB"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 200))] for _ in range(60)]
    rows = []
    for k in range(400):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (None, "own text of a row without id"), (None, rows[0][1]), (7, "other text for an id"), (7, rows[3][1]), (7, rows[3][1]), (50, "one"), (51, "One two"), (52, "ONE")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, component_id string").repartition(6)
    got = sorted((tuple(r) for r in similar_fingerprints(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == expected(rows)
    assert similar_fingerprints(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(5)
    text = " ".join(str(rng.randrange(1000)) for _ in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, text.replace("17", "18", 3))], "doc_id long, text string")
    got = {r.doc_id: r.fp % (1 << 64) for r in fingerprints(docs).collect()}
    assert got[1] == fingerprint(text)
