import hashlib
import random
import zlib

import pytest
from corpusloom.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, part string"


def expected(rows, share):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    convs = {c: [t for _, t in sorted(turns)] for c, turns in convs.items()}
    if share:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
        convs = {c: convs.get(c - c % 100, [])[: h[c]] + own[h[c] :] for c, own in convs.items()}
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, held in members.items():
        under = [p for p in members if p[: len(path)] == path]
        inner = {p[:-1] for p in members if p}
        out.append((
            min(held), len(path), min(members[path[:-1]]) if path else None, len(held), sum(len(p) == len(path) + 1 for p in under), sum(p not in inner for p in under),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p), hashlib.sha256(",".join(str(c) for c in sorted(held) if len(convs[c]) == len(path)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(spark, rows, share, block=4096):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in conversation_trie(df, share, block).collect()), key=str)


def made(rng, n):
    rows, texts = [], ["a", "b", "cc", "", None, "Äö"]
    for c in range(n):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "user", "assistant", None])
            rows.append((rng.choice([c, c, 100 + c, 205]) if c % 9 == 0 else c, turn if rng.random() < 0.95 else None, role, rng.choice(texts)))
    return rows


@pytest.mark.parametrize("share", [False, True])
def test_against_brute_force(spark, share):
    rng = random.Random(1)
    rows = made(rng, 120) + [(None, 0, "user", "no conversation")] * 3
    assert found(spark, rows, share) == expected(rows, share)


def test_hot_start_hot_conversation_and_copies(spark):
    rng = random.Random(2)
    rows = [(7, i, "user", rng.choice("ab")) for i in range(150)]  # one long conversation, in blocks of a few turns
    rows += [(10 + k, i, r[2], r[3]) for k in range(25) for i, r in enumerate(rows[: rng.randint(1, 60)])]  # its prefixes
    rows += [(1000 + k, i, "user", "same") for k in range(60) for i in range(3)] + [(2000, 5, "user", "x")] * 4
    assert found(spark, rows, False, block=8) == expected(rows, False)


def test_turnless_and_missing_first_conversations(spark):
    rows = [(c, t, "user", f"t{t}") for c in [*range(101, 130), 300, 301, 302, -5] for t in range(2)]
    got = found(spark, rows, True)
    assert got == expected(rows, True)
    assert hashlib.sha256(b"").hexdigest() not in {r[7] for r in got if r[1] == 0}  # some end at the root


def test_empty(spark):
    assert found(spark, [], True) == []
