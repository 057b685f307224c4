import random
import re

import numpy as np
from corpusloom.llm import jaccard_join as j
from corpusloom.llm.components import components
from corpusloom.sources.tables import Steps


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n_groups=12, size=10):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = rng.choices(words, k=40)
    rows, k = [], 100
    for g in range(n_groups):
        base = rng.choices(words, k=rng.randint(5, 150))
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words).upper()
            if g % 3 == 0:
                w += common
            if rng.random() < 0.3:
                w = w[: int(len(w) * rng.uniform(0.7, 1))]
            rows.append((k, " ".join(w)))
            k += rng.randint(1, 3)
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "É a b c d"), (8, "é a b c d")]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(j, "LEAF", 2)
    for seed in range(3):
        rows = corpus(seed)
        docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n int" if False else "doc_id long, text string, token string").repartition(5)
        for frequent in (65_536, 5) if seed == 0 else (65_536,):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.similar_documents(docs, frequent=frequent).collect()}
            assert got == brute(rows), seed
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, c in brute(rows).values()}


def test_tree_finds_every_pair():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 200))
        base = rng.integers(0, 6, (5, j.GROUPS))
        points = np.abs(base[rng.integers(0, 5, n)] + rng.integers(-1, 2, (n, j.GROUPS)) * (rng.random((n, j.GROUPS)) < 0.1)).astype(np.int32)
        sizes = points.sum(axis=1)
        got = {tuple(sorted(p)) for i, k in j.RTree(points, sizes).pairs() for p in zip(i.tolist(), k.tolist(), strict=True)}
        want = set()
        for a in range(n):
            for b in range(a):
                fits = 7 * int(np.minimum(points[a], points[b]).sum()) >= 3 * int(sizes[a] + sizes[b])
                if fits and 4 * min(sizes[a], sizes[b]) >= 3 * max(sizes[a], sizes[b]):
                    want.add((b, a))
        assert got == want


def test_tiles_lose_no_pair(spark):
    docs = spark.createDataFrame(corpus(9, 6, 30), "doc_id long, text string").dropna()
    points = j.survey(docs).where("kind = 0 AND n > 0").select("doc_id", "n", "point")
    cells = points.selectExpr("1L as token", "doc_id", "doc_id as grp")
    pairs = [{tuple(r) for r in j.tree_pairs(cells, points, tile_rows=t).collect()} for t in (4, 10_000)]
    assert pairs[0] == pairs[1] and pairs[0]


def test_exact_search_alone_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(j, "star_links", lambda least, sets, groups=None: least.selectExpr("doc_id AS a", "doc_id AS b").limit(0))
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in j.similar_documents(docs).collect()} == brute(rows)


def test_leaders_over_salts(spark, monkeypatch):
    monkeypatch.setattr(j, "CROWD", 4)
    rng = random.Random(8)
    base = [rng.choice("abcdefgh") + str(i) for i in range(120)]
    rows = [(k, " ".join(w if i != k else "new" for i, w in enumerate(base))) for k in range(60)]
    rows += [(100 + k, " ".join(rng.choices(base, k=100))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in j.similar_documents(docs).collect()} == brute(rows)


def test_one_id_with_different_texts(spark):
    rng = random.Random(2)
    x, y = (" ".join(rng.choice("abcdefgh") + str(i) for i in range(60)) for _ in range(2))
    docs = spark.createDataFrame([(5, x), (5, y), (3, x + " more"), (9, y + " more"), (7, "z " * 40)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in j.similar_documents(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 3)]


def test_very_long_text(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:50_000])), (3, " ".join(words[:40_000]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in j.similar_documents(docs).collect()} == {1: 1, 2: 1, 3: 1}


def test_full_coordinates_never_lower_a_bound():
    big = np.arange(60_000, dtype=np.uint64) * np.uint64(j.GROUPS)
    a, b = (np.frombuffer(j.point(x), np.uint8) for x in (big, big[:50_000]))
    assert j.bounds(a, b) >= 50_000


def test_fine_points_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 3000)))) for _ in range(2))
        assert j.fine_bound(j.fine_point(a), j.fine_point(b)) >= len(np.intersect1d(a, b))
        assert (j.folded(j.fine_point(a)) == np.frombuffer(j.point(a), np.uint8)).all()
    same = np.arange(2_000_000, dtype=np.uint64) * np.uint64(1 << 14)
    assert j.fine_bound(j.fine_point(same), j.fine_point(same)) >= len(same)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.similar_documents(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (None, 0, None)], key=str)
    assert j.similar_documents(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long"), Steps(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_components_of_late_and_shuffled_chains(spark):
    n, rng = 500, random.Random(4)
    late = [*range(2, n + 1), 1]
    shuffled = rng.sample(range(1000, 1000 + n), n)
    falling = list(range(3000 + n, 3000, -1))
    links = [p for chain in (late, shuffled, falling) for p in zip(chain, chain[1:], strict=False)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long"), Steps(spark)).collect()}
    assert got == {x: min(chain) for chain in (late, shuffled, falling) for x in chain}


def test_any_column_names(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "a", "b", "c"), (2, text, "a", "b", "d"), (None, text, "a", "b", "e"), (None, "own words", "a", "b", "f")], "doc_id long, text string, kept_id0 string, __kept_id string, Gone0 string")
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.Gone0 for r in kept.collect()) == ["c", "f"]


def test_steps_of_few_links_have_few_files(spark, monkeypatch):
    parts, keep = [], Steps.keep

    def watched(self, df):
        out = keep(self, df)
        if out.columns == ["a", "b"]:
            parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(Steps, "keep", watched)
    rows = corpus(4, 30, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in j.similar_documents(docs).collect()} == brute(rows)
    assert len(parts) >= 4 and max(parts) == 1


def test_copies_in_any_order_of_ids_are_searched(spark, monkeypatch):
    monkeypatch.setattr(j, "star_links", lambda least, sets, groups=None: least.selectExpr("doc_id AS a", "doc_id AS b").limit(0))
    words = [f"w{i}" for i in range(80)]
    rows = [(9, " ".join(words)), (3, " ".join(words)), (6, " ".join(words[:70])), (4, " ".join(words[:70]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in j.similar_documents(docs).collect()} == {k: 3 for k, _ in rows}
