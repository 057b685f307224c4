import random

import numpy as np
import pytest
from corpusloom.operators import vectors as v
from corpusloom.operators.retrieve import vector_topk

SCHEMA = "chunk_index long, embedding array<float>"


def numbers(rng, dim, middle=None, spread=1.0):
    return [(middle[i] if middle else 0.0) + rng.gauss(0, spread) for i in range(dim)]


@pytest.fixture(scope="module")
def clustered(spark):
    """Clear clusters, one of them holding half of all vectors; a zero vector, a null and one of another length."""
    rng = random.Random(1)
    middles = [numbers(rng, 8) for _ in range(12)]
    rows = [(i, numbers(rng, 8, middles[0] if i % 2 else rng.choice(middles), 0.08)) for i in range(1500)]
    odd = [(5000, [0.0] * 8), (5001, None), (5002, [1.0, 2.0])]
    asked = [(i, numbers(rng, 8, rng.choice(middles), 0.08)) for i in range(30)] + [(90, None), (91, [0.5, 0.5]), (92, [0.0] * 8)]
    vectors = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    return vectors, spark.createDataFrame(asked, "query_id long, query_vec array<float>").repartition(3), rows + odd, asked


def brute(rows, asked, k):
    out = set()
    for q, w in asked:
        if w is None:
            continue
        scores = []
        for c, x in rows:
            if x is not None and len(x) == len(w):
                a, b = np.float32(w).astype(float), np.float32(x).astype(float)
                norm = np.linalg.norm(a) * np.linalg.norm(b)
                scores.append((round(float(a @ b / norm), 6) + 0.0 if norm else 0.0, c))
        out |= {(q, n + 1, c, s) for n, (s, c) in enumerate(sorted(scores, key=lambda t: (-t[0], t[1]))[:k])}
    return out


def found(df):
    return {(r.query_id, r["rank"], r.chunk_index, r.score + 0.0) for r in df.collect()}


def test_bounds_skip_most_and_lose_nothing(clustered):
    vectors, queries, rows, asked = clustered
    layout = v.build_layout(vectors, v.fit_centers(vectors, 12)[0], part_rows=100)
    try:
        assert layout.cells.count() > 15 and layout.cells.agg({"n": "max"}).first()[0] < 400  # the hot cluster lies in several rings
        near, cost = v.bounded_topk(queries, layout, 7)
        assert found(near) == brute(rows, asked, 7) == found(vector_topk(queries, vectors, 7))
        spent = {r.query_id: r.n_scored / r.n_vectors for r in cost.collect()}
        assert np.mean([x for q, x in spent.items() if q < 90]) < 0.4 and spent[91] == 1.0
    finally:
        layout.drop()


def test_members_stay_in_place(clustered):
    vectors, queries, _, _ = clustered
    layout = v.build_layout(vectors, v.fit_centers(vectors, 12)[0], part_rows=200)
    try:
        sent = layout.cells.select("part", "cluster_id").crossJoin(v._asked(queries))
        plan = v._meet(sent, layout.members, 33, 5)._jdf.queryExecution().executedPlan().toString()
        scan = plan[: plan.index("FileScan")].rsplit("FlatMapCoGroups", 1)[-1] if "FlatMapCoGroups" in plan else plan
        assert plan.count("Exchange hashpartitioning(part") == 1 and "Bucketed: true" in plan and scan
    finally:
        layout.drop()


def test_clusters_with_codes(clustered):
    vectors, queries, rows, asked = clustered
    centers, fitted = v.fit_centers(vectors, 12)
    layout = v.build_layout(vectors, centers, spill=2, part_rows=300)
    try:
        want = brute(rows, asked, 7)
        got = found(v.ivf_topk(queries, layout, 7, nprobe=3))
        assert len(got & want) >= 0.9 * len(want) and fitted > 0.9
        assert len(found(v.ivf_topk(queries, layout, 7, nprobe=12, widen=40)) & want) >= 0.99 * len(want)
    finally:
        layout.drop()


def test_queries_in_several_blocks(spark, monkeypatch):
    rng = random.Random(5)
    vectors = spark.createDataFrame([(i, numbers(rng, 6)) for i in range(90)] + [(100, None), (101, [1.0])], SCHEMA)
    queries = spark.createDataFrame([(i, numbers(rng, 6)) for i in range(50)], "query_id long, query_vec array<float>").repartition(3)
    whole = found(vector_topk(queries, vectors, 5))
    monkeypatch.setattr(v, "QUERY_BLOCK", 7)
    assert found(vector_topk(queries, vectors, 5, parts=4)) == whole and len(whole) == 250
    assert vector_topk(queries.limit(0), vectors, 5).count() == 0
