import random

from corpusloom.operators import impact, index
from corpusloom.operators import retrieve as r


def test_same_rows_with_fewer_postings(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(5, 80)))) for i in range(3000)]
    chunks = spark.createDataFrame(rows, "chunk_index long, content string")
    lexical = index.build_bm25(chunks)
    asked = [(i, " ".join(rng.choices(words[:150], k=rng.randint(1, 5)))) for i in range(25)] + [(90, "w0 w0 w1"), (91, "nothing"), (92, None), (93, "w399 w1 w2"), (94, " ".join(words[:60]))]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    best, cost = impact.bounded_bm25(queries, impact.impact_blocks(lexical, 40), 5, seeds=4)
    want = sorted(map(tuple, r.bm25_topk(queries, lexical, 5).collect()))
    assert sorted(map(tuple, best.collect())) == want and len(want) > 100
    spent = cost.where("query_id < 90").groupBy().sum("n_postings", "n_scored").first()
    assert spent[1] < 0.7 * spent[0]


def test_blocks_hold_every_posting_once(spark):
    chunks = spark.createDataFrame([(i, "a a b" if i % 3 else "a c " * (i % 7 + 1)) for i in range(500)], "chunk_index long, content string")
    lexical = index.build_bm25(chunks)
    blocks = impact.impact_blocks(lexical, 16).blocks
    opened = sorted((x.term, x.chunk_index) for x in impact._opened(blocks).collect())
    assert opened == sorted((x.term, x.chunk_index) for x in lexical.postings.collect())
    assert all(len(b.entries) < 60 and b.most == max(e.impact for e in b.entries) for b in blocks.collect())
