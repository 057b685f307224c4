import random

from corpusloom.llm import packing as p
from pyspark.sql import functions as F


def test_bins_hold_their_pieces():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 60))]
        places, sizes = p.pack(lengths, (16, 32, 64), 2)
        used = {}
        for b, at, n in sorted((b, at, n) for n, (b, at) in zip(lengths, places, strict=True)):
            assert at == used.get(b, 0)
            used[b] = at + n
        assert all(sizes[b] == min(c for c in (16, 32, 64) if c >= u) for b, u in used.items()) and len(sizes) == len(used)
        assert sum(sizes) <= 2 * sum(lengths) + 64


def test_against_the_best_packing_of_small_sets():
    rng = random.Random(2)

    def best(lengths, caps):
        if not lengths:
            return 0
        price, first, rest = 1e9, lengths[0], lengths[1:]
        for mask in range(1 << len(rest)):
            size = first + sum(n for k, n in enumerate(rest) if mask >> k & 1)
            if size <= caps[-1]:
                price = min(price, min(c for c in caps if c >= size) + best([n for k, n in enumerate(rest) if not mask >> k & 1], caps))
        return price

    for _ in range(60):
        lengths = [rng.randint(1, 32) for _ in range(rng.randint(1, 7))]
        _, sizes = p.pack(lengths, (8, 16, 32), 1)
        assert best(lengths, (8, 16, 32)) <= sum(sizes) <= 1.6 * best(lengths, (8, 16, 32))


def test_documents(spark):
    rows = [(1, "x" * 40, 0), (2, None, 1), (3, "", 2), (4, "y" * 200_000, 3), (1, "x" * 40, 0), (None, "z" * 9, None)] + [(10 + i, "w" * (i * 37 % 900), 1) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = p.pack_documents(docs, p.token_estimate(F.col("text")), shard_rows=100).collect()
    tokens = {}
    for r in out:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens[4] == 50_000 and tokens[1] == 20 and tokens[2] == tokens[3] == 0 and tokens[None] == 3
    assert all(tokens[10 + i] == -(-(i * 37 % 900) // 4) for i in range(500))
    bins = {}
    for r in out:
        assert (r.bin_id is None) == (r.n_tokens == 0)
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append((r.bin_offset, r.bin_offset + r.n_tokens, r.capacity))
    for spans in bins.values():
        spans.sort()
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= spans[0][2] and spans[0][0] == 0
    assert p.pack_documents(docs.limit(0), F.lit(1)).count() == 0


def test_several_sizes_are_opened_where_one_would_cost_more():
    rng = random.Random(7)
    caps = p.CAPACITIES
    price = lambda sizes: sum(c + c * c / p.QUADRATIC + 16 for c in sizes)
    for _ in range(5):
        lengths = [min(8192, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)]
        _, opened, final = p.opened_and_final(lengths)
        assert len(set(opened)) >= 3 and max(opened.count(c) for c in caps) < 0.9 * len(opened)
        one_size = min(price([c for c in p.opened_and_final([n for n in lengths if n <= c], (c,))[1]]) + price(p.pack([n for n in lengths if n > c], caps)[1]) for c in caps)
        assert price(final) <= 1.02 * one_size and sum(final) < 1.1 * sum(lengths)


def test_shards_of_one_repeated_id_are_even(spark):
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x" * 40).alias("text"))
    out = p.pack_documents(docs, p.token_estimate(F.col("text")), shard_rows=100)
    sizes = [r["count"] for r in out.groupBy(F.shiftright("bin_id", 32)).count().collect()]
    assert sum(sizes) == 5000 and len(sizes) > 40 and max(sizes) < 200
