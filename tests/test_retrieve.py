import math
import random

from corpusloom.functions import helpers, text
from corpusloom.operators import answer, audit, index
from corpusloom.operators import retrieve as r
from corpusloom.operators.match import contained
from pyspark.sql import functions as F


def chunks(spark, n=60):
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, f"f{i % 7}.md", "c" if i % 2 else "d", " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(n)]
    df = spark.createDataFrame(rows, "chunk_index long, source_file string, category string, content string")
    return df.withColumn("section_path", F.lit("s")).withColumn("content_type", F.lit("t")), rows


def test_bm25_against_plain_python(spark):
    df, rows = chunks(spark)
    docs = {i: t.split() for i, _, _, t in rows}
    avg = sum(map(len, docs.values())) / len(docs)
    df_of = lambda w: sum(w in t for t in docs.values())
    raw = {w: math.log(len(docs) - df_of(w) + 0.5) - math.log(df_of(w) + 0.5) for w in {x for t in docs.values() for x in t}}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    query = "alpha beta beta nothing"
    score = lambda t: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split())
    want = sorted(((round(score(t), 6), -i) for i, t in docs.items() if {"alpha", "beta"} & set(t)), reverse=True)[:10]
    got = r.bm25_topk(spark.createDataFrame([(1, query)], "query_id long, query string"), index.build_bm25(df), 10).orderBy("rank").collect()
    assert [(x.score, -x.chunk_index) for x in got] == want


def test_fusion_and_diversity(spark):
    rng = random.Random(2)
    lists = [spark.createDataFrame([(q, k + 1, c) for q in range(3) for k, c in enumerate(rng.sample(range(60), 30))], "query_id long, rank int, chunk_index long") for _ in range(2)]
    fused = r.rrf_fuse(*lists, 40)
    again = r.rrf_fuse(lists[0].repartition(3), lists[1].repartition(5), 40)
    assert {tuple(x) for x in fused.collect()} == {tuple(x) for x in again.collect()}
    df, _ = chunks(spark)
    kept = r.file_diversity(fused.join(df.select("chunk_index", "source_file"), "chunk_index"), 10).collect()
    for q in range(3):
        files = [x.source_file for x in kept if x.query_id == q]
        assert len(files) <= 10 and len(set(files)) <= 5 and max(map(files.count, files)) <= 2


def test_expansion_boost_labels(spark):
    queries = spark.createDataFrame([(1, "户标段需要系数"), (2, "多层住宅"), (3, "none")], "query_id long, query string")
    synonyms = spark.createDataFrame([(1, "户标段", "住宅"), (2, "系数", "需要系数"), (3, "多层", "多层住宅"), (4, "标段", "住宅")], "ord int, alias string, canonical string")
    got = {x.query_id: x.query for x in r.expand_queries(queries, synonyms).collect()}
    assert got == {1: "户标段需要系数 住宅 住宅", 2: "多层住宅", 3: "none"}
    files = spark.createDataFrame([("red house.md",), ("x.md",), ("",)], "source_file string")
    boost = r.filename_boost(spark.createDataFrame([(1, "red house boat 系统")], "query_id long, query string"), files).collect()
    assert [(x.source_file, x.boost) for x in boost] == [("red house.md", round(1 + 2 / 3 * 19, 6))]
    hits = spark.createDataFrame([(1, 5, 0.1, 1), (1, 6, 0.0901, 2), (1, 7, 0.0899, 3)], "query_id long, chunk_index long, score double, fused_rank int")
    assert [x.relevance for x in r.label_relevance(hits).orderBy("rank").collect()] == ["direct", "direct", "indirect"]


def test_follow_ups(spark):
    turns = [(1, 0, "user", "surge protector layout"), (1, 1, "assistant", "x"), (1, 2, "user", "any?"), (1, 3, "user", "surge"), (1, 4, "user", "a long new question on cables"), (2, 0, "user", "hm")]
    got = [r_.enriched_query for r_ in answer.followup_enrich(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).orderBy("conv_id", "turn").collect()]
    assert got == ["surge protector layout", "any? surge protector layout", "surge any", "a long new question on cables", "hm"]


def test_media(spark):
    table = "| a | b |\n| --- | --- |\n| cable | size |"
    rows = [(1, "cable size", 1, "direct", 0.05, f"cable\n{table}\nend", ["i1", "i2"], "k"), (1, "cable size", 2, "indirect", 0.04, f"size\n{table.replace('a', 'q')}", ["i2", "i3"], "k"), (1, "cable size", 3, "indirect", 0.03, "unrelated", ["i4"], "k")]
    hits = spark.createDataFrame(rows, "query_id long, query string, rank int, relevance string, relevance_score double, content string, image_ids array<string>, category string")
    images = answer.source_images(hits)
    assert [(x.place, x.path, x.relevance) for x in images.orderBy("place").collect()] == [(1, "i1", "direct"), (2, "i2", "direct"), (3, "i3", "indirect")]
    tables = answer.source_tables(hits).collect()
    assert [(x.relevance, x.table_text) for x in tables] == [("direct", table)]
    media = answer.media_sections(images, answer.source_tables(hits)).first().media
    assert media.startswith("\n\n---\n### 直接参考图片\n![附图](/api/images/k/i1)\n![附图](/api/images/k/i2)\n\n### 直接参考表格\n\n| a") and media.endswith("### 拓展参考图片\n![附图](/api/images/k/i3)")


def test_audit(spark):
    df, _ = chunks(spark)
    checks = audit.run_audit(df, index.build_bm25(df), index.doc_stats(df), spark.createDataFrame([(1, [0.0] * 8)], "chunk_index long, embedding array<double>"), dim=8)
    got = {c.name: (c.passed, c.level) for c in checks.collect()}
    assert len(got) == 8 and got["embedding_dims"] == (True, "ERROR") and got["file_diversity"][0] and got["section_paths"][0]
    empty = audit.chunk_checks(df.limit(0))
    assert {c.name: c.passed for c in empty.collect()} == {"chunk_count": False, "section_paths": False, "table_chunks": True, "file_diversity": False, "hierarchy_depth": False}
    assert audit.report(checks).first().passed == all(ok for ok, level in got.values() if level == "ERROR")


def test_each_query_has_its_own_filters(spark):
    df, rows = chunks(spark)
    rng = random.Random(9)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    vectors = spark.createDataFrame([(i, vec()) for i in range(60)], "chunk_index long, embedding array<float>")
    asked = [(1, "alpha beta", vec(), None), (2, "alpha beta", vec(), ["c"]), (3, "alpha", vec(), ["none"]), (4, "alpha", None, ["d"])]
    queries = spark.createDataFrame(asked, "query_id long, query string, query_vec array<float>, categories array<string>")
    category = {i: c for i, _, c, _ in rows}
    lexical = r.bm25_topk(queries, index.build_bm25(df), 8, chunks=df).collect()
    nearest = r.vector_topk(queries, vectors, 8, df, parts=3).collect()
    for found in (lexical, nearest):
        assert {category[x.chunk_index] for x in found if x.query_id == 2} == {"c"} and not any(x.query_id == 3 for x in found)
        assert {category[x.chunk_index] for x in found if x.query_id == 1} == {"c", "d"}
        assert sorted(x["rank"] for x in found if x.query_id == 2) == list(range(1, 9))  # eight of those allowed, not what is left of eight
    assert {x.query_id for x in nearest} == {1, 2}
    made = r.retrieve(queries, df.withColumns({"has_image": F.lit(False), "image_ids": F.array(), "split_strategy": F.lit("NL")}), index.build_bm25(df), vectors, 4)
    assert {category[x.chunk_index] for x in made.collect() if x.query_id == 4} == {"d"}
    assert made.where("query_id = 1 AND rerank_score IS NULL").count() == 0


def test_texts_travel_and_not_their_postings(spark):
    df, _ = chunks(spark)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "query_id long, query string")
    whole = lambda c: helpers.dictionary_tokens(c, ["配电"])
    likely = lambda c: helpers.weighted_tokens(c, {"配电": 3})
    found = []
    for cut in (text.tokenize, whole, likely):
        lexical = index.build_bm25(df, cut)
        best = r.bm25_topk(asked, lexical, 5, tokenize=cut)
        found.append(sorted(map(tuple, best.collect())))
        for made, n in ((lexical.postings, 1), (best, 2)):  # texts by chunk, and the best by query
            plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "term#" not in x]
            assert len(dealt) == n and "chunk_index" in dealt[-1] and "hashpartitioning(term" not in lexical.postings._jdf.queryExecution().executedPlan().toString()
    assert found[0] == found[1] == found[2] and found[0]


def test_boosted_names_travel_once(spark, monkeypatch):
    keys = []
    monkeypatch.setattr(r, "contained", lambda texts, key, *a: keys.append(texts.schema[key].dataType.typeName()) or contained(texts, key, *a))
    names = ["red house.md", "red boat.md.md", "red house.md", "x.md", ".md", "", None, "house " * 5000 + ".md"]
    asked = spark.createDataFrame([(1, "red red house boat a"), (2, "red"), (3, ""), (4, None)], "query_id long, query string")
    got = r.filename_boost(asked, spark.createDataFrame([(n,) for n in names], "source_file string"))
    want = {(1, "red house.md", 3 / 4), (1, "red boat.md.md", 3 / 4), (1, names[-1], 1 / 4), (2, "red house.md", 1.0), (2, "red boat.md.md", 1.0)}
    assert {tuple(x) for x in got.collect()} == {(q, n, round(1 + share * 19, 6)) for q, n, share in want} and got.count() == len(want)
    assert set(keys) == {"long"}  # a hit of a word carries the name's number, not the name


def test_columns_are_worked_out_for_hits_only(spark):
    df, _ = chunks(spark, 400)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def kind(content):
        seen.add(1)
        return content[:1]

    whole = df.withColumns({"content_type": kind("content"), "has_image": F.lit(False), "image_ids": F.array(), "split_strategy": F.lit("NL")})
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "chunk_index long, embedding array<float>")
    queries = spark.createDataFrame([(1, "alpha beta", [1.0, 1.0])], "query_id long, query string, query_vec array<float>")
    made = r.retrieve(queries, whole, index.build_bm25(whole), vectors, 4).collect()
    assert len(made) == 4 and all(x.content_type == x.content[:1] for x in made)
    assert 4 <= seen.value <= 40  # of 400 chunks


def test_filtered_scores_stay_where_their_chunks_lie(spark):
    df, _ = chunks(spark)
    asked = spark.createDataFrame([(1, "alpha beta", ["c"])], "query_id long, query string, categories array<string>")
    best = r.bm25_topk(asked, index.build_bm25(df), 5, chunks=df)
    assert best.count() == 5
    plan = best._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "term#" not in x]
    assert "ShuffledHashJoin" in plan and len(dealt) == 3 and not any("query_id" in x and "chunk_index" in x for x in dealt)  # texts, kinds, and the best by query
