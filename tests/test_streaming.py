import random

import pytest
from corpusloom.operators import index, vectors
from corpusloom.operators.chunk import chunk_documents
from corpusloom.streaming import deltas, ingest
from pyspark.sql import functions as F


def docs(spark, ids, more=""):
    return spark.createDataFrame([(i, "c", f"f{i}.md", f"## T{i}\nbody of number {i} {'word ' * (i % 7)}{more}\n\nmore") for i in ids], ingest.DOCS)


def dropped(spark, path, *batches):
    for b in batches:
        docs(spark, *b).coalesce(1).write.mode("append").parquet(path)


def terms(index_of):
    return sorted((r.term, r.df, round(r.idf, 9)) for r in index_of.terms.collect())


def test_batches_equal_one_build_and_replay_adds_nothing(spark, tmp_path):
    drop, out, point = (str(tmp_path / x) for x in ("drop", "out", "checkpoint"))
    follow = lambda: ingest.ingest_stream(spark, drop, out, point, files_per_batch=1).awaitTermination()
    dropped(spark, drop, ([1, 2],))
    follow()
    dropped(spark, drop, ([2, 3], "longer"), ([4],), ([1, 2, 3, 4],))  # all of the last batch has been seen
    follow()
    follow()
    chunks = spark.read.parquet(f"{out}/chunks")
    assert sorted(r.doc_id for r in chunks.collect()) == [1, 2, 3, 4]
    assert not any("longer" in r.content for r in chunks.where("doc_id = 2").collect())
    found = ingest.corpus_statistics(spark, out)
    whole = index.build_bm25(chunks.drop("batch"))
    assert terms(found) == terms(whole)
    assert sorted(map(tuple, found.postings.select("term", "chunk_index", "tf", "dl").collect())) == sorted(map(tuple, whole.postings.select("term", "chunk_index", "tf", "dl").collect()))
    assert [round(x, 9) for x in found.corpus.first()] == [round(x, 9) for x in whole.corpus.first()]


def test_the_longest_of_one_batch_and_a_batch_run_again(spark, tmp_path):
    drop, out, point = (str(tmp_path / x) for x in ("drop", "out", "checkpoint"))
    rows = [(7, "c", "a.md", "short text"), (7, "c", "b.md", "a longer text than that"), (8, "c", "c.md", None), (None, "c", "d.md", "no id")]
    spark.createDataFrame(rows, ingest.DOCS).coalesce(1).write.parquet(drop)
    ingest.ingest_stream(spark, drop, out, point).awaitTermination()
    kept = spark.read.parquet(f"{out}/chunks")
    assert [(r.doc_id, r.source_file) for r in kept.collect()] == [(7, "b.md")]
    before = terms(ingest.corpus_statistics(spark, out))
    ingest.append_batch(docs(spark, [9]), out, 1)
    ingest.append_batch(docs(spark, [9]), out, 1)  # a batch that failed behind its end
    again = terms(ingest.corpus_statistics(spark, out))
    assert again != before and spark.read.parquet(f"{out}/chunks").where("doc_id = 9").count() == 1
    assert dict((t, n) for t, n, _ in again)["number"] == 1


def test_deltas_are_merged_like_a_counter(spark, tmp_path):
    path, rng, want = str(tmp_path / "terms"), random.Random(1), {}
    for number in range(70):
        if number % 10 == 3:
            continue  # a batch without new documents
        rows = {rng.choice("abcdefgh"): rng.randint(1, 9) for _ in range(4)}
        for t, n in rows.items():
            want[t] = want.get(t, 0) + n
        delta = spark.createDataFrame(list(rows.items()), "term string, df long").coalesce(1)
        deltas.append(delta, path, number, ingest.sum_terms)
        if number % 25 == 0:
            deltas.append(delta, path, number, ingest.sum_terms)  # run again
    assert {r.term: r.df for r in ingest.sum_terms(deltas.read(spark, path)).collect()} == want
    found = deltas.parts(spark, path)
    assert len(found) < 2 * deltas.FAN_IN and {p.level for p in found} == {0, 1}
    assert deltas.read(spark, str(tmp_path / "none")) is None


@pytest.fixture
def centers(spark):
    rows = [(i, [float(i % 5 == k) + 0.01 * i / 100 for k in range(64)]) for i in range(100)]
    return vectors.fit_centers(spark.createDataFrame(rows, "chunk_index long, embedding array<float>"), 4)


def test_dropped_files_equal_the_batch_build(spark, tmp_path, centers):
    drop, out, point = tmp_path / "drop", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (drop / "deep").mkdir(parents=True)
    (drop / "ab12cd34_one.md").write_bytes("## Eins\nÄrger und bad byte \xff".encode("latin-1"))
    (drop / "deep" / "two.txt").write_text("first paragraph of this text, long enough to stay by itself\n\nsecond paragraph, which is long enough to stand too")
    (drop / "picture.png").write_bytes(b"1234")
    (drop / "empty.txt").write_text("")
    (drop / "later.docx").write_bytes(b"PK")
    follow = lambda: ingest.ingest_files(spark, str(drop), out, point, files_per_batch=2, centers=centers[0]).awaitTermination()
    follow()
    (drop / "three.md").write_text("## Drei\nthe third file comes in later and has its own section")
    follow()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(drop))
    batch = chunk_documents(ingest.documents_of(files))
    kept = ["doc_id", "seq", "category", "source_file", "section_path", "content"]
    chunks = spark.read.parquet(f"{out}/chunks")
    assert sorted(map(tuple, chunks.select(kept).collect())) == sorted(map(tuple, batch.select(kept).collect()))
    assert {"one.md", "two.txt", "three.md"} <= {r.source_file for r in chunks.collect()}
    streamed = spark.read.parquet(f"{out}/vectors").select("text_hash", "embedding", "cluster_id").distinct()
    built = vectors.assign(index.build_vectors(batch), centers[0]).select("text_hash", "embedding", "cluster_id").distinct()
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, built.collect()))
    far = ingest.drift(spark, out, centers[1]).collect()
    assert sum(r.n_vectors for r in far) == chunks.count() and all(r.drift > 0.2 for r in far)  # texts are nothing like what the centres were fitted on
    assert chunks.where(F.col("source_file") == "picture.png").count() == 0
