import os

import pytest
from corpusloom.operators.index import read_index, rebuild
from corpusloom.sources.tables import CLEANUP, Steps, current_snapshot, folders, shared_folder


def files(spark):
    at = shared_folder(spark).removeprefix("file:")
    return {os.path.join(d, f) for d, _, names in os.walk(at) for f in names if f.startswith("part-")}


def test_steps_go_when_they_are_over_and_when_the_operator_fails(spark):
    before, setting = files(spark), spark.conf.get(CLEANUP)
    with Steps(spark) as steps:
        a = steps.keep(spark.range(100).groupBy("id").count())
        b = steps.keep(a.where("id > 50"))
        steps.drop(a)
        kept = files(spark) - before
        c = steps.keep(b.where("id > 60"))
        steps.done(c)
    assert c.count() == 39 and kept and not kept & files(spark)
    left = files(spark)
    with pytest.raises(ValueError):
        with Steps(spark) as steps:
            steps.keep(spark.range(5))
            raise ValueError
    assert files(spark) == left and spark.conf.get(CLEANUP) == setting


def test_overlapping_operators_leave_the_session_as_it_was(spark):
    setting = spark.conf.get(CLEANUP)
    assert setting == "false"
    first, second = Steps(spark), Steps(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(CLEANUP) == "true"  # the second one still runs
    second.__exit__(None, None, None)
    assert spark.conf.get(CLEANUP) == setting
    with pytest.raises(ValueError):
        with Steps(spark), Steps(spark):
            raise ValueError
    assert spark.conf.get(CLEANUP) == setting


def test_a_rebuild_that_fails_leaves_the_snapshot_before(spark, tmp_path):
    root, cache = str(tmp_path / "index"), str(tmp_path / "cache")
    chunks = lambda *texts: spark.createDataFrame([(i, "c", "f.md", "s", "t", x, None) for i, x in enumerate(texts)], "chunk_index long, category string, source_file string, section_path string, content_type string, content string, enriched_content string")
    assert read_index(spark, root) is None
    rebuild(chunks("alpha beta", "beta gamma"), root, cache)
    terms = lambda: sorted(r.term for r in read_index(spark, root).terms.collect())
    assert terms() == ["alpha", "beta", "gamma"]

    def fails(text, dim):
        raise ValueError(text)

    with pytest.raises(Exception, match="delta"):
        rebuild(chunks("alpha beta", "delta"), root, cache, encoder=fails)
    assert terms() == ["alpha", "beta", "gamma"] and folders(spark, root) == ["snapshot=1"]
    rebuild(chunks("beta gamma", "alpha beta"), root, cache, encoder=fails)  # all of it has been embedded
    rebuild(chunks("alpha beta", "delta"), root, cache)
    assert terms() == ["alpha", "beta", "delta"] and sorted(folders(spark, root)) == ["snapshot=2", "snapshot=3"]
    assert spark.read.parquet(cache).count() == 3 and spark.read.parquet(f"{current_snapshot(spark, root)}/vectors").count() == 2
