"""Readers and writers of the library's tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset a part of the warehouse."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return set_by_cluster or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_running: dict[str, tuple[int, str]] = {}  # by session: how many operators run, and the setting before the first of them
_changing = threading.Lock()


class Steps:
    """The written steps of one operator, as a context.

    ``keep`` cuts a frame from its lineage by a reliable checkpoint; ``drop`` deletes the files of steps that no later one reads, and ``done`` those of
    all but the steps that the result needs. If the operator fails, all of them go. Within the context Spark also deletes
    the shuffle files of each step as soon as it is written. That is a setting of the whole session, so where operators overlap, in
    threads or one within another, the first to begin turns it on and the last to end puts back what was set before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Steps:
        session = self.spark._jsparkSession.sessionUUID()
        with _changing:
            count, before = _running.get(session) or (0, self.spark.conf.get(CLEANUP))
            self.spark.conf.set(CLEANUP, "true")
            _running[session] = count + 1, before
        return self

    def __exit__(self, kind, error, trace) -> None:
        session = self.spark._jsparkSession.sessionUUID()
        try:
            with _changing:
                count, before = _running.pop(session)
                if count > 1:
                    _running[session] = count - 1, before
                else:
                    self.spark.conf.set(CLEANUP, before)
        finally:
            if kind is not None:
                self.done()

    def keep(self, df: DataFrame) -> DataFrame:
        out = checkpointed(df)
        self.paths[id(out)] = out, out._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
        return out

    def drop(self, *steps: DataFrame) -> None:
        for step in steps:
            delete_folder(self.spark, self.paths.pop(id(step))[1])

    def done(self, *needed: DataFrame) -> None:
        self.drop(*[df for df, _ in list(self.paths.values()) if not any(df is n for n in needed)])


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, marker: str | None = None) -> list[str]:
    """Names of the folders in a folder, if any; with ``marker`` of those that hold such a file."""
    at, fs = _path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []
    return [n for n in names if marker is None or fs.exists(_path(spark, f"{path}/{n}/{marker}")[0])]


def delete_folder(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


COMPLETE = "_COMPLETE"


def _snapshots(spark: SparkSession, root: str, marker: str | None) -> list[int]:
    return sorted(int(n.removeprefix("snapshot=")) for n in folders(spark, root, marker) if n.startswith("snapshot="))


@contextmanager
def new_snapshot(spark: SparkSession, root: str, keep: int = 2) -> Iterator[str]:
    """A folder for a rebuild of several tables that belong together. It counts once all of it is written.

    A marker is written last; until then, and if the rebuild fails, readers go on with the snapshot before. Of complete snapshots the last
    ``keep`` stay, so whoever has begun to read one finds its files for another rebuild.
    """
    number = max(_snapshots(spark, root, None), default=0) + 1
    at = f"{root}/snapshot={number}"
    try:
        yield at
    except BaseException:
        delete_folder(spark, at)
        raise
    marker, fs = _path(spark, f"{at}/{COMPLETE}")
    fs.create(marker).close()
    for old in _snapshots(spark, root, COMPLETE)[:-keep]:
        delete_folder(spark, f"{root}/snapshot={old}")


def current_snapshot(spark: SparkSession, root: str) -> str | None:
    """The folder of the last complete snapshot, if there is one."""
    found = _snapshots(spark, root, COMPLETE)
    return f"{root}/snapshot={found[-1]}" if found else None


def read_chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records with image ids as a comma-joined string."""
    schema = "chunk_index long, category string, source_file string, section_path string, content_type string, content string, split_strategy string, has_image boolean, image_ids string, enriched_content string"
    raw = spark.read.schema(schema).json(path)
    return raw.withColumn("image_ids", F.when(F.coalesce("image_ids", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("image_ids", ",")))


def write_chunks_jsonl(chunks: DataFrame, path: str) -> None:
    chunks.withColumn("image_ids", F.array_join("image_ids", ",")).write.mode("overwrite").partitionBy("category").json(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Rebuilds a table; what was there is replaced."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_bindings_json(bindings: DataFrame, path: str) -> None:
    """One JSON object per source file: its bound images by chunk, and those without."""
    item = F.struct("chunk_index", "pos", "description", "path", "markdown", "bound")
    ordered = F.array_sort(F.collect_list(item)).alias("images")
    bindings.groupBy("source_file").agg(ordered).write.mode("overwrite").json(path)


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """ord, alias, canonical from lines ``alias=canonical``; comments and blank lines skipped, later lines win."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    pairs = rows.select("line", F.trim("text").alias("text")).where("text != '' AND NOT startswith(text, '#') AND contains(text, '=')")
    cut = pairs.select("line", F.split("text", "=", 2).alias("p")).select("line", F.trim(F.col("p")[0]).alias("alias"), F.trim(F.col("p")[1]).alias("canonical"))
    return cut.groupBy("alias").agg(F.min("line").alias("ord"), F.max_by("canonical", "line").alias("canonical")).select("ord", "alias", "canonical")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term != ''").distinct()


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(pattern, replacement) pairs of a JSON array; a rule list is configuration, at most some thousands."""
    rows = spark.read.schema("pattern string, replacement string").json(path, multiLine=True).dropna()
    return [(r["pattern"], r["replacement"]) for r in rows.collect()]
