"""Exact deduplication by a tree-merge of sorted digest runs (DataFrame functions only).

The digests of all rows are worked out once and checkpointed. Every row falls into one of R leaf runs by a hash of its
id and place. A run is sorted by digest and holds one entry for each: the identifier to keep and the number of
copies. In each round the runs whose numbers differ in the round's bits only (a binomial tree, several of its levels
at once) exchange their entries and are merged in order into one run, again one entry for each digest, until a
single run is left, which lies over all partitions by digest. The verdicts then travel down the same tree. An
entry never meets more than ``fan_in`` partners a round, so a text that makes up a third of the corpus is spread over
all runs and never lands in one task.

Digests are verified at every level: entries merge only if SHA-256, byte length and an independent
64-bit hash of the normalised text all agree.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import checkpointed

KEY = ["digest", "n_bytes", "check"]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the faster built-in, which is the same for them."""
    plain = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(plain)


def digest_runs(docs: DataFrame, n_runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per input row: id, verified digest key and leaf run."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text).alias("norm"))
    return rows.select(
        "doc_id",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64("norm").alias("check"),
        F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(n_runs)).cast("int").alias("run"),
    )


def merged(entries: DataFrame, keep: str) -> DataFrame:
    """The entries (KEY, run, keep_id, group_size) of each run, brought together, sorted by digest and merged in order.

    What is kept is a structure, for which Spark aggregates along the order of its input. A null id never wins.
    """
    known = F.when(F.col("keep_id").isNotNull(), F.struct(F.col("keep_id").alias("id")))
    runs = entries.repartition("run", "digest").sortWithinPartitions("run", *KEY)
    out = runs.groupBy("run", *KEY).agg({"max": F.max, "min": F.min}[keep](known).alias("best"), F.sum("group_size").alias("group_size"))
    return out.select(*KEY, "run", F.col("best.id").alias("keep_id"), "group_size")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4, keep: str = "max"
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every input row, dropped ones included.

    Texts are equal when identical after lower-casing A-Z. ``keep`` says which identifier of a group
    stays: ``max`` or ``min``. Null text counts as empty; a null id never wins against another id.
    Rows repeated with the same id and text are counted one by one and stay or go together. An empty
    table gives an empty result; other columns are ignored. There are as many leaf runs as ``fan_in`` to the power
    that first reaches the number of shuffle partitions.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = 0
    while fan_in**rounds < partitions:
        rounds += 1
    rows = checkpointed(digest_runs(docs, fan_in**rounds, id_col, text_col))
    levels = [merged(rows.select(*KEY, "run", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")), keep)]
    for _ in range(rounds):
        levels.append(merged(levels[-1].withColumn("run", (F.col("run") / fan_in).cast("int")), keep))
    verdict = levels.pop()
    while levels:
        below = levels.pop().select(*KEY, "run", (F.col("run") / fan_in).cast("int").alias("up"))
        verdict = below.join(verdict.withColumnRenamed("run", "up"), [*KEY, "up"]).drop("up")
    out = rows.join(verdict, [*KEY, "run"])
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
