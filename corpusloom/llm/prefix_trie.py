"""A trie of conversation prefixes by preorder intervals.

Each different sequence of the first d turns of some conversations is a node. The steps, each a job over narrow rows (digests
of turns instead of texts):

1. Turns are sorted by conversation and turn over all partitions and numbered there, so that a conversation of any length is spread.
2. A node is named by the running sum, over its turns, of hashes of (place, turn); these sums are made in blocks of turns, and
   the blocks' own sums by the same function again. So a row knows its node and the node above it without a join.
3. Conversations that end in the same node are one sequence. Sequences are ranked in the lexicographic order that takes, where paths
   part, the child with the smallest conversation first. A sequence's sort key lists only the children of nodes where paths part: with
   R turns in the corpus that are at most the square root of 2R of them, since each needs another conversation as long as that.
4. Sorted by first sequence and depth, the nodes are in preorder, and a subtree ends with its last sequence. Prefix sums over the
   sorted nodes, made within partitions and then carried over them, give leaves and savings of every subtree as a difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.sources.tables import Steps

BLOCK = 4096
SUMS = ["s0", "s1", "s2", "s3"]  # of 32 bits each, so that two thousand million of them fit a long
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def spread_rows(df: DataFrame, by: list[Column], work: Steps) -> DataFrame:
    """df in the order of ``by`` over all partitions, with ``part`` and ``row``, a row's number in its partition; written, so that they stay."""
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    number = F.monotonically_increasing_id()
    return work.keep(ordered.select("*", F.spark_partition_id().alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")))


def ordered_turns(conversations: DataFrame, work: Steps) -> DataFrame:
    """conv_id, pos (from 0), digest of role and text, and n_chars for each turn of a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest")
    narrow = conversations.where("conv_id IS NOT NULL").select("conv_id", F.col("turn"), digest, F.length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("tie"))
    rows = spread_rows(narrow, [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest"), F.asc("tie")], work)
    parts = rows.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))  # a few for each conversation
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(parts.select("conv_id", "part", "first", before.alias("before")), ["conv_id", "part"])
    return placed.select("conv_id", (F.col("row") - F.col("first") + F.col("before")).alias("pos"), "digest", "n_chars")


def shared_starts(turns: DataFrame, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) rebuilt so that they share their starts: the first h turns of the first conversation of each ``group``
    ids, then a conversation's own behind its first h, where h = crc32(conv_id) % (most + 1).

    conversations has conv_id and n_turns; turns has conv_id, depth (from 1), digest and n_chars.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    plan = own.select("conv_id", "n_own", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(group))).alias("base"))
    plan = plan.join(own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left")
    plan = plan.select("conv_id", "base", "h", "n_own", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    started = plan.select("base", "conv_id", "taken").join(heads, "base").where("pos < taken").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "n_chars")
    tails = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    tails = tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "digest", "n_chars")
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"))
    return lengths, started.unionByName(tails)


def running_sums(rows: DataFrame, key: str, place: str, values: list[str], block: int = BLOCK) -> DataFrame:
    """rows with the running sums of values over place (dense, from 1) for each key, in their stead. No window holds over ``block`` rows."""
    part = f"{place}_block"
    at = rows.withColumn(part, F.floor((F.col(place) - 1) / block) + 1)
    here = W.partitionBy(key, part).orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    summed = at.select(*[c for c in at.columns if c not in values], *[F.sum(v).over(here).alias(v) for v in values])
    if (rows.agg(F.max(place)).first()[0] or 0) <= block:
        return summed.drop(part)
    totals = at.groupBy(key, part).agg(*[F.sum(v).alias(v) for v in values])
    carried = running_sums(totals, key, part, values, block).select(key, (F.col(part) + 1).alias(part), *[F.col(v).alias(f"{v}_before") for v in values])
    both = summed.join(carried, [key, part], "left")
    return both.select(*[c for c in rows.columns if c not in values], *[(F.col(v) + F.coalesce(f"{v}_before", F.lit(0))).alias(v) for v in values])


def node_names(depth: Column, sums: list[Column]) -> list[Column]:
    """128 bits in two longs that name the node at the end of a path."""
    return [F.xxhash64(depth, *sums), F.xxhash64(*reversed(sums), depth, F.lit(1))]


def paths(turns: DataFrame, work: Steps, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, n_chars, node (n0, n1) and the node above (p0, p1) for each turn."""
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda x: F.shiftrightunsigned(x, 32)
    first, second = F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth", F.lit(1))
    terms = [low(first), high(first), low(second), high(second)]
    own = work.keep(turns.select("conv_id", "depth", "n_chars", *[t.alias(s) for t, s in zip(terms, SUMS)], *[t.alias(f"own_{s}") for t, s in zip(terms, SUMS)]))
    summed = running_sums(own, "conv_id", "depth", SUMS, block)
    here = node_names(F.col("depth"), [F.col(s) for s in SUMS])
    above = node_names(F.col("depth") - 1, [F.col(s) - F.col(f"own_{s}") for s in SUMS])
    names = [c.alias(n) for c, n in zip(here + above, ("n0", "n1", "p0", "p1"))]
    out = work.keep(summed.select("conv_id", "depth", "n_chars", *names))
    work.drop(own)
    return out


def part_offsets(df: DataFrame, sums: list[str]) -> DataFrame:
    """part and, for each column, its sum over the partitions before: as many rows as there are partitions."""
    totals = df.groupBy("part").agg(*[F.sum(c).alias(c) for c in sums])
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums])


def ranked_sequences(steps: DataFrame, ends: DataFrame, branches: DataFrame, work: Steps) -> DataFrame:
    """conv_id and rank of the smallest conversation of each sequence; ends has conv_id, n0, n1 and depth of all."""
    chosen = ends.groupBy("n0", "n1").agg(F.min(F.struct("conv_id", "depth")).alias("e")).select("e.conv_id", F.col("e.depth").alias("length"))
    own = steps.join(chosen.select("conv_id"), "conv_id", "left_semi").select("conv_id", "depth", "n0", "n1")
    marks = own.join(branches, ["n0", "n1"]).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "mark"))).alias("marks"))
    keys = chosen.join(marks, "conv_id", "left").select("conv_id", "length", F.coalesce(F.transform("marks", lambda m: m["mark"]), F.array().cast("array<bigint>")).alias("marks"))
    rows = spread_rows(keys, [F.asc("marks"), F.asc("length")], work).select("conv_id", "part", "row", F.lit(1).cast("long").alias("one"))
    offsets = part_offsets(rows, ["one"])
    return rows.join(F.broadcast(offsets), "part").select("conv_id", (F.col("row") + F.col("one_before")).alias("rank"))  # a row for each partition


def running_totals(nodes: DataFrame) -> DataFrame:
    """nodes, sorted within partitions, with the running sums of leaf and saved in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = saved = 0
        for batch in batches:
            one, two = (np.cumsum(batch.column(c).to_numpy()) for c in ("leaf", "saved"))
            columns = [pa.array(one + leaves), pa.array(two + saved)]
            if len(one):
                leaves, saved = leaves + int(one[-1]), saved + int(two[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "leaves_to", "saved_to"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.mapInArrow(run, f"{kinds}, leaves_to long, saved_to long")


def ends_digests(ends: DataFrame) -> DataFrame:
    """n0, n1 and ends_sha256 of the ids that end in a node, in numeric order. Ids are joined to pieces where they lie, and only
    pieces travel to the task that digests a node's, one after the other in constant memory."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n0, n1, ids = (batch.column(c).to_numpy() for c in ("n0", "n1", "conv_id"))
            first = np.flatnonzero(np.append(True, (n0[1:] != n0[:-1]) | (n1[1:] != n1[:-1])))
            texts = [",".join(map(str, part.tolist())) for part in np.split(ids, first[1:])]
            numbers = np.arange(number, number + len(first))
            number += len(first)
            yield pa.RecordBatch.from_arrays([pa.array(n0[first]), pa.array(n1[first]), pa.array(numbers), pa.array(texts)], names=["n0", "n1", "number", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for n0, n1, piece in zip(*(batch.column(c).to_pylist() for c in ("n0", "n1", "piece")), strict=True):
                if (n0, n1) == node:
                    sha.update(b"," + piece.encode())
                    continue
                if node is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha = (n0, n1), hashlib.sha256(piece.encode())
            yield _digest_rows(done)
        if node is not None:
            yield _digest_rows([(*node, sha.hexdigest())])

    sorted_ends = ends.select("n0", "n1", "conv_id").repartitionByRange("n0", "n1", "conv_id").sortWithinPartitions("n0", "n1", "conv_id")
    cut = sorted_ends.mapInArrow(pieces, "n0 long, n1 long, number long, piece string").withColumn("part", F.spark_partition_id())
    return cut.repartition("n0", "n1").sortWithinPartitions("n0", "n1", "part", "number").mapInArrow(digests, "n0 long, n1 long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["n0", "n1", "ends_sha256"])


def prefix_trie(lengths: DataFrame, turns: DataFrame, work: Steps, block: int = BLOCK) -> DataFrame:
    """One row for each node of the trie of conversations: conv_id (its smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    ``lengths`` has conv_id (a long) and n_turns for each conversation, those without turns included; ``turns`` has conv_id, depth (dense, from
    1), digest and n_chars. n_leaves counts the childless nodes of a subtree; saved_tokens sums over it (n_convs - 1) * n_chars of each
    node's last turn; both take in the node itself. ends_sha256 is over the ids of the members that end in the node. Without any
    conversation there is no node. The result reads two of the steps of ``work``; the others are over.
    """
    steps = paths(turns, work, block)
    root = node_names(F.lit(0).cast("long"), [F.lit(0).cast("long")] * 4)
    at_root = [root[0].alias("n0"), root[1].alias("n1")]
    none = F.lit(None).cast("long")
    grouped = steps.groupBy("n0", "n1").agg(
        F.first("p0").alias("p0"), F.first("p1").alias("p1"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.first("n_chars").alias("n_chars"),
    )
    whole = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = whole.select(*at_root, none.alias("p0"), none.alias("p1"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_chars"))
    children = grouped.groupBy(F.col("p0").alias("n0"), F.col("p1").alias("n1")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = grouped.unionByName(top).join(children, ["n0", "n1"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = work.keep(nodes)
    above = nodes.select(F.col("n0").alias("p0"), F.col("n1").alias("p1"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_siblings"))
    placed = nodes.join(above, ["p0", "p1"], "left")
    branches = placed.where("n_siblings > 1").select("n0", "n1", F.col("conv_id").alias("mark"))

    last = steps.join(lengths, "conv_id").where("depth = n_turns").select("conv_id", "n0", "n1", "depth")
    ends = work.keep(last.unionByName(lengths.where("n_turns = 0").select("conv_id", *at_root, F.lit(0).cast("long").alias("depth"))))
    ranks = work.keep(ranked_sequences(steps, ends, branches, work))
    spans = steps.join(ranks, "conv_id").groupBy("n0", "n1").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    spans = spans.unionByName(ranks.agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first IS NOT NULL").select(*at_root, "first", "last"))

    leaf, saved = (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved")
    rows = placed.select("n0", "n1", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", leaf, saved).join(spans, ["n0", "n1"])
    preorder = rows.repartitionByRange("first", "depth").sortWithinPartitions("first", "depth")
    preorder = work.keep(running_totals(preorder.withColumn("part", F.spark_partition_id())))
    work.done(preorder, ends)
    carried = part_offsets(preorder, ["leaf", "saved"])
    totals = preorder.join(F.broadcast(carried), "part")  # a row for each partition
    totals = totals.withColumns({"leaves_to": F.col("leaves_to") + F.col("leaf_before"), "saved_to": F.col("saved_to") + F.col("saved_before")})
    behind = totals.groupBy(F.col("first").alias("last")).agg(F.max(F.struct("depth", "leaves_to", "saved_to")).alias("end"))
    out = totals.join(behind, "last").join(ends_digests(ends), ["n0", "n1"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("end.leaves_to") - F.col("leaves_to") + F.col("leaf")).alias("n_leaves"),
        (F.col("end.saved_to") - F.col("saved_to") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, share: bool = False, block: int = BLOCK) -> DataFrame:
    """prefix_trie of a table of conv_id, turn, role and text; with ``share`` the conversations are rebuilt by shared_starts first.

    Turns are ordered by turn, null first; of several with one turn the digest of role and text decides. Null role or text counts as empty.
    Repeated rows are turns of their own. Rows without conv_id belong to no conversation and are left out. An empty table gives an empty
    result; other columns are ignored, whatever their names. Texts and conversations may be of any length.
    """
    chosen = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    with Steps(conversations.sparkSession) as work:
        turns = work.keep(ordered_turns(chosen, work))
        if share:
            return prefix_trie(*shared_starts(turns), work, block)
        lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
        return prefix_trie(lengths, turns.withColumn("depth", F.col("pos") + 1).drop("pos"), work, block)
