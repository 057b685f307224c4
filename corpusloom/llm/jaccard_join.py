"""Similarity join on word shingles with count-vector R-trees.

A document is the set of its distinct five-word shingles, as 64-bit hashes. Two documents link when their
Jaccard similarity is at least 3/4, and documents get the smallest id that they reach by links.

1. One pass over the texts gives each document its set size, a key of its set (equal sets are one class, of which
   only the document with the smallest id goes on), a few least hashes of its set, and a point: its shingles are
   hashed into 128 groups, and the counts of the groups are the coordinates. The same pass counts shingles where it
   matters: of blocks of documents, each names those that it holds four times or more; the most frequent of
   these, a fixed number, come last in the shingle order.
2. Groups of near copies are tied together first, without their pairs: documents with an equal least hash meet, and
   each is compared with the leaders found so far, nearest point first, until one links; else it leads itself.
3. What is left is the exact search between different groups. Sets this similar share a shingle among their first
   n/4 + 1 in any common order. The rare ones come first, so a passage that many documents share stays out of
   these prefixes. A second pass deals the prefixes into cells, one per shingle. Cells of a single set or a single
   group are dropped, as are all but one of those with the same sets.
4. Each cell is an R-tree over points. The sum of the smaller coordinates of two points, or of the upper
   corners of two nodes, bounds the overlap from above, so whole branches fall away. Pairs that are left pass finer
   points, with a coordinate for every shingle, and then their sets are read and compared.

Large cells are split into tiles, and every pair of tiles is a tree of its own, so no group grows with the
table. Frequent shingles are spread over salts before anything is brought together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.sources.tables import Steps

WIDTH = 5
GROUPS = 128
FULL = 255  # a coordinate this large may stand for a larger one
SALTS = 64
LEAF = 32
BLOCK_CHARS = 8_000_000
LEAST = 4
CROWD = 512  # documents of one least hash that are compared in one go
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than five are one shingle."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # the byte-wise functions below misread an array with an offset
    bare = pc.ascii_trim(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")), " \t\n\x0b\x0c\r")
    lists = pc.ascii_split_whitespace(bare)
    coded = lists.flatten().dictionary_encode()
    hashed = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    words = hashed[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(bare, "").to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    total = max(len(words) - WIDTH + 1, 0)
    grams = np.zeros(total, np.uint64)
    for k in range(WIDTH):
        part = words[k : k + total]
        grams += (part ^ (part >> np.uint64(29))) * FACTORS[k]
    grams = _mixed(grams)
    out = []
    for size, end, empty in zip(sizes.tolist(), ends.tolist(), blank.tolist(), strict=True):
        if empty:
            out.append(np.empty(0, np.uint64))
        elif size < WIDTH:
            few = words[end - size : end]
            out.append(_mixed((few * FACTORS[:size]).sum(keepdims=True) + np.uint64(size)))
        else:
            out.append(np.unique(grams[end - size : end - WIDTH + 1]))
    return out


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=12).digest()


def point(hashes: np.ndarray) -> bytes:
    counts = np.bincount((hashes % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of overlaps: the sum of the smaller coordinates, without limit where both are full."""
    least = np.minimum(a, b)
    return least.sum(axis=-1, dtype=np.int64) + (least == FULL).any(axis=-1) * (1 << 40)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, sets) of as many rows at a time as hold some 8 million bytes of text."""
    for batch in batches:
        texts = batch.column("text")
        lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            base = lengths[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(lengths, base + BLOCK_CHARS, "right")))
            yield batch.column("doc_id").slice(start, stop - start).to_pylist(), shingle_sets(texts.slice(start, stop - start))
            start = stop


def least_hashes(hashes: np.ndarray) -> list[int]:
    """The least member of the set under each of LEAST hash orders; similar sets share one as often as they are similar."""
    if not len(hashes):
        return [0] * LEAST
    return [int((hashes * f ^ (hashes * f) >> np.uint64(31)).min().view(np.int64)) for f in FACTORS[:LEAST]]


def survey(docs: DataFrame) -> DataFrame:
    """Rows of kind 0: doc_id, n, set_key, point, least; rows of kind 1: shingles (n: how often) that a block holds often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "set_key", "point", "least", "token"]
        for ids, sets in blocks(batches):
            keys = [set_key(s) for s in sets]
            kinds = [pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            points = pa.array([fine_point(s) for s in sets], pa.binary())
            least = pa.array([least_hashes(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*kinds, pa.array(keys, pa.binary()), points, least, pa.nulls(len(ids), pa.int64())], names=names)
            unlike = list(dict(zip(keys, sets, strict=True)).values())
            tokens, counts = np.unique(np.concatenate([*unlike, np.empty(0, np.uint64)]), return_counts=True)
            tokens, counts = tokens[counts >= 4], counts[counts >= 4]
            no = pa.nulls(len(tokens), pa.int64())
            kinds = [pa.array(np.ones(len(tokens), np.int32)), no, pa.array(counts.astype(np.int64)), *[pa.nulls(len(tokens), pa.binary())] * 2, pa.nulls(len(tokens), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kinds, pa.array(tokens.view(np.int64))], names=names)

    return docs.mapInArrow(run, "kind int, doc_id long, n long, set_key binary, point binary, least array<long>, token long")


def prefix_rows(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """token, doc_id and often for the first n/4 + 1 shingles of each distinct set of a block.

    Shingles in ``frequent`` (ascending by frequency) come last in the order and are marked as often.
    """
    sorter = np.argsort(frequent)
    ordered = frequent[sorter]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in blocks(batches):
            tokens, owners, marks = [], [], []
            keyed = [(doc, s, set_key(s)) for doc, s in zip(ids, sets, strict=True) if len(s) and doc is not None]
            least: dict[bytes, int] = {}  # of equal sets the smallest id goes on, as in the classes
            for doc, _, key in keyed:
                least[key] = min(doc, least.get(key, doc))
            for doc, s, key in keyed:
                if least.get(key) != doc:
                    continue
                del least[key]
                take = len(s) // 4 + 1
                first, late = s[:take], s[:0]
                if len(ordered):
                    at = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
                    often = ordered[at] == s
                    first = s[~often][:take]
                    late = frequent[np.sort(sorter[at[often]])[: take - len(first)]]
                tokens += [first, late]
                owners += [doc, doc]
                marks += [False, True]
            if owners:
                reps = [len(t) for t in tokens]
                cut = (np.concatenate(tokens) >> np.uint64(20)).astype(np.int64)  # a shorter token can only add candidates
                columns = [pa.array(cut), pa.array(np.repeat(np.array(owners, np.int64), reps)), pa.array(np.repeat(np.array(marks), reps))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "doc_id", "often"])

    return docs.mapInArrow(run, "token long, doc_id long, often boolean")


def shared_cells(rows: DataFrame) -> DataFrame:
    """token, doc_id of the cells that hold more than one document.

    All steps use one exchange of the rows. A frequent token is dealt over salts, and only what its salts
    sum up to is brought together.
    """
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) + 1).otherwise(0).cast("int")
    dealt = rows.select("token", "doc_id", salt.alias("salt")).where("token IS NOT NULL AND salt IS NOT NULL").repartition("token", "salt")
    # filters on a key would move below the exchange and make one of its own for each; one on a maximum cannot
    ends = dealt.groupBy("token", "salt").agg(F.min("doc_id").alias("d1"), F.max("doc_id").alias("d2"), F.max("salt").alias("hot"))
    salted = ends.where("hot > 0").groupBy("token").agg(F.min("d1").alias("d1"), F.max("d2").alias("d2"), F.collect_set("salt").alias("salts"))
    several = ends.where("hot = 0 AND d1 != d2").select("token", "salt")
    several = several.unionByName(salted.where("d1 != d2").select("token", F.explode("salts").alias("salt")))
    return dealt.join(several, ["token", "salt"]).select("token", "doc_id")


HEAD = GROUPS + 4
FINEST = 1 << 16
#: The four counts in a byte of a fine point.
PAIRS_OF_BITS = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3


def fine_point(hashes: np.ndarray) -> bytes:
    """The plain point, then one with a coordinate for each shingle or so: a power of two, FINEST at most.

    Its counts take two bits each, up to 3; by how much they are larger in all stands before them.
    """
    groups = min(max(GROUPS, 1 << (len(hashes) - 1).bit_length()), FINEST) if len(hashes) else GROUPS
    counts = np.bincount((hashes % np.uint64(groups)).astype(np.int64), minlength=groups)
    least = np.minimum(counts, 3).astype(np.uint8).reshape(-1, 4)
    packed = least[:, 0] | least[:, 1] << 2 | least[:, 2] << 4 | least[:, 3] << 6
    return point(hashes) + int(counts.sum() - least.sum(dtype=np.int64)).to_bytes(4, "little") + packed.tobytes()


def spread(fine: bytes) -> tuple[np.ndarray, int]:
    """The counts of a fine point, and what they leave out."""
    return PAIRS_OF_BITS[np.frombuffer(fine, np.uint8, offset=HEAD)].reshape(-1), int.from_bytes(fine[GROUPS:HEAD], "little")


def spread_bounds(one: tuple[np.ndarray, int], others: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Upper bounds of the overlaps of one with others of one length.

    Where both counts are 3, both may be larger, by the smaller excess in all at most. A longer point is folded to the shorter one's length; then
    a count may be larger beside any other, by both excesses at most.
    """
    x, extra = one
    ys, extras = np.stack([y for y, _ in others]), np.array([e for _, e in others], np.int64)
    size = min(len(x), ys.shape[1])
    if len(x) == ys.shape[1]:
        return np.minimum(x, ys).sum(axis=1, dtype=np.int64) + np.minimum(extra, extras)
    x = x.reshape(-1, size).sum(axis=0, dtype=np.int32)
    ys = ys.reshape(len(ys), -1, size).sum(axis=1, dtype=np.int32)
    return np.minimum(x, ys).sum(axis=1, dtype=np.int64) + extra + extras


def fine_bound(a: bytes, b: bytes) -> int:
    """An upper bound of the overlap from two fine points."""
    return int(spread_bounds(spread(a), [spread(b)])[0])


def folded(fine: bytes) -> np.ndarray:
    """The plain point that goes with a fine one."""
    return np.frombuffer(fine, np.uint8, GROUPS)


def packed_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, members (48 bits of each shingle hash, sorted) and fine, the fine point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in blocks(batches):
            members = [np.unique(s & np.uint64((1 << 48) - 1)) for s in sets]
            packed = [m.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for m in members]
            columns = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(packed, pa.binary()), pa.array([fine_point(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "members", "fine"])

    return docs.mapInArrow(run, "doc_id long, n long, members binary, fine binary")


def unpacked(members: bytes) -> np.ndarray:
    wide = np.zeros((len(members) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(members, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    one = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("mb")), "b")
    two = one.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("ma")), "a").select("a", "b", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([linked(unpacked(x), unpacked(y)) for x, y in sides], pa.bool_()))

    return two.mapInArrow(run, "a long, b long")


def led(cells: DataFrame) -> DataFrame:
    """Links (a, b) found in rows (cell, salt, lead, doc_id, grp, n, members, fine) that are sorted by the first four.

    Each document is compared with the leaders so far of its cell and salt, if they are of other groups, the one whose
    point promises most first, until one links; without any it becomes a leader. Two groups are linked once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, points, sizes, groups, sets, ids, tied = None, [], [], [], [], [], {}

        def root(g: int) -> int:
            while g in tied:
                g = tied[g]
            return g

        for batch in batches:
            found = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("cell", "salt", "doc_id", "grp", "n", "members", "fine")), strict=True)
            for cell, salt, doc, grp, n, members, fine in rows:
                if (cell, salt) != here:
                    here, points, sizes, groups, sets, ids, tied = (cell, salt), [], [], [], [], [], {}
                own, mine, link = folded(fine), None, False
                if ids:
                    fits = 7 * bounds(np.stack(points), own[None, :]) - 3 * (np.array(sizes) + n)
                    for k in np.argsort(-fits, kind="stable").tolist():
                        if fits[k] < 0:
                            break
                        if root(groups[k]) == root(grp):
                            link = True
                            break
                        if 4 * min(sizes[k], n) < 3 * max(sizes[k], n) or 7 * fine_bound(sets[k][1], fine) < 3 * (sizes[k] + n):
                            continue
                        mine = unpacked(members) if mine is None else mine
                        if linked(sets[k][0], mine):
                            found.append((ids[k], doc))
                            tied[root(grp)] = root(groups[k])
                            link = True
                            break
                if not link:
                    points.append(own)
                    sizes.append(n)
                    groups.append(grp)
                    sets.append((unpacked(members), fine))
                    ids.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def star_links(least: DataFrame, sets: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Links between documents that share a least hash; least has cell and doc_id, groups id and component_id.

    A cell of many documents is dealt over salts, each of which also gets the cell's first document as a leader.
    """
    named = least.withColumn("grp", F.col("doc_id"))
    if groups is not None:
        named = least.join(groups.select(F.col("id").alias("doc_id"), F.col("component_id").alias("grp")), "doc_id", "left").withColumn("grp", F.coalesce("grp", "doc_id"))
    span = named.groupBy("cell").agg(F.min("grp").alias("g1"), F.max("grp").alias("g2"), F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first"))
    mixed = named.join(span.where("g1 != g2").select("cell", "size", "first"), "cell")
    salts = F.ceil(F.col("size") / CROWD).cast("int")
    lead = F.col("doc_id") == F.col("first")
    at = F.when(lead, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), salts).cast("int")))
    dealt = mixed.select("cell", "doc_id", "grp", (~lead).alias("follows"), F.explode_outer(at).alias("salt"))
    met = dealt.join(sets, "doc_id").repartition("cell", "salt").sortWithinPartitions("cell", "salt", "follows", "doc_id")
    return led(met.select("cell", "salt", "doc_id", "grp", "n", "members", "fine"))


class RTree:
    """Points of one cell, halved along the coordinate of the widest spread down to leaves; nodes keep upper corners."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.nodes: list[tuple[np.ndarray, int, tuple[int, int] | None, np.ndarray | None]] = []
        self.leaves: list[int] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        corner, least = self.points[rows].max(axis=0), int(self.sizes[rows].min())
        if len(rows) <= LEAF:
            self.nodes.append((corner, least, None, rows))
            self.leaves.append(len(self.nodes) - 1)
            return len(self.nodes) - 1
        axis = int(np.argmax(corner - self.points[rows].min(axis=0)))
        rows = rows[np.argsort(self.points[rows, axis], kind="stable")]
        below = self._build(rows[: len(rows) // 2]), self._build(rows[len(rows) // 2 :])
        self.nodes.append((corner, least, below, None))
        return len(self.nodes) - 1

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of all pairs that may link, each pair once, a leaf against a leaf at a time."""
        for leaf in self.leaves:
            corner, least, _, rows = self.nodes[leaf]
            todo = [self.root]
            while todo:
                other, small, below, partners = self.nodes[k := todo.pop()]
                if 7 * int(bounds(corner, other)) < 3 * (least + small):
                    continue
                if below is not None:
                    todo += below
                    continue
                if k > leaf:
                    continue
                bound = bounds(self.points[rows][:, None, :], self.points[partners][None, :, :])
                x, y = self.sizes[rows][:, None], self.sizes[partners][None, :]
                fits = (7 * bound >= 3 * (x + y)) & (4 * np.minimum(x, y) >= 3 * np.maximum(x, y))
                i, j = np.nonzero(fits)
                keep = rows[i] < partners[j] if k == leaf else np.ones(len(i), bool)
                yield rows[i[keep]], partners[j[keep]]


def meet(points: np.ndarray, sizes: np.ndarray, groups: np.ndarray, tiles: np.ndarray | None) -> np.ndarray:
    """Pairs of rows (two rows of numbers) of different groups in one cell that its R-tree leaves.

    If tiles are given, the two are of different tiles.
    """
    found = [np.empty((2, 0), np.int64)]
    for i, j in RTree(points, sizes).pairs():
        keep = groups[i] != groups[j]
        if tiles is not None:
            keep &= tiles[i] != tiles[j]
        found.append(np.stack([i[keep], j[keep]]))
    return np.concatenate(found, axis=1)


def meet_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """meet() for every cell of a partition that is sorted by cell; what the finer points allow is left. A cell has a bounded number of rows."""
    names = ["token", "lo", "hi", "doc_id", "n", "grp", "tile", "point"]
    known: set[tuple[int, int]] = set()

    def promising(fine: list[bytes], sizes: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
        """Which pairs of rows the fine points allow; the partners of one row are looked at together, by the length of their points."""
        counts: dict[int, tuple[np.ndarray, int]] = {}
        for k in {k for p in pairs for k in p}:
            counts[k] = spread(fine[k])
        fits, groups = np.zeros(len(pairs), bool), {}
        for at, (i, j) in enumerate(pairs):
            groups.setdefault((i, len(counts[j][0])), []).append(at)
        for (i, _), where in groups.items():
            for start in range(0, len(where), 256):
                part = where[start : start + 256]
                others = [pairs[at][1] for at in part]
                fits[part] = 7 * spread_bounds(counts[i], [counts[j] for j in others]) >= 3 * (sizes[i] + sizes[others])
        return fits

    def pairs_in(table: pa.Table, cuts: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        _, lo, hi, ids, sizes, groups, tiles = columns
        fine = table.column("point").to_pylist()
        points = np.stack([folded(x) for x in fine])
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s = slice(a, b)
            if (groups[s] != groups[a]).any():
                i, j = a + meet(points[s], sizes[s], groups[s], None if lo[a] == hi[a] else tiles[s])
                found.update(zip(zip(*np.sort(np.stack([ids[i], ids[j]]), axis=0).tolist(), strict=True), zip(i.tolist(), j.tolist(), strict=True), strict=True))
        new = {p: at for p, at in found.items() if p not in known}
        if len(known) > 1_000_000:  # a pair that comes again is looked at again
            known.clear()
        known.update(new)
        good = [p for p, fits in zip(new, promising(fine, sizes, list(new.values())), strict=True) if fits]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in good], pa.int64()) for k in (0, 1)], names=["a", "b"])

    waiting: pa.Table | None = None

    def cells(table: pa.Table, last: bool) -> pa.RecordBatch:
        nonlocal waiting
        columns = [table.column(c).to_numpy().astype(np.int64) for c in names[:-1]]
        new = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
        cuts = np.concatenate([[0], np.nonzero(new)[0] + 1, [len(table)]])
        if not last:
            waiting, cuts = table.slice(cuts[-2]), cuts[:-1]
        return pairs_in(table, cuts, columns)

    for batch in batches:
        table = pa.Table.from_batches([batch.select(names)])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        if len(table):
            yield cells(table.combine_chunks(), False)
    if waiting is not None:
        yield cells(waiting.combine_chunks(), True)


def unlike_cells(cells: DataFrame) -> DataFrame:
    """cells without those that hold the same documents as another one: of these, the smallest token stays."""
    sums = [F.min("doc_id").alias("d1"), F.max("doc_id").alias("d2"), F.count(F.lit(1)).alias("size")]
    sums += [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    kept = cells.groupBy("token").agg(*sums).groupBy("d1", "d2", "size", "x1", "x2").agg(F.min("token").alias("token"))
    return cells.join(kept.select("token"), "token", "left_semi")


def tree_pairs(cells: DataFrame, points: DataFrame, tile_rows: int = 1024) -> DataFrame:
    """Candidate pairs (a, b) of different groups from cells (token, doc_id, grp) and fine points (doc_id, n, point)."""
    sizes = cells.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    tiles = F.ceil(F.col("size") / tile_rows).cast("int")
    dealt = cells.join(sizes, "token").withColumn("tile", F.pmod(F.xxhash64("doc_id"), tiles).cast("int"))
    dealt = dealt.select("token", "doc_id", "grp", "tile", F.explode_outer(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    dealt = dealt.select("token", "doc_id", "grp", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    dealt = dealt.join(points, "doc_id").repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    return dealt.mapInArrow(meet_all, "a long, b long").distinct()


def between_groups(cells: DataFrame, groups: DataFrame, reps: DataFrame, work: Steps) -> DataFrame:
    """The rows (token, doc_id, grp) of representatives in cells in which different groups of like sizes meet.

    Sets that link differ in size by a third at most. Sizes fall into bands of that width, and each set is in its own band
    and the next, so that any two such sets share one; a cell is split by these.
    """
    named = cells.join(groups.select(F.col("id").alias("doc_id"), F.col("component_id").alias("grp")), "doc_id", "left").withColumn("grp", F.coalesce("grp", "doc_id"))
    band = F.floor(F.log(F.col("n")) / math.log(4 / 3) + 1e-9)
    banded = named.join(reps.select("doc_id", F.explode(F.array(band, band + 1)).alias("band")), "doc_id")
    banded = banded.select(F.xxhash64("token", "band").alias("token"), "doc_id", "grp")
    span = banded.groupBy("token").agg(F.min("grp").alias("g1"), F.max("grp").alias("g2")).where("g1 != g2")
    return unlike_cells(work.keep(banded.join(span.select("token"), "token", "left_semi")))


def _packed(links: DataFrame) -> DataFrame:
    """links in partitions of some size. A step has a file for each partition, and where files are local each one costs its executor a process."""
    return links.hint("rebalance")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = 65_536) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs.

    ``frequent`` is how many of the commonest shingles are put last in the order, which changes the work but
    not the result. Null, empty and blank texts have no shingles and link with nothing. Ids are integers;
    repeated rows get the same result each; rows with one id and different texts share their links; a null id is its own
    component (null) unless a row with an id has the same shingles. Other columns are ignored.
    """
    return _labelled(docs, id_col, text_col, frequent).drop("set_key")


def _labelled(docs: DataFrame, id_col: str, text_col: str, frequent: int = 65_536) -> DataFrame:
    """similar_documents with set_key, which rows of equal shingle sets share."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Steps(docs.sparkSession) as work:
        seen = work.keep(survey(narrow))
        about = work.keep(seen.where("kind = 0").select("doc_id", "n", "set_key"))
        often = seen.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(frequent)
        order = np.array([r["token"] for r in often.collect()], np.int64)[::-1].view(np.uint64).copy()  # at most ``frequent`` numbers
        whole = seen.where("kind = 0 AND n > 0 AND doc_id IS NOT NULL")
        classes = whole.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("point").alias("point"), F.min("least").alias("least"))
        classes = work.keep(classes)
        work.drop(seen)
        whole = about.where("n > 0 AND doc_id IS NOT NULL")
        reps = classes.select("doc_id", "n", "point")

        # near copies are tied to leaders
        least = classes.select("doc_id", F.posexplode("least").alias("k", "cell"))
        alone = least.groupBy("cell").agg(F.min("doc_id").alias("d1"), F.max("doc_id").alias("d2")).where("d1 != d2").select("cell")
        least = work.keep(least.join(alone, "cell"))
        alive = least.select("doc_id").distinct()
        sets = work.keep(packed_sets(narrow.join(alive, "doc_id", "left_semi")))
        links = work.keep(_packed(star_links(least.where("k = 0").select("cell", "doc_id"), sets)))
        groups = components(links, work)
        more = star_links(least.where("k > 0").select("cell", "doc_id"), sets, groups)
        clash = whole.groupBy("doc_id").agg(F.min("set_key").alias("k1"), F.max("set_key").alias("k2")).where("k1 != k2").select("doc_id")
        same_id = whole.join(clash, "doc_id", "left_semi").join(classes.select("set_key", F.col("doc_id").alias("a")), "set_key").select("a", F.col("doc_id").alias("b"))
        links = links.union(work.keep(_packed(more.union(same_id))))
        groups = components(links, work)

        # the exact search between groups
        cells = work.keep(shared_cells(prefix_rows(narrow, order)))
        between = work.keep(between_groups(cells, groups, reps, work))
        work.drop(cells)
        pairs = work.keep(tree_pairs(between, reps))
        if not pairs.isEmpty():
            asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
            other = narrow.join(asked.join(alive, "doc_id", "left_anti"), "doc_id", "left_semi")
            near = work.keep(sets.union(packed_sets(other)).join(asked, "doc_id", "left_semi"))
            groups = components(links.union(work.keep(_packed(verify(pairs, near)))), work)

        label = groups.select(F.col("id").alias("doc_id"), "component_id")
        of_class = classes.select("set_key", "doc_id").join(label, "doc_id", "left").select("set_key", F.coalesce("component_id", "doc_id").alias("component_id"))
        out = about.join(of_class, "set_key", "left")
        component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
        out = work.keep(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "set_key"))
        work.done(out)
        return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component.

    A row with a null id stays unless its shingles are those of a row with an id, whose component has a
    smallest id to stay for it. Such rows are known by 64 bits of their texts' hashes.
    """
    labels = _labelled(docs, id_col, text_col)
    taken = {c.lower() for c in docs.columns}
    kept, gone = (next(n for n in (f"{name}{i}" for i in range(len(taken) + 1)) if n not in taken) for name in ("kept_id", "gone"))
    has_id, text = F.col(id_col).cast("long").isNotNull(), F.col(text_col).cast("string")
    found = labels.where("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    named = docs.join(found, F.col(id_col) == F.col(kept), "left_semi")
    nameless = docs.where(~has_id)
    if nameless.isEmpty():
        return named
    keys = survey(nameless.select(F.xxhash64(text).alias("doc_id"), text.alias("text")).dropna()).where("n > 0")
    held = labels.where("doc_id IS NULL AND component_id IS NOT NULL").select("set_key").distinct()
    over = keys.join(held, "set_key", "left_semi").select(F.col("doc_id").alias(gone)).distinct()
    return named.unionByName(nameless.join(over, F.xxhash64(text) == F.col(gone), "left_anti"))
