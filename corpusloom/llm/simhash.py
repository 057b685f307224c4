"""SimHash near duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits link when at most two bits differ. A fingerprint is cut into three segments. Of two
fingerprints that link, one segment is the same in both, and the segment that follows it (the first follows the last) differs in
one bit at most: two bits in one segment leave the other two alone, and of two bits in two segments one at most lies in
either. So a key is one segment as it is, with the number of a codeword near the next one.

The perfect binary Golay code has 4,096 codewords of 23 bits, and every word of 23 bits is within three bits of exactly one. A
segment is decoded as it is (its home codeword) and with each of its bits flipped: at most six codewords. If two segments differ in one
bit, the home codeword of one is among the codewords of the other. Rows of one key meet, and the fingerprints themselves are compared.

A key that many fingerprints share (CROWD rows) is not compared pair by pair. Its fingerprints go another exact way: each
is written as itself and with each of its 64 bits flipped. Two fingerprints link just when one of these words is common to both, and
at most 65 different fingerprints share a word, all of them linked; each is tied to the smallest. That costs 65 rows for each fingerprint,
however they lie. So no group that meets in a task grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.sources.tables import Steps

WIDTH, SEED = 3, 42
MOST_BITS = 2
SPACES = " \t\n\x0b\x0c\r"
BLOCK_BYTES = 2_000_000
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the perfect binary Golay code.
GENERATOR = 0b101011100011
CROWD = 256
PROBE, HOME, CROWDED = 0, 1, 2


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """As many rows at a time as hold some 2 MB of text; a longer text is a block of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _shingle_hashes(text: bytes, sizes: np.ndarray) -> list[int]:
    """XXH64 of each shingle of a text whose words, ``sizes`` bytes long, are parted by one space."""
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(WIDTH, len(sizes))
    digest = xxhash.xxh64_intdigest
    return [digest(text[a:b], SEED) for a, b in zip(starts[: len(sizes) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def bits_of_majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * counts > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                texts = block.column("text").take(pa.array(np.arange(block.num_rows)))  # byte-wise functions misread an array with an offset
                bare = pc.ascii_trim(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")), SPACES)
                split = pc.ascii_split_whitespace(bare)
                lengths = pc.binary_length(split.flatten()).to_numpy().astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))])
                joined = pc.binary_join(split, pa.scalar(" ", pa.large_string())).cast(pa.large_binary())
                made = np.zeros(block.num_rows, np.uint64)
                for k, text in enumerate(joined):
                    if raw := text.as_py():
                        made[k] = bits_of_majority(np.array(_shingle_hashes(raw, lengths[bounds[k] : bounds[k + 1]]), np.uint64))
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each power of x by the generator, and the error of at most three bits for each remainder."""
    powers = []
    for k in range(23):
        rest = 1 << k
        for bit in range(k, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << bit - 11
        powers.append(rest)
    errors = np.zeros(1 << 11, np.uint32)
    for n in range(1, 4):
        for bits in combinations(range(23), n):
            rest = 0
            for b in bits:
                rest ^= powers[b]
            errors[rest] = sum(1 << b for b in bits)
    return np.array(powers, np.uint32), errors


def near_codewords(words: np.ndarray, bits: int) -> np.ndarray:
    """Of each word, a row of codeword numbers: its own, then those of the word with each of its lowest ``bits`` flipped."""
    powers, errors = golay()
    rest = np.zeros(len(words), np.uint32)
    for k in range(23):
        rest ^= powers[k] * (words >> np.uint32(k) & np.uint32(1))
    out = np.empty((len(words), bits + 1), np.uint32)
    out[:, 0] = (words ^ errors[rest]) >> np.uint32(11)
    for k in range(bits):
        out[:, k + 1] = (words ^ np.uint32(1 << k) ^ errors[rest ^ powers[k]]) >> np.uint32(11)
    return out


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place of the fingerprint, whether its home codeword is meant) for each different key of each fingerprint."""
    words = [(fps >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.uint32) for low, n in SEGMENTS]
    made = []
    for k, exact in enumerate(words):
        after = (k + 1) % len(words)
        near = near_codewords(words[after], SEGMENTS[after][1])
        home = near[:, :1].copy()
        near.sort(axis=1)
        row, column = np.nonzero(np.concatenate([np.ones_like(home, bool), near[:, 1:] != near[:, :-1]], axis=1))
        code = near[row, column]
        key = np.uint64(k) << np.uint64(34) | exact[row].astype(np.uint64) << np.uint64(12) | code.astype(np.uint64)
        made.append((key.view(np.int64), row, code == home[row, 0]))
    return tuple(np.concatenate(c) for c in zip(*made, strict=True))


def _rows(key: np.ndarray, fp: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp, pa.int64()), pa.array(kind, pa.int32())], names=["key", "fp", "kind"])


def keyed(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """key, fp, kind (PROBE or HOME) for distinct fingerprints. Of a key that a batch holds over ``crowd`` times only one row goes on, of
    kind CROWDED; its fingerprints get rows without a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy()
            key, row, home = keys_of(values.view(np.uint64))
            _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
            many = counts[back] > crowd
            yield _rows(key[~many], values[row[~many]], home[~many].astype(np.int32))
            if many.any():
                crowded = np.unique(key[many])
                yield _rows(crowded, np.zeros(len(crowded), np.int64), np.full(len(crowded), CROWDED))
                fp = np.unique(values[row[many]])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(fp), pa.int64()), pa.array(fp), pa.array(np.full(len(fp), CROWDED, np.int32))], names=["key", "fp", "kind"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, kind int")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that tie together what the given ones do, none of them needless."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def _compared(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one key, a home among them, whose fingerprints differ in at most two bits; rows are sorted by key."""
    at, apart, left, right = np.arange(len(key)), 1, [], []
    while len(at := at[at + apart < len(key)]) and len(at := at[key[at] == key[at + apart]]):
        a, b = fp[at], fp[at + apart]
        good = (np.bitwise_count((a ^ b).view(np.uint64)) <= MOST_BITS) & (a != b) & (home[at] | home[at + apart])
        left.append(a[good])
        right.append(b[good])
        apart += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _pairs(a: list[int] | np.ndarray, b: list[int] | np.ndarray | None) -> pa.RecordBatch:
    other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), other], names=["a", "b"])


def met(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links a, b of fingerprints that meet in a key; b is null for the fingerprints of crowded keys.

    Rows come sorted by key, CROWDED first, so a task holds one batch and ``crowd`` rows of the key that is not over yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.empty(0, np.int64)
        kind = np.empty(0, np.int32)
        crowded = -1  # the last key, if it is known to be crowded

        def done(key: np.ndarray, fp: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
            firsts = np.append(True, key[1:] != key[:-1])
            many = (counts > crowd) | (kind[firsts] == CROWDED)
            if many.any():
                gone = many[back]
                yield _pairs(np.unique(fp[gone & (kind != CROWDED)]), None)
                key, fp, kind = key[~gone], fp[~gone], kind[~gone]
            yield _pairs(*_forest(*_compared(key, fp, kind == HOME)))

        for batch in batches:
            none = batch.column("key").is_null().to_numpy(zero_copy_only=False)
            if none.any():
                yield _pairs(batch.column("fp").to_numpy()[none], None)
                batch = batch.filter(pa.array(~none))
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy()])
            kind = np.concatenate([kind, batch.column("kind").to_numpy()])
            if crowded >= 0:
                same = int(np.searchsorted(key, crowded, "right"))
                yield _pairs(np.unique(fp[:same]), None)
                key, fp, kind = key[same:], fp[same:], kind[same:]
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if last:
                yield from done(key[:last], fp[:last], kind[:last])
            key, fp, kind = key[last:], fp[last:], kind[last:]
            crowded = -1
            if len(key) > crowd or kind[0] == CROWDED:
                crowded = int(key[0])
                yield _pairs(np.unique(fp[kind != CROWDED]), None)
                key, fp, kind = key[:0], fp[:0], kind[:0]
        if len(key):
            yield from done(key, fp, kind)

    return rows.repartition("key").sortWithinPartitions("key", F.desc("kind")).mapInArrow(run, "a long, b long")


def flipped_links(fps: DataFrame) -> DataFrame:
    """Links a, b that tie together all fingerprints (column fp) at most two bits apart, by the words one bit away from each."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    words = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    groups = words.groupBy("word").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    links = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return links.where("a != b").distinct()


def similar_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for each row of docs.

    component_id is the smallest id that is reached by links, the document's own included. Null text counts as empty; texts
    without words have fingerprint zero and are linked like others. Null ids are never a component_id, unless nothing
    in the component has an id. Repeated rows, and rows that share an id but not the text, are judged one by one. An empty table
    gives an empty result; other columns are ignored, whatever their names. Texts may be of any length.
    """
    with Steps(docs.sparkSession) as work:
        rows = work.keep(fingerprints(docs, id_col, text_col))
        different = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
        found = work.keep(met(keyed(different)))
        crowded = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
        links = found.where("b IS NOT NULL").unionByName(flipped_links(crowded))
        groups = components(links, work).withColumnsRenamed({"id": "fp", "component_id": "label"})
        labelled = different.join(groups, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
        smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
        named = work.keep(labelled.join(smallest, "label").select("fp", "component_id"))
        work.done(rows, named)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
