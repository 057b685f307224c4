"""Periodic runs of words by harmonic grid probing.

A run with period p is a stretch of words that equal the word p places on, at least four periods long. Its
equal places cover 3p words or more, so at least three neighbouring multiples of p lie among them, wherever it
begins. For each period only the grid is probed: is word jp the same as word (j+1)p? That is n/p probes for a period and
about n log n for all. Where enough neighbouring probes agree, the stretch is extended both ways by comparing
chunks of arrays, and the grid goes on behind it. Periods are tried in rising order, so a stretch that is
found again by a multiple of its smallest period lies in a run that is known, and its grid points are skipped.

All texts of a block are probed together, longest first and parted by words that occur nowhere else, so that those long enough for
a period are the first part of one array. Nothing is exchanged between tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8_000_000
SPACES = " \t\n\x0b\x0c\r"
LEAST_WORDS, LEAST_PERIODS = 6, 4
CELL = 64  # words; known runs are looked up by such stretches

Run = tuple[int, int, int]


def _equal(words: np.ndarray, at: int, p: int, step: int) -> int:
    """How many places from ``at`` on, in the direction of ``step``, hold the same word as the place p later."""
    limit = len(words) - p - at if step > 0 else at + 1
    done, size = 0, 32
    while done < limit:
        size = min(size * 2, 1 << 16, limit - done)
        a = at + done if step > 0 else at - done - size + 1
        same = words[a : a + size] == words[a + p : a + p + size]
        if not same.all():
            return done + int(np.argmin(same if step > 0 else same[::-1]))
        done += size
    return done


def find_runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """(start, length, period) of the runs of each text, by start and period. Texts are arrays of word numbers from 0."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    parts = [x for k, i in enumerate(order) for x in (texts[i], np.array([-1 - k]))]
    words = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    ends = np.cumsum(sizes[order] + 1)  # behind each text's parting word
    starts = ends - sizes[order] - 1
    falling = -sizes[order]
    found: list[list[Run]] = [[] for _ in texts]
    known: dict[int, list[Run]] = defaultdict(list)
    for p in range(1, int(sizes.max(initial=0)) // LEAST_PERIODS + 1):
        least = max(LEAST_WORDS, LEAST_PERIODS * p)
        held = int(np.searchsorted(falling, -least, "right"))  # texts with that many words
        if not held:
            break
        stop = int(ends[held - 1])
        hits = np.flatnonzero(words[: stop - p : p] == words[p:stop:p])
        need = (least - p) // p
        if len(hits) < need:
            continue
        firsts = hits[: len(hits) - need + 1]
        behind = 0
        for x in (firsts[hits[need - 1 :] - firsts == need - 1] * p).tolist():
            if x < behind:
                continue
            over = next((e - p for s, e, q in known[x // CELL] if s <= x < e - p and p % q == 0), None) if x // CELL in known else None
            if over is not None:
                behind = over
                continue
            behind = x + _equal(words, x, p, 1)
            start = x + 1 - _equal(words, x, p, -1)
            if behind + p - start >= least:
                run = start, behind + p, p
                for cell in range(start // CELL, (behind + p) // CELL + 1):
                    known[cell].append(run)
                k = int(np.searchsorted(starts, start, "right")) - 1
                found[order[k]].append((start - int(starts[k]), behind + p - start, p))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def replanted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten, by a checksum of its id, which original word stands at each place; else None."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), np.resize(np.arange(a, a + p), n - a)])


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """The places of the words that no run contains behind its first period."""
    edges = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.flatnonzero(np.cumsum(edges[:n]) == 0)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """As many rows at a time as hold some 8 MB of text; a longer text is a block of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCK_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _scan(block: pa.RecordBatch, replant: bool) -> pa.RecordBatch:
    texts = block.column("text").take(pa.array(np.arange(block.num_rows)))  # byte-wise functions misread an array with an offset
    bare = pc.ascii_trim(pc.fill_null(texts.cast(pa.large_string()), ""), SPACES)
    split = pc.ascii_split_whitespace(bare)
    words, bounds = split.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))])
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    blank = pc.equal(bare, "").to_numpy(zero_copy_only=False)
    plain = pc.binary_join(split, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()
    ids = block.column("doc_id").to_pylist()
    places, texts_of = [], []
    for k, doc_id in enumerate(ids):
        own = codes[bounds[k] : bounds[k] if blank[k] else bounds[k + 1]]
        places.append(replanted(doc_id, len(own)) if replant else None)
        texts_of.append(own if places[k] is None else own[places[k]])
    rows = []
    for k, runs in enumerate(find_runs(texts_of)):
        n = len(texts_of[k])
        if not n:
            text = b""
        elif not runs and places[k] is None:
            text = plain[k]
        else:
            left = kept_words(n, runs)
            at = bounds[k] + (left if places[k] is None else places[k][left])
            text = " ".join(words.take(pa.array(at)).to_pylist()).encode()
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
        rows.append((len(runs), *best, 1000 * best[1] // best[2] if runs else None, runs, text, _sha(listed)))
    columns = list(zip(*rows, strict=True))
    numbers = [pa.array(c, pa.int64()) for c in columns[:5]]
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    listed = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in columns[5]], run)
    digests = [pa.array(columns[7]), pa.array([_sha(t) for t in columns[6]])]
    return pa.RecordBatch.from_arrays(
        [block.column("doc_id"), *numbers, listed, pa.array([t.decode() for t in columns[6]], pa.large_string()).cast(pa.string()), *digests],
        names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed", "runs_sha256", "collapsed_sha256"],
    )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", replant: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run with the most periods, runs, collapsed,
    runs_sha256 and collapsed_sha256 for each row of docs, in one pass without an exchange.

    ``runs`` lists all of them; ``collapsed`` is the text with each run cut down to its first period, its words parted by one space.
    Of equal exponents the smallest start and then the smallest period counts; the exponent is cut down to thousandths.
    With ``replant`` one document in ten has its own words repeated first, by a rule over its id, which gives the operator
    periods of every length to find.

    Null text counts as empty: no runs, empty collapsed text. A null id is never replanted. Repeated rows are judged one by one;
    an empty table gives an empty result; other columns are ignored, whatever their names. Texts may be of any length: a text is
    held in one task, with some 40 bytes for each of its words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                yield _scan(block, replant)

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        run,
        f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs array<struct<start:long,length:long,period:long>>, collapsed string, runs_sha256 string, collapsed_sha256 string",
    )
