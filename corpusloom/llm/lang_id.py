"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. The vector of a letter trigram is
the product of its three letter vectors, each rotated by its place; a text's vector is the sum of the vectors
of its trigrams, and a language's prototype the sum over its texts, each text weighing the same. A text gets
the language whose prototype has the largest cosine with it.

Learning sums trigram weights inside each task and sends one vector per language and task, so that what
moves does not grow with the texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
UNKNOWN = "und"
SPACE = 32


@lru_cache(maxsize=2)
def letters(kinds: str = "LM") -> np.ndarray:
    """For each code point, whether it is a letter (L) or a mark (M)."""
    return np.array([unicodedata.category(chr(p))[0] in kinds for p in range(0x110000)])


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point, by mixing the bits of (code point, word number)."""
    words = np.arange(DIM // 64, dtype=np.uint64)
    x = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (words + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(points), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


def bind(codes: np.ndarray) -> np.ndarray:
    """The vectors of packed trigrams."""
    made = np.ones((len(codes), DIM), np.int8)
    for place in range(3):
        points = codes >> (21 * place) & 0x1FFFFF
        found, at = np.unique(points, return_inverse=True)
        made *= np.roll(letter_vectors(found), place, axis=1)[at]
    return made


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct trigrams of a text's words, packed, and how often each occurs; None without any letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not letters("L")[points].any():
        return None
    points = np.where(letters()[points], points, SPACE)
    points = points[(points != SPACE) | np.append(True, points[:-1] != SPACE)]
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)


class Vectors:
    """Trigram vectors made so far by this process, at most ``limit`` of them."""

    def __init__(self, limit: int = 60_000):
        self.limit, self.rows, self.table = limit, {}, np.empty((0, DIM), np.float32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        names = codes.tolist()
        new = [c for c in names if c not in self.rows]
        if new:
            if len(self.rows) + len(new) > self.limit:
                self.rows.clear()
                new = names
                if len(new) > self.limit:
                    self.rows, self.table = {}, np.empty((0, DIM), np.float32)
                    return bind(codes).astype(np.float32)
            used = len(self.rows)
            if used + len(new) > len(self.table):
                grown = np.empty((min(self.limit, max(4096, 2 * (used + len(new)))), DIM), np.float32)
                grown[:used] = self.table[:used]
                self.table = grown
            self.table[used : used + len(new)] = bind(np.array(new, np.int64))
            self.rows.update((c, used + k) for k, c in enumerate(new))
        return self.table[[self.rows[c] for c in names]]


@lru_cache(maxsize=1)
def vectors() -> Vectors:
    return Vectors()


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)) == 0


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The prototype of each language in docs, of unit length. Rows without language or letters teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            found: dict[str, list] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if (t := trigrams(text)) is not None:
                    found.setdefault(lang, [sums[lang]] if lang in sums else []).append((t[0], t[1] / t[1].sum()))
            for lang, parts in found.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                sums[lang] = codes, np.bincount(at, np.concatenate([p[1] for p in parts]))
        for lang, (codes, weights) in sums.items():
            total = np.zeros(DIM)
            for k in range(0, len(codes), 4096):
                total += weights[k : k + 4096] @ bind(codes[k : k + 4096])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * DIM, pa.string()), pa.array(range(DIM), pa.int32()), pa.array(total)], names=["lang", "k", "v"]
            )

    known = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = known.dropna().mapInArrow(run, "lang string, k int, v double").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x DIM numbers
        found.setdefault(r["lang"], np.zeros(DIM))[r["k"]] = r["v"]
    return {k: v / n for k, v in sorted(found.items()) if (n := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 at least) for each row of docs.

    Null text and text without a letter give ``und`` and 0, as does a model that learned nothing. Of equal
    cosines the first language by name wins. Repeated rows are judged one by one; other columns are ignored.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float32).reshape(len(names), DIM)

    def judge(text: str | None) -> tuple[str, float]:
        if not text or not names or (t := trigrams(text)) is None:
            return UNKNOWN, 0.0
        vector = np.zeros(DIM, np.float32)
        for k in range(0, len(t[0]), 4096):
            vector += t[1][k : k + 4096].astype(np.float32) @ vectors().of(t[0][k : k + 4096])
        norm = float(np.linalg.norm(vector))
        cosines = matrix @ vector
        best = int(np.argmax(cosines))
        return names[best], min(1.0, max(0.0, float(cosines[best]) / norm)) if norm else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from the rows that are not held out."""
    teaching = docs.where(~held_out(F.col(id_col)))
    found = predict(docs, learn(teaching, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
