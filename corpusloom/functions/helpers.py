"""Vectorized helpers for what Spark has no function for."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import BETWEEN

TEXTS_AT_ONCE = 64
CJK_RUN = re.compile(r"[一-鿿]+")
RUN = re.compile(r"[0-9A-Za-z]++(?![^\W一-鿿_])|[一-鿿]+|[^\W一-鿿_]+")  # the first kind is one of the third, found faster


@lru_cache(maxsize=200_000)
def _gram(gram: str, dim: int) -> tuple[int, float]:
    raw = int.from_bytes(hashlib.blake2b(gram.encode("utf-8", "replace"), digest_size=8).digest(), "big")
    return raw % dim, 1.0 if raw >> 63 else -1.0


def hashed_vector(text: str, dim: int) -> np.ndarray:
    """A unit vector of signed counts of hashed character trigrams; zeros for text without any."""
    v = np.zeros(dim, np.float32)
    for k in range(max(0, len(text) - 2)):
        at, sign = _gram(text[k : k + 3], dim)
        v[at] += sign
    norm = float(np.linalg.norm(v))
    return v / norm if norm else v


def embed(text: Column, dim: int = 64, encoder=hashed_vector) -> Column:
    """text -> array<float>; ``encoder(text, dim)`` can be any model that is loaded once per worker."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encoder(t or "", dim).tolist())

    return run(text)


def joined_tokens(texts: pa.Array, cut: Callable[[str], list[str]]) -> pa.Array:
    """The tokens of each text in one string, null where it has none. The tokens of few texts are Python objects at a time."""
    known = lru_cache(maxsize=10_000)(cut)

    def joined(t: str) -> str | None:
        found = RUN.findall(t)
        if CJK_RUN.search(t):
            runs, found = found, []
            for w in runs:
                if not "一" <= w[0] <= "鿿":
                    found.append(w)
                else:
                    found += known(w) if len(w) <= 64 else cut(w)
        return BETWEEN.join(found) if found else None

    parts = [pa.array([joined(t or "") for t in texts.slice(at, TEXTS_AT_ONCE).to_pylist()], pa.string()) for at in range(0, len(texts), TEXTS_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _tokens(text: Column, cut: Callable[[str], list[str]]) -> Column:
    """Runs of letters and digits, those of CJK cut by ``cut``."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return joined_tokens(texts, cut)

    return F.coalesce(F.split(run(text), BETWEEN), F.array().cast("array<string>"))


def dictionary_tokens(text: Column, terms: list[str]) -> Column:
    """Tokens with terms of a dictionary kept whole: longest match in CJK runs, single characters elsewhere there."""
    known = set(terms)
    longest = max(map(len, known), default=1)

    def cut(run: str) -> list[str]:
        out, at = [], 0
        while at < len(run):
            size = next((k for k in range(min(longest, len(run) - at), 1, -1) if run[at : at + k] in known), 1)
            out.append(run[at : at + size])
            at += size
        return out

    return _tokens(text, cut)


def best_path(run: str, costs: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The cut of a run whose words cost least in all; of equal costs the one with fewer words, then the one with the longer word first."""
    ways: list[tuple[float, int, int]] = [(0.0, 0, 0)] * (len(run) + 1)  # cost and number of words from a place to the end, and the first one's length
    for at in range(len(run) - 1, -1, -1):
        options = []
        for size in range(1, min(longest, len(run) - at) + 1):
            cost = costs.get(run[at : at + size], unknown if size == 1 else None)
            if cost is not None:
                rest, words, _ = ways[at + size]
                options.append((round(cost + rest, 9), words + 1, -size))
        cost, words, size = min(options)
        ways[at] = cost, words, -size
    out, at = [], 0
    while at < len(run):
        out.append(run[at : at + ways[at][2]])
        at += ways[at][2]
    return out


def weighted_tokens(text: Column, counts: dict[str, float]) -> Column:
    """Tokens with CJK runs cut into the words of a dictionary that are most likely together; other runs of letters and digits stay whole.

    ``counts`` says how often each word occurs; a word costs the negative logarithm of its share, a character that is no word as much as a word seen once.
    Index and queries must be cut with the same dictionary, which is sent to the workers: some hundred thousand words at most.
    """
    total = max(sum(counts.values()), 1.0)
    costs = {w: math.log(total / c) for w, c in counts.items() if w and c > 0}
    longest = max(map(len, costs), default=1)
    return _tokens(text, lambda run: best_path(run, costs, longest, math.log(total)))
