"""Byte-level BPE as a bounded-lookahead streaming transducer.

``last[i]``, the final token of the encoding of the first i bytes, is all that BPE has to remember: the
encoding of a prefix is the encoding of the prefix before its final token, plus that token. The final
token is the one that ends at i and may stand beside ``last`` of the prefix before it. Whether two tokens
may stand side by side follows from the merge ranks alone.

No token is longer than L bytes, the sufficient lookahead read off the merge list: every encoding of a
longer text runs through one of the last L prefixes. Tokens up to the boundary that all of these have in
common can never change, so they are emitted and forgotten, and a piece of any length takes a window of a
few L. Decoding is the inverse machine: bytes go in, and text comes out whenever a code point is complete.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _class(points: list[int]) -> str:
    """The inside of a character class that holds these sorted code points."""
    runs, start = [], None
    for k, p in enumerate(points):
        start = p if start is None else start
        if k + 1 == len(points) or points[k + 1] != p + 1:
            runs.append(f"\\U{start:08x}-\\U{p:08x}")
            start = None
    return "".join(runs)


@lru_cache(maxsize=3)
def piece_pattern(points: int = 0x110000) -> re.Pattern:
    """The split pattern of this family of vocabularies: contractions, letters, numbers, the rest, white space.

    The commonest alternative stands first; as no two of the first four can start at the same place but for
    the apostrophe, that changes nothing. The classes hold the code points below ``points`` only, since a
    search steps through every range beyond those that its tables cover.
    """
    kinds = {"L": [], "N": []}
    for p in range(points):
        kinds.get(unicodedata.category(chr(p))[0], []).append(p)
    space = _class([p for p in WHITE_SPACE if p < points])
    letter, number = _class(kinds["L"]), _class(kinds["N"])
    return re.compile(
        f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def pattern_for(text: str) -> re.Pattern:
    if text.isascii():
        return piece_pattern(0x80)
    return piece_pattern(0x10000 if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else 0x110000)


SLICE = 1 << 16
CACHED_PIECES = 600_000
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it is a visible Latin-1 character, else from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.made = [-1] * size  # the rank that makes a token; bytes are there from the start
        self.bytes_of = [b""] * size
        for b, i in ids.items():
            self.bytes_of[i] = b
        for r, (a, b) in enumerate(pairs):
            left, right = ids[raw(a)], ids[raw(b)]
            whole = ids[raw(a) + raw(b)]
            self.rank[left, right] = r
            if self.parts[whole] is None:
                self.parts[whole], self.made[whole] = (left, right), r
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.split_added = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        self.beside: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.token = {b: i for b, i in ids.items() if len(b) == 1 or self._whole(i)}
        self.lookahead = max(map(len, self.token))
        self.trie: dict[int, tuple] = {}  # byte -> (token or -1, the same for what may come next)
        for raw_token, i in self.token.items():
            node = self.trie
            for x in raw_token[:-1]:
                node = node.setdefault(x, [-1, {}])[1]
            node.setdefault(raw_token[-1], [-1, {}])[0] = i
        self.cache: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at one edge of a token in turn, each with the rank that swallows it."""
        if (found := self.spines.get((token, side))) is None:
            found, x, until = [], token, NEVER
            while True:
                found.append((x, until))
                if self.parts[x] is None:
                    break
                until = self.made[x]
                x = self.parts[x][side]
            self.spines[token, side] = found
        return found

    def _crossed(self, left: int, right: int, before: int) -> bool:
        """Whether a merge of a rank below ``before`` joins the two across their border.

        It does if its rank comes while both its symbols stand at the border. Of equal ranks the leftmost
        pair goes first, so a tie on the left swallows the symbol and a tie on the right comes too late.
        """
        for a, a_until in self._spine(left, 1):
            for b, b_until in self._spine(right, 0):
                r = self.rank.get((a, b), NEVER)
                if r < before and r < a_until and r <= b_until:
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Whether the bytes of a token are encoded as that token."""
        todo = [token]
        while todo:
            if (p := self.parts[x := todo.pop()]) is not None:
                if self._crossed(*p, self.made[x]):
                    return False
                todo += p
            elif len(self.bytes_of[x]) != 1:
                return False
        return True

    def follows(self, left: int, right: int) -> bool:
        if (known := self.beside.get((left, right))) is None:
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            known = self.beside[left, right] = not self._crossed(left, right, NEVER)
        return known

    def _advance(self, window: bytes, last: list[int], done: int) -> None:
        """Fills ``last`` for the bytes after the first ``done``, token by token from each start."""
        n, beside, trie = len(window), self.beside, self.trie
        last += [-1] * (n + 1 - len(last))
        for start in range(max(0, done + 1 - self.lookahead), n):
            before, node = last[start], trie
            for i in range(start, n):
                if (found := node.get(window[i])) is None:
                    break
                t, node = found
                if t >= 0 and i >= done and last[i + 1] < 0:
                    if before < 0 or (ok := beside.get((before, t))) or ok is None and self.follows(before, t):
                        last[i + 1] = t

    def stream(self, chunks: Iterator[bytes]) -> Iterator[int]:
        """The tokens of one piece that comes in chunks, each as soon as it is stable."""
        window, last = b"", [-1]  # last[i] belongs to the first i bytes of window
        reach = self.lookahead
        for chunk in chunks:
            done = len(window)
            window += chunk
            self._advance(window, last, done)
            n = len(window)
            if n <= 4 * reach:
                continue
            live = set(range(n - reach + 1, n + 1))  # walk all chains back until they meet
            while len(live) > 1:
                top = max(live)
                live.remove(top)
                live.add(top - len(self.bytes_of[last[top]]) if top else 0)
            if meet := live.pop():
                yield from self._chain(last, meet)
                window, last = window[meet:], last[meet:]  # last[0] keeps the token before the window
        yield from self._chain(last, len(window))

    def _search(self, raw: bytes) -> list[int]:
        """The tokens of a piece that is there as a whole and no longer than a window.

        Only one sequence of tokens has every pair side by side, so a depth-first search, longest token first,
        may stop at the first that fits, and no place need be tried twice.
        """
        n, trie, beside = len(raw), self.trie, self.beside
        ids, todo, dead, at = [-1], [], set(), 0
        while at < n:
            if len(todo) < len(ids):
                node, options = trie, []
                for i in range(at, n):
                    if (found := node.get(raw[i])) is None:
                        break
                    t, node = found
                    if t >= 0:
                        options.append((t, i + 1))
                todo.append(options)
            options, before = todo[-1], ids[-1]
            while options:
                t, end = options.pop()
                if end not in dead:
                    if before < 0 or (ok := beside.get((before, t))) or ok is None and self.follows(before, t):
                        ids.append(t)
                        at = end
                        break
            else:
                dead.add(at)
                todo.pop()
                at -= len(self.bytes_of[ids.pop()])
        return ids[1:]

    def _chain(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def piece(self, piece: str) -> bytes:
        """The ids of one piece as little-endian 32-bit integers."""
        if (found := self.cache.get(piece)) is None:
            raw = piece.encode("utf-8", "surrogatepass")
            if len(raw) <= self.lookahead:
                ids = self._search(raw)
            else:
                step = 4 * self.lookahead
                ids = list(self.stream(raw[k : k + step] for k in range(0, len(raw), step)))
            found = array("i", ids).tobytes()
            if len(piece) < 64:
                if len(self.cache) >= CACHED_PIECES:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def split(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, a slice of it at a time; the last two may still change, so they wait."""
        at, size, pieces = 0, SLICE, pattern_for(text)
        while len(text) - at > size:
            found = pieces.findall(text, at, at + size)
            wait = sum(map(len, found[-2:]))
            if wait == size:
                size *= 2
                continue
            yield found[:-2]
            at, size = at + size - wait, SLICE
        yield pieces.findall(text, at)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers; the strings of added tokens become their ids."""
        out, at = [], 0
        marks = self.split_added.finditer(text) if self.split_added and any(s in text for s in self.added) else ()
        for start, end, mark in [*((m.start(), m.end(), m[0]) for m in marks), (len(text), len(text), None)]:
            get = self.cache.get
            for pieces in self.split(text[at:start] if (at, start) != (0, len(text)) else text):
                out += [get(p) or self.piece(p) for p in pieces]
            if mark is not None:
                out.append(np.array([self.added[mark]], "<i4").tobytes())
            at = end
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """Text of a token sequence; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        table, out = self.bytes_of, []
        for k in range(0, len(ids), SLICE):
            out.append(machine.decode(b"".join(map(table.__getitem__, ids[k : k + SLICE].tolist()))))
        out.append(machine.decode(b"", True))
        return "".join(out)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _with(batch: pa.RecordBatch, keep: list[str], name: str, made: pa.Array, start: int) -> pa.RecordBatch:
    columns = [batch.column(k).slice(start, len(made)) for k in keep]
    return pa.RecordBatch.from_arrays([*columns, made], names=[*keep, name])


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, the token ids of the whole text, for each row of docs.

    ``tokenizer`` is the path of the tokenizer file on every machine. Null text counts as empty and has no
    ids; texts of any length stream through; repeated rows are encoded one by one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            texts = batch.column("text")
            for start in range(0, len(texts), 512):
                found = [machine.encode(t or "") for t in texts.slice(start, 512).to_pylist()]
                offsets = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(found), "<i4"))
                yield _with(batch, ["doc_id"], "ids", pa.ListArray.from_arrays(pa.array(offsets), values), start)

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (all by default) and decoded, the text of the column ids. Null ids give empty text."""
    keep = keep or encoded.columns
    fields = ", ".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            ids = batch.column("ids")
            for start in range(0, len(ids), 512):
                part = ids.slice(start, 512)
                values, offsets = part.values.to_numpy(), part.offsets.to_numpy()
                texts = [machine.decode(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
                yield _with(batch, keep, "decoded", pa.array(texts, pa.string()), start)

    return encoded.mapInArrow(run, f"{fields}, decoded string")
