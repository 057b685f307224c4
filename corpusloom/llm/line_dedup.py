"""Deduplication of repeated runs of lines by winnowing (DataFrame functions only).

A text is cut around line ends, after each sentence, and before each word that begins with certain letters; what is
still long is cut before more words. So a passage is cut alike wherever it was pasted. Every ``SHINGLE`` neighbouring
units are hashed together, and of each ``window`` neighbouring hashes the smallest is a fingerprint: any run of
``window`` + ``SHINGLE`` - 1 units that two places share has a fingerprint in common. The places of a fingerprint are
joined to its first one (smallest doc_id, then position). Matches of two texts with one offset make a stretch, which is
compared with the earlier text's and extended unit by unit both ways, then word by word into the units at both ends.
Runs that reach ``min_chars`` characters are deleted, but for their first place.

A place is a document's id with a hash of its text, so that documents with one id and different texts are kept
apart. Fingerprints and places travel alone. Texts travel twice: the earlier ones, to be cut into units of which each
later text gets the stretch that it shares, and all of them, to meet these stretches. The first place of each
fingerprint is found by aggregation, so no task gathers all places of a hot one and no pairs of places are made; a text
that many others repeat is cut once for each lot of these. All stretches of one document meet in its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.quality_rules import SEPARATORS, _let
from corpusloom.sources.tables import Steps

LONG = 72  # characters; units that are longer are cut before more words, and where they are still longer at each blank
MARK, SPARE = "\u0001", "\u0002"  # joins units; stands for it where a text holds it
FINER = (r"\s+(?=[edspmi])", r"\s+(?=\S)")
#: White space between units: before words that begin with certain letters, behind the end of a sentence, or around a line's end.
CUT = r"\s(?:\s*+(?=[ao])|(?<=[.!?]\s)\s*+|(?:(?<=\n)|[^\S\n]*+\n)\s*+)"
SHINGLE = 4  # with windows of 3, so that runs of six units have a fingerprint
EDGE = 160  # characters at each end of a run that are compared word by word: where a unit ends can depend on what precedes a passage
SIDE = EDGE // 2  # units that hold as many characters: one holds a character and a blank at least, except at a text's ends
PART = 64  # units; matches with one offset are compared as one stretch within so many
PAIRS = 256  # texts in a lot of those that repeat one earlier text, about
PLACE_BITS = 31  # an array has no more places


def _cut(text: Column, cut: Callable[[Column, str], Column]) -> Column:
    """The parts of a text that ``cut`` makes, and the parts of those that are long, white space at their ends aside."""
    long = lambda u: (F.length(u) > LONG) & (F.length(F.btrim(u, F.lit(SEPARATORS))) > LONG)
    deeper = lambda u, more: F.when(long(u), parts(u, *more)).otherwise(F.array(u))

    def parts(u: Column, pattern: str, *more: str) -> Column:
        return F.flatten(F.transform(cut(u, pattern), lambda u: deeper(u, more))) if more else cut(u, pattern)

    return parts(text, CUT, *FINER)


def units_of(text: Column) -> Column:
    """The units of a text, each with what separates it from the next, so that joining them gives the text.

    Marks are put where the text is cut and it is split there; the rare text that holds the mark itself goes piece by piece.
    """

    pieces = lambda u, pattern: F.regexp_extract_all(u, F.lit(f"(?s).*?{pattern}|.+"), F.lit(0))
    return F.when(text.contains(MARK), _cut(text, pieces)).otherwise(_marked_units(text))


def _marked_units(text: Column) -> Column:
    """The units of a text without marks."""
    return _cut(text, lambda u, pattern: F.split(F.regexp_replace(u, F.lit(pattern), F.lit(f"$0{MARK}")), MARK, -1))


def bare_units(text: Column) -> Column:
    """The same units without what separates them."""
    return _cut(text, lambda u, pattern: F.split(u, pattern, -1))


def _rows(made: Column) -> Column:
    """A row for each element. Plain explode() would also filter by the array's size, and so make the array once more."""
    return F.explode_outer(made)


def _print(u: Column, i: Column) -> Column:
    """The fingerprint of neighbouring units."""
    return F.xxhash64(*[F.get(u, i + k) for k in range(SHINGLE)])


def fingerprints(units: Column, window: int) -> Column:
    """``prints`` and ``pos``, two arrays: the window minima over the hashes of neighbouring units, and where they are.

    Hash and position share one number while minima are sought: the position fills the low bits, and of
    equal hashes the rightmost is taken. At the text's end windows are shorter. A text of two or three units has one hash of them all.
    """
    low = (1 << PLACE_BITS) - 1

    def packed(u: Column) -> Column:
        first = F.slice(u, 1, F.greatest(F.size(u) - (SHINGLE - 1), F.least(F.size(u) - 1, F.lit(1))))
        rest = lambda i: [F.get(u, i + k) for k in range(1, SHINGLE)]
        return F.transform(first, lambda x, i: F.xxhash64(x, *rest(i)).bitwiseAND(F.lit(~low)).bitwiseOR((F.lit(low) - i).cast("long")))

    def places(u: Column) -> Column:
        least = _let(packed(u), lambda q: F.transform(q, lambda x, i: F.least(x, *[F.get(q, i + k) for k in range(1, window)])))
        at = F.transform(F.array_distinct(least), lambda m: (F.lit(low) - m.bitwiseAND(F.lit(low))).cast("int"))
        # within a unit that is repeated over and over, each eighth place will do
        again = lambda i: (F.get(u, i) == F.get(u, i + 1)) & (F.get(u, i - 1) == F.get(u, i)) & (i % 8 != 0)
        return _let(F.filter(at, lambda i: ~again(i)), lambda p: F.struct(F.transform(p, lambda i: _print(u, i)).alias("prints"), p.alias("pos")))

    return _let(units, places)


def _equal(x: Column, y: Column) -> Column:
    """Whether two units are equal, white space at their ends aside."""
    return F.coalesce((x == y) | ((F.substring(x, 1, 4) == F.substring(y, 1, 4)) & (F.btrim(x, F.lit(SEPARATORS)) == F.btrim(y, F.lit(SEPARATORS)))), F.lit(False))


def _matching(a: Column, b: Column, equal: Callable[[Column, Column], Column] = _equal) -> Column:
    """How many units at the start of both arrays are equal."""

    def first_miss(same: Column) -> Column:
        return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")

    return _let(F.zip_with(a, b, equal), first_miss)


def _tag(text: Column) -> Column:
    """A hash of the text, 30 bits; with an id it tells places in different texts apart."""
    return F.hash(text).bitwiseAND(F.lit((1 << 30) - 1))


def _at(tag: Column, pos: Column) -> Column:
    """A place within all texts of one id: the tag and the position as one number."""
    return F.shiftleft(tag.cast("long"), 32).bitwiseOR(pos.cast("long"))


def _tag_of(at: str) -> Column:
    return F.shiftright(at, 32).cast("int")


def _pos(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _plain(text: Column) -> Column:
    """The text with the mark taken out of it, of equal length."""
    return F.when(text.contains(MARK), F.replace(text, F.lit(MARK), F.lit(SPARE))).otherwise(text)


def _last(text: Column) -> Column:
    return F.substring(text, -EDGE, EDGE)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, reach: int = 8) -> DataFrame:
    """doc_id, tag (a hash of the text) and sources: of each earlier text the stretches that share fingerprints with this one.

    A source has its units from ``start`` on (``near``, joined by marks), what stands before and after these (``head``, ``tail``), and ``matches``:
    from position ``pos`` to ``last`` fingerprints are those of the source from ``src_pos`` on. Stretches hold ``reach`` units around the
    matches; within a shared run the next fingerprint is at most ``window`` units on, so what matches are extended to overlaps and covers
    runs of any length. Null ids and texts have no units. Rows with equal id and text are one place.
    """
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).dropna().select("doc_id", _tag(F.col("text")).alias("tag"), "text")
    with Steps(docs.sparkSession) as work:
        lines = work.keep(narrow.select("doc_id", "tag", fingerprints(bare_units(F.col("text")), window).alias("f")).select("doc_id", "tag", "f.prints", "f.pos"))
        prints = lines.select("doc_id", "tag", _rows(F.arrays_zip("prints", "pos")).alias("f")).where("f IS NOT NULL")
        prints = prints.select(F.col("f.prints").alias("print"), "doc_id", _at(F.col("tag"), F.col("f.pos")).alias("at"))
        firsts = prints.groupBy("print").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("places"))
        firsts = work.keep(firsts.where("places > 1").select("print", F.col("first.doc_id").alias("src"), F.col("first.at").alias("src_at")))
        found = prints.join(firsts.hint("shuffle_hash"), "print").where("doc_id != src OR at != src_at")
        part = F.col("at") - F.pmod("at", F.lit(PART))
        found = found.groupBy("doc_id", "src", (F.col("src_at") - F.col("at")).alias("shift"), part.alias("part")).agg(F.min("at").alias("at"), F.max("at").alias("last"))
        found = found.withColumn("src_at", F.col("at") + F.col("shift"))
        match = F.struct(_pos("at").alias("pos"), _pos("last").alias("last"), _pos("src_at").alias("src_pos"))
        ends = [F.col("doc_id").alias("own_id"), _tag_of("at").alias("own_tag"), "src", _tag_of("src_at").alias("src_tag")]
        until = _pos("src_at") + _pos("last") - _pos("at")
        pairs = work.keep(found.groupBy(*ends).agg(F.collect_list(match).alias("matches"), F.min(_pos("src_at")).alias("lo"), F.max(until).alias("hi")))
        work.drop(lines, firsts)

        # a text is cut into units once for each PAIRS of those that repeat it, so that no task gets all of a hot one
        asked = pairs.groupBy("src", "src_tag").agg((F.count(F.lit(1)) / PAIRS).cast("int").alias("more"))
        pairs_in = pairs.join(asked, ["src", "src_tag"]).withColumn("lot", F.pmod(F.hash("own_id", "own_tag"), F.col("more") + 1)).drop("more")
        texts = narrow.join(asked.toDF("doc_id", "tag", "more").hint("shuffle_hash"), ["doc_id", "tag"])
        texts = texts.select(F.col("doc_id").alias("src"), F.col("tag").alias("src_tag"), F.explode(F.sequence(F.lit(0), "more")).alias("lot"), "text")
        texts = texts.repartition("src", "src_tag", "lot").groupBy("src", "src_tag", "lot").agg(F.any_value("text").alias("text"))
        texts = texts.select("src", "src_tag", "lot", _marked_units(_plain(F.col("text"))).alias("u"))
        start, stop = F.greatest(F.col("lo") - reach, F.lit(0)), F.col("hi") + SHINGLE + reach
        beside = [_last(F.array_join(F.slice("u", F.greatest(start - SIDE, F.lit(0)) + 1, F.least(start, F.lit(SIDE))), "")), F.substring(F.array_join(F.slice("u", stop + 1, SIDE), ""), 1, EDGE)]
        near = F.array_join(F.slice("u", start + 1, stop - start), MARK)
        source = F.struct(start.alias("start"), near.alias("near"), beside[0].alias("head"), beside[1].alias("tail"), "matches")
        known = pairs_in.join(texts, ["src", "src_tag", "lot"]).select(F.col("own_id").alias("doc_id"), F.col("own_tag").alias("tag"), source.alias("s"))
        out = work.keep(known.groupBy("doc_id", "tag").agg(F.collect_list("s").alias("sources")))  # of one document
        work.done(out)
        return out


def _edge(own: Column, other: Column, last: bool) -> Column:
    """Characters of ``own`` in the words with which it and ``other`` end, or begin."""
    words = lambda u: F.reverse(F.split(u, " ", -1)) if last else F.split(u, " ", -1)

    def chars(w: Column) -> Column:
        def of(n: Column) -> Column:
            some = F.length(F.array_join(F.slice(w, 1, n), " "))
            return F.when(n == F.size(w), F.length(own)).when(n > 0, some if last else some + 1).otherwise(0)

        return _let(_matching(w, words(other), lambda x, y: F.coalesce(x == y, F.lit(False))), of)

    return F.coalesce(_let(words(own), chars), F.lit(0))


def _stretches(same: Column) -> Column:
    """Where an array of booleans is true: from ``a`` to before ``b``."""
    at = lambda k: F.coalesce(F.get(same, k), F.lit(False))
    places = F.sequence(F.lit(0), F.size(same))
    starts, ends = F.filter(places, lambda k: at(k) & ~at(k - 1)), F.filter(places, lambda k: ~at(k) & at(k - 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _spans(u: Column, source: Column, j: Column, reach: int) -> Column:
    """What the matches with a source are extended to: units from ``a`` to before ``b``, equal to those of source ``j`` that lie ``d`` units on in its stretch."""

    def of(m: Column, near: Column) -> Column:
        here, there, n = m["pos"], m["src_pos"] - source["start"], m["last"] - m["pos"] + SHINGLE
        span = lambda a, b: F.struct(a.alias("a"), b.alias("b"), j.alias("j"), (there - here).alias("d"))
        own = F.least(here, there, F.lit(reach))
        ahead = _matching(F.slice(u, here + n + 1, reach), F.slice(near, there + n + 1, reach))
        behind = _matching(F.reverse(F.slice(u, here + 1 - own, own)), F.reverse(F.slice(near, there + 1 - own, own)))
        # the stretch between the first and the last fingerprint mostly is equal throughout
        same = F.zip_with(F.slice(u, here + 1 - own, own + n + reach), F.slice(near, there + 1 - own, own + n + reach), _equal)
        parts = F.transform(F.filter(_let(same, _stretches), lambda r: r["b"] - r["a"] >= SHINGLE), lambda r: span(here - own + r["a"], here - own + r["b"]))
        return F.when(F.slice(u, here + 1, n) == F.slice(near, there + 1, n), F.array(span(here - behind, here + n + ahead))).otherwise(parts)

    return _let(source["near"], lambda v: F.flatten(F.transform(source["matches"], lambda m: of(m, v))))


def _joined(spans: Column) -> Column:
    """The spans put together where they touch. One ends before the next begins where as many have ended as have begun."""
    sides = F.struct(F.array_sort(F.transform(spans, lambda s: s["a"])).alias("a"), F.array_sort(F.transform(spans, lambda s: s["b"])).alias("b"))

    def joined(e: Column) -> Column:
        starts = F.filter(e["a"], lambda x, i: (i == 0) | (x > F.get(e["b"], i - 1)))
        ends = F.filter(e["b"], lambda x, i: (i == F.size(e["b"]) - 1) | (F.get(e["a"], i + 1) > x))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return _let(sides, joined)


def without_repeats(text: Column, sources: Column, min_chars: int, reach: int) -> Column:
    """The text without those runs that have ``min_chars`` characters once they are extended by words; the rest stays.

    Only runs of half of ``min_chars`` in whole units are extended by words.
    """
    known = F.transform(sources, lambda s: F.struct(s["start"].alias("start"), F.split(s["near"], MARK, -1).alias("near"), s["head"].alias("head"), s["tail"].alias("tail"), s["matches"].alias("matches")))

    def rest(u: Column, known: Column, spans: Column) -> Column:
        some = lambda a, b: F.array_join(F.slice(u, a + 1, b - a), "")

        def cut(r: Column) -> Column:
            left, right = F.get(F.filter(spans, lambda s: s["a"] == r["a"]), F.lit(0)), F.get(F.filter(spans, lambda s: s["b"] == r["b"]), F.lit(0))
            before = _let(F.get(known, left["j"]), lambda s: _last(F.concat(s["head"], F.array_join(F.slice(s["near"], 1, r["a"] + left["d"]), ""))))
            after = _let(F.get(known, right["j"]), lambda s: F.substring(F.concat(F.array_join(F.slice(s["near"], r["b"] + right["d"] + 1, F.size(s["near"])), ""), s["tail"]), 1, EDGE))

            own = [_last(some(F.greatest(r["a"] - SIDE, F.lit(0)), r["a"])), F.substring(some(r["b"], r["b"] + SIDE), 1, EDGE)]
            start, end = F.length(some(F.lit(0), r["a"])), F.length(some(F.lit(0), r["b"]))
            return F.struct((start - _edge(own[0], before, True)).alias("s"), (end + _edge(own[1], after, False)).alias("e"))

        def outside(c: Column) -> Column:
            until = lambda i: F.coalesce(F.get(c, i - 1)["e"], F.lit(0))
            pieces = F.transform(c, lambda x, i: F.substring(text, until(i) + 1, F.greatest(x["s"] - until(i), F.lit(0))))
            return F.concat(F.array_join(pieces, ""), F.substring(text, until(F.size(c)) + 1, F.length(text)))

        long = F.filter(_joined(spans), lambda r: F.length(some(r["a"], r["b"])) * 2 >= min_chars)
        return _let(F.filter(F.transform(long, cut), lambda c: c["e"] - c["s"] >= min_chars), outside)

    def made(u: Column, known: Column) -> Column:
        spans = F.flatten(F.transform(known, lambda s, j: _spans(u, s, j, reach)))
        return _let(spans, lambda x: rest(u, known, x))

    within = _let(_marked_units(_plain(text)), lambda u: _let(known, lambda k: made(u, k)))
    return F.when(F.size(sources) > 0, within).otherwise(text)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 150, window: int = 3, reach: int = 8) -> DataFrame:
    """docs, each row with its columns and later repeated runs deleted from its text.

    Every row stays, also one whose text is then empty; rows with a null id or text stay as they are. Rows with
    equal id and text get the same result each; rows with one id and different texts are judged apart. A fingerprint
    is matched with its first place only. Runs are extended by words for EDGE characters at most at each end, which is longer than a
    unit; words beyond stay. An empty table gives an empty result; other columns may have any names.
    """
    text, taken = F.col(text_col).cast("string"), {c.lower() for c in docs.columns}
    key, tag, sources = (next(n for n in (f"{name}{i}" for i in range(len(taken) + 1)) if n not in taken) for name in ("line_id", "line_tag", "line_sources"))
    marks = repeats(docs, id_col, text_col, window, reach)
    marks = marks.select(F.col("doc_id").alias(key), F.col("tag").alias(tag), F.col("sources").alias(sources))
    met = docs.join(marks.hint("shuffle_hash"), (F.col(id_col) == F.col(key)) & (_tag(text) == F.col(tag)), "left")
    cut = without_repeats(text, F.col(sources), min_chars, reach)
    return met.select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns])
