"""Chat formatting with quotation linking.

Quoted lines are parsed by nesting level and taken out of the messages. Every quoted passage is normalised
and hashed, as are the messages, their paragraphs and their lines; a join on conversation and hash finds
the message that a passage was first written in. A message answers the original of its outermost quotes, or
the turn before it that there is where nothing is quoted, and the links give each message its thread and depth.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.sources.tables import Steps

QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$")
ATTRIBUTION = re.compile(r"^[^\n>]{0,200}(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.I)
SPACES = re.compile(r"\s+")


def passage_hash(passage: str) -> int | None:
    """A 64-bit hash of the words of a passage in lower case; None without words."""
    words = SPACES.sub(" ", passage).strip().lower()
    return int.from_bytes(hashlib.blake2b(words.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) if words else None


def units(passage: str) -> list[tuple[int, int]]:
    """(hash, number of words) of a passage, its paragraphs and its lines, without repeats."""
    parts = [passage, *re.split(r"\n\s*\n", passage), *passage.split("\n")]
    found = {h: len(p.split()) for p in parts if (h := passage_hash(p)) is not None}
    return list(found.items())


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message without its quotes, and its quoted passages as (level, text) in order."""
    own, quotes = [], []
    for line in text.split("\n"):
        if m := QUOTE.match(line):
            level = m[1].count(">")
            if own and own[-1] is not None and ATTRIBUTION.match(own[-1]):
                own.pop()
            if ATTRIBUTION.match(m[2]):
                continue
            if quotes and quotes[-1][0] == level and own and own[-1] is None:
                quotes[-1] = level, f"{quotes[-1][1]}\n{m[2]}"
            else:
                quotes.append((level, m[2]))
            if not own or own[-1] is not None:
                own.append(None)
        else:
            own.append(line)
    if not quotes:
        return text, []
    body = "\n".join(x for x in own if x is not None)
    return re.sub(r"\n{3,}", "\n\n", body).strip("\n"), quotes


UNIT = "array<struct<hash:long,n_words:int,level:int>>"


def parse_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, own (units of the body) and quoted (units of the quotes)."""
    unit = pa.list_(pa.struct([("hash", pa.int64()), ("n_words", pa.int32()), ("level", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(t or "") for t in batch.column("text").to_pylist()]
            own = [[{"hash": h, "n_words": n, "level": 0} for h, n in units(body)] for body, _ in found]
            quoted = [[{"hash": h, "n_words": n, "level": k} for k, p in quotes for h, n in units(p)] for _, quotes in found]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([len(f[1]) for f in found], pa.int32()), pa.array(own, unit), pa.array(quoted, unit)]
            keys = [batch.column(k) for k in ("conv_id", "turn", "role")]
            yield pa.RecordBatch.from_arrays([*keys, *columns], names=["conv_id", "turn", "role", "body", "n_quotes", "own", "quoted"])

    narrow = messages.select("conv_id", F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    kind = narrow.schema["conv_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"conv_id {kind}, turn long, role string, body string, n_quotes int, own {UNIT}, quoted {UNIT}")


def link_quotes(parsed: DataFrame) -> DataFrame:
    """conv_id, turn and quoted_turn: the first message in which the outermost quoted words were written."""
    wanted = parsed.where(F.size("quoted") > 0).select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.*")
    firsts = parsed.select("conv_id", "turn", F.explode("own").alias("o")).groupBy("conv_id", F.col("o.hash").alias("hash"))
    firsts = firsts.agg(F.min("turn").alias("quoted_turn"))
    found = wanted.join(firsts, ["conv_id", "hash"]).where(F.col("quoted_turn") < F.col("turn"))
    best = F.min_by("quoted_turn", F.struct("level", -F.col("n_words"), -F.col("quoted_turn")))
    return found.groupBy("conv_id", "turn").agg(best.alias("quoted_turn"))


def threads(links: DataFrame, work: Steps, max_rounds: int = 40) -> DataFrame:
    """links (conv_id, turn, reply_to) with thread, the turn a chain of replies began with, and depth.

    Pointer jumping: each round doubles the length of chain that is known, so a chain of 2^40 replies is the limit.
    """
    state = work.keep(links.select("conv_id", "turn", F.col("reply_to").alias("up"), F.coalesce("reply_to", "turn").alias("top"), F.col("reply_to").isNotNull().cast("long").alias("depth")))
    for _ in range(max_rounds):
        if state.where(F.col("up").isNotNull()).isEmpty():
            break
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"))
        far = state.where(F.col("up").isNotNull()).join(above, ["conv_id", "up"], "left")  # chains that have ended stay as they are
        far = far.select("conv_id", "turn", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))
        before, state = state, work.keep(state.where(F.col("up").isNull()).unionByName(far))
        work.drop(before)
    return state.select("conv_id", "turn", F.col("top").alias("thread"), "depth")


def turns_before(turns: DataFrame, block: int = 4096) -> DataFrame:
    """conv_id, turn and last_turn, the greatest turn below it that the conversation has, for distinct turns.

    Windows hold the turns of one block of numbers, and then the blocks of one conversation.
    """
    at = turns.withColumn("block", F.floor(F.col("turn") / block))
    inner = at.withColumn("inner_turn", F.lag("turn").over(W.partitionBy("conv_id", "block").orderBy("turn")))
    ends = at.groupBy("conv_id", "block").agg(F.max("turn").alias("end"))
    ends = ends.select("conv_id", "block", F.lag("end").over(W.partitionBy("conv_id").orderBy("block")).alias("outer_turn"))
    return inner.join(ends, ["conv_id", "block"]).select("conv_id", "turn", F.coalesce("inner_turn", "outer_turn").alias("last_turn"))


def format_chat(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, reply_to, linked_by, thread, depth for each message.

    ``linked_by`` is quote, turn or null; as a message only ever answers an earlier turn, each conversation
    is in reply order when sorted by turn. Null text counts as empty. Rows that are repeated as a whole count
    once; of several different rows with one turn each stays, and all answer the same message. Rows without
    conversation or turn stay, linked with nothing. Other columns are ignored.
    """
    with Steps(messages.sparkSession) as work:
        parsed = work.keep(parse_messages(messages.select("conv_id", "turn", "role", "text").distinct()))
        turns = parsed.select("conv_id", "turn").distinct().where("conv_id IS NOT NULL AND turn IS NOT NULL")
        linked = turns.join(link_quotes(parsed), ["conv_id", "turn"], "left").join(turns_before(turns), ["conv_id", "turn"], "left")
        linked = work.keep(
            linked.select(
                "conv_id", "turn", F.coalesce("quoted_turn", "last_turn").alias("reply_to"),
                F.when(F.col("quoted_turn").isNotNull(), "quote").when(F.col("last_turn").isNotNull(), "turn").alias("linked_by"),
            )
        )
        threaded = threads(linked, work)
        places = work.keep(linked.join(threaded, ["conv_id", "turn"]))
        work.done(parsed, places)
    out = parsed.drop("own", "quoted").join(places, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", F.col("body").alias("text"), "n_quotes", "reply_to", "linked_by", "thread", "depth")


def render(chat: DataFrame, block: int = 256) -> DataFrame:
    """conv_id, block and text: the turns in order as one training string for each ``block`` of turns."""
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    keyed = chat.select("conv_id", F.floor(F.col("turn") / block).alias("block"), F.struct("turn", turn.alias("line")).alias("t"))
    lines = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"])
    return keyed.groupBy("conv_id", "block").agg(F.array_join(lines, "").alias("text"))
