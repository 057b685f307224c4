"""Which of many patterns each of many texts contains, by one pass of an Aho-Corasick automaton over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERNS_AT_ONCE = 100_000


def contained(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, at_once: int = PATTERNS_AT_ONCE) -> DataFrame:
    """key and pattern, for each pattern that a text contains, once for each row of texts.

    Patterns are dealt to parts of some ``at_once``, and texts to as many groups as there are shuffle partitions. Each part meets each group in one task, the patterns
    first: a task builds the automaton of one part and then streams texts through it. The empty pattern is in every text; null is in none and has none.
    """
    spark = texts.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = patterns.select(F.col(pattern).alias("pattern")).dropna().distinct()
    parts = max(1, -(-wanted.count() // at_once))
    kind = texts.schema[key].dataType.simpleString()
    group, part = lambda c: F.pmod(F.xxhash64(*c), F.lit(groups)).cast("int"), F.pmod(F.xxhash64("pattern"), F.lit(parts)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.select(part.alias("part"), each(groups).alias("group"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("key"), F.col("pattern").alias("text"))
    right = texts.where(F.col(text).isNotNull()).select(each(parts).alias("part"), group([key, text]).alias("group"), F.lit(1).alias("kind"), F.col(key).alias("key"), F.col(text).alias("text"))
    met = left.unionByName(right).repartition("part", "group").sortWithinPartitions("part", "group", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        here, words, automaton = None, [], None
        for batch in batches:
            rows, found = [], []
            places = zip(*(batch.column(c).to_pylist() for c in ("part", "group", "kind", "text")), strict=True)
            for k, (p, g, what, value) in enumerate(places):
                if (p, g) != here:
                    here, words, automaton = (p, g), [], None
                if what == 0:
                    words.append(value)
                    continue
                if automaton is None:
                    automaton = ahocorasick.Automaton()
                    for w in words:
                        if w:
                            automaton.add_word(w, w)
                    automaton.make_automaton()
                hits = {w for _, w in automaton.iter(value)} if len(automaton) else set()
                if "" in words:
                    hits.add("")
                rows += [k] * len(hits)
                found += sorted(hits)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["key", "pattern"])

    return met.mapInArrow(run, f"key {kind}, pattern string").withColumnRenamed("key", key)
