"""Tables that grow by one delta for each batch: merged when read, and compacted like a binary counter with a wider base.

A delta is a folder ``part=FROM-TO-LEVEL`` that holds what the batches FROM to TO have added; Spark's marker of success makes it count. When
FAN_IN parts of one level lie side by side, they are summed into one part of the next level, so that a table of n batches has some
FAN_IN * log(n) parts and each row is written log(n) times. A part that a wider one covers is no longer read, and is deleted
when the next batch has been written: whoever began to read before then finds its files.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.tables import delete_folder, folders

FAN_IN = 8


class Part(NamedTuple):
    first: int
    last: int
    level: int

    @property
    def name(self) -> str:
        return f"part={self.first}-{self.last}-{self.level}"


def _written(spark: SparkSession, path: str) -> list[Part]:
    names = [n.removeprefix("part=") for n in folders(spark, path, marker="_SUCCESS") if n.startswith("part=")]
    return sorted((Part(*map(int, n.split("-"))) for n in names), key=lambda p: (p.first, -p.last))


def parts(spark: SparkSession, path: str) -> list[Part]:
    """The parts to read: none of them lies within another."""
    out: list[Part] = []
    for p in _written(spark, path):
        if not out or p.first > out[-1].last:
            out.append(p)
    return out


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the parts to read; None if there is no part."""
    found = parts(spark, path)
    return spark.read.parquet(*[f"{path}/{p.name}" for p in found]) if found else None


def append(delta: DataFrame, path: str, number: int, combine: Callable[[DataFrame], DataFrame]) -> None:
    """Writes what batch ``number`` adds, in the same place if it is run again; then merges full levels by ``combine``, which sums
    rows of several parts to rows of one. A batch that a wider part holds already has been written before, and is left alone."""
    spark = delta.sparkSession
    before = _written(spark, path)
    if any(p.first <= number <= p.last and p.level for p in before):
        return
    read_now = set(parts(spark, path))
    for p in before:
        if p not in read_now:
            delete_folder(spark, f"{path}/{p.name}")
    delta.write.mode("overwrite").parquet(f"{path}/{Part(number, number, 0).name}")
    while True:
        found = parts(spark, path)
        tail = [p for p in found if p.level == found[-1].level][-FAN_IN:]
        if len(tail) < FAN_IN or tail != found[-FAN_IN:]:
            return
        wide = Part(tail[0].first, tail[-1].last, tail[0].level + 1)
        combine(spark.read.parquet(*[f"{path}/{p.name}" for p in tail])).write.mode("overwrite").parquet(f"{path}/{wide.name}")
