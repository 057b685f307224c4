"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import Steps


def components(links: DataFrame, work: Steps) -> DataFrame:
    """id and component_id, the smallest id reachable, for every id in links (columns a and b).

    Each round an id takes the least label among its neighbours' and offers it to the id that its own label names,
    so that a whole region moves to a smaller label that arrives at its edge; then labels are followed once
    more. It ends when no label changes: then the labels of all neighbours are equal. Labels are a step of
    ``work`` each round, and only the last round's stays.
    """
    links = links.where("a != b").select("a", "b")
    edges = work.keep(links.union(links.select("b", "a")).distinct())
    known = work.keep(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    labels = known
    none = F.lit(None).cast(labels.schema["label"].dataType)
    while True:
        seen = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        own = F.struct("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hook = F.struct(F.col("label").alias("id"), none.alias("old"), F.col("near").alias("label"))
        offers = labels.join(seen, "id").select(F.explode(F.when(F.col("near") < F.col("label"), F.array(own, hook)).otherwise(F.array(own))).alias("o"))
        pulled = offers.groupBy("o.id").agg(F.max("o.old").alias("old"), F.min("o.label").alias("label"))
        over = pulled.select(F.col("id").alias("label"), F.col("label").alias("far"))
        moved = work.keep(pulled.join(over, "label").select("id", "old", F.col("far").alias("label")))
        work.drop(known)
        known, labels = moved, moved.select("id", "label")
        if moved.where("old != label").isEmpty():
            work.drop(edges)
            return labels.select("id", F.col("label").alias("component_id"))
