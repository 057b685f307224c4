"""Nearest vectors by cosine: exactly, by bounds over parts, and approximately, by clusters with short codes.

A layout deals vectors to their nearest centres and cuts large clusters into rings by the angle to the centre. It is a table bucketed by part, so
that in a search only queries travel. The angle between two vectors is a metric: a vector at the angle b from a centre that lies at the angle a from the
query is at least |a - b| away from the query. So a ring whose angles all lie far from the query's own can be left out without reading it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusloom.sources.tables import checkpointed

PART_ROWS = 50_000
QUERY_BLOCK = 65_536  # queries that one task holds beside its part
AT_ONCE = 256
NOWHERE = -1  # the cluster of vectors without direction or of another length; every query looks there
SCORED = "query_id long, chunk_index long, score double"
SLACK = 2e-6  # scores have six places; bounds may be off by rounding

Centers = list[list[float]]


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms, norms, 1)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that hold ``dim`` numbers, and these as a matrix."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    good = np.nonzero(lengths == dim)[0]
    values = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return good, values.reshape(len(good), dim)


def fit_centers(vectors: DataFrame, nlist: int = 128, seed: int = 7, sample_rows: int = 100_000) -> tuple[Centers, float]:
    """Unit-length centres by k-means under cosine, fitted on at most about ``sample_rows`` vectors of the most frequent length, and the mean
    cosine of those with their nearest centre. Where there is no such vector, one centre that no vector can be near to."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = vectors.where("embedding IS NOT NULL AND exists(embedding, x -> x != 0)")
    sizes = some.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return [[1.0]], 0.0
    fed = some.where(F.size("embedding") == sizes["size"]).withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    total = sizes["count"]
    sample = fed if total <= sample_rows else fed.sample(sample_rows / total, seed=seed)
    model = KMeans(k=max(2, min(nlist, total // 2)), seed=seed, featuresCol="features", predictionCol="cluster_id", distanceMeasure="cosine").fit(sample)
    centers = [c.tolist() for c in _unit(np.array(model.clusterCenters()))]
    near = assign(sample.select("embedding"), centers).agg(F.avg("center_score")).first()[0]
    return centers, near or 0.0


def assign(vectors: DataFrame, centers: Centers, spill: int = 1, codes: bool = False) -> DataFrame:
    """vectors with cluster_id and center_score, the cosine with that centre, for each of the ``spill`` nearest centres; with ``codes`` also
    the residual of the unit vector from the centre as signed bytes, and their scale. Vectors of another length, without direction or null get NOWHERE."""
    middle = _unit(np.array(centers, np.float64))
    dim, most = middle.shape[1], min(spill, len(middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, rows = _matrix(batch.column("embedding"), dim)
            some = np.linalg.norm(rows, axis=1) > 0
            good, rows = good[some], _unit(rows[some])
            scores = rows @ middle.T
            order = np.argsort(-scores, axis=1, kind="stable")[:, :most]
            place, cluster = np.repeat(good, most), order.ravel()
            score = np.take_along_axis(scores, order, 1).ravel()
            odd = np.setdiff1d(np.arange(batch.num_rows), good)
            take = pa.array(np.concatenate([place, odd]))
            made = [pa.array(np.concatenate([cluster, np.full(len(odd), NOWHERE)]), pa.int32()), pa.array(np.concatenate([score, np.zeros(len(odd))]))]
            names = ["cluster_id", "center_score"]
            if codes:
                rest = np.repeat(rows, most, axis=0) - middle[cluster]
                scale = np.maximum(np.abs(rest).max(axis=1, initial=0), 1e-12) / 127
                bytes_of = np.rint(rest / scale[:, None]).astype(np.int8)
                made += [pa.array([r.tobytes() for r in bytes_of] + [None] * len(odd), pa.binary()), pa.array(np.concatenate([scale, np.zeros(len(odd))]))]
                names += ["code", "scale"]
            yield pa.RecordBatch.from_arrays([c.take(take) for c in batch.columns] + made, names=[*batch.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{kinds}, cluster_id int, center_score double" + (", code binary, scale double" if codes else ""))


@dataclass(frozen=True)
class VectorLayout:
    """A bucketed table of vectors, and a row for each part of each cluster: part, cluster_id, n, least and most (angles to the centre)."""

    spark: SparkSession
    table: str
    cells: DataFrame
    centers: Centers

    @property
    def members(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def build_layout(vectors: DataFrame, centers: Centers, spill: int = 1, part_rows: int = PART_ROWS, table: str | None = None) -> VectorLayout:
    """Deals vectors (chunk_index, embedding and whatever filters need) to parts of some ``part_rows``, whatever their cluster's size, and writes
    them bucketed by part. With ``spill`` each vector lies in several clusters, which the approximate search needs on data without clear clusters."""
    spark = vectors.sparkSession
    placed = checkpointed(assign(vectors, centers, spill, codes=True).withColumn("angle", F.acos(F.least(F.greatest("center_score", F.lit(-1.0)), F.lit(1.0)))))
    n = max(1, -(-placed.count() // part_rows))
    ranged = placed.repartitionByRange(n, "cluster_id", "angle", "chunk_index").withColumn("part", F.spark_partition_id())
    name = table or f"vectors_{uuid.uuid4().hex}"
    ranged.repartition(n, "part").write.bucketBy(n, "part").sortBy("cluster_id").mode("overwrite").saveAsTable(name)
    cells = spark.table(name).groupBy("part", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    return VectorLayout(spark, name, checkpointed(cells), centers)


def query_angles(queries: DataFrame, centers: Centers) -> DataFrame:
    """query_id, cluster_id and angle of each query with each centre, and one row for NOWHERE."""
    middle = _unit(np.array(centers, np.float64))

    @F.pandas_udf("array<double>")
    def angles(vecs: pd.Series) -> pd.Series:
        def one(v):
            v = np.asarray(v, np.float64)
            norm = np.linalg.norm(v)
            cosines = middle @ v / (norm or 1) if len(v) == middle.shape[1] else np.zeros(len(middle))
            return np.arccos(np.clip(cosines, -1, 1)).tolist()

        return vecs.map(one)

    rows = queries.select("query_id", F.posexplode(angles("query_vec")).alias("cluster_id", "angle"))
    return rows.unionByName(queries.select("query_id", F.lit(NOWHERE).alias("cluster_id"), F.lit(0.0).alias("angle")))


def best_cosine(angle: Column, least: Column, most: Column, cluster: Column) -> Column:
    """The largest cosine that a vector between two angles from its centre can have with a query at ``angle`` from the centre."""
    gap = F.greatest(F.lit(0.0), least - angle, angle - most)
    return F.when(cluster == NOWHERE, F.lit(1.0)).otherwise(F.cos(F.least(gap, F.lit(np.pi))))


def _allowed(queries: list[dict], kinds: dict[str, np.ndarray]) -> np.ndarray | None:
    """Which query may have which vector, by its lists; None if all may."""
    if not any(q.get(w) is not None for q in queries for w in ("categories", "content_types")):
        return None
    fits = np.ones((len(queries), len(next(iter(kinds.values())))), bool)
    for row, q in enumerate(queries):
        for wanted, kind in (("categories", "category"), ("content_types", "content_type")):
            if q.get(wanted) is not None and kind in kinds:
                fits[row] &= np.isin(kinds[kind], q[wanted])
    return fits


def _best(ids: np.ndarray, scores: np.ndarray, fits: np.ndarray | None, chunks: np.ndarray, k: int) -> pa.RecordBatch:
    """All that reach the k-th best score; ties beyond it are sorted out by the window that follows."""
    scores = np.round(scores, 6)
    if fits is not None:
        scores[~fits] = -np.inf
    take = min(k, len(chunks))
    least = -np.partition(-scores, take - 1, axis=1)[:, take - 1 : take]
    q, c = np.nonzero((scores >= least) & np.isfinite(scores))
    return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(chunks[c]), pa.array(scores[q, c])], names=["query_id", "chunk_index", "score"])


def _scored(left: pa.Table, right: pa.Table, k: int, centers: np.ndarray | None = None) -> pa.Table:
    """The best k of a part's vectors for each of the queries sent there, cluster by cluster, by products of blocks.

    With ``centers`` the vectors' codes stand for them; NOWHERE is then left to the exact pass and passed through with score 0.
    """
    schema = pa.schema([("query_id", pa.int64()), ("chunk_index", pa.int64()), ("score", pa.float64())])
    made = []
    asked, held = left.column("cluster_id").to_numpy(), right.column("cluster_id").to_numpy()
    for cluster in np.unique(asked).tolist():
        queries, rows = left.take(pa.array(np.nonzero(asked == cluster)[0])), right.take(pa.array(np.nonzero(held == cluster)[0]))
        if not rows.num_rows:
            continue
        numbers = rows.column("chunk_index").to_numpy()
        ids = queries.column("query_id").to_numpy()
        if centers is not None and cluster == NOWHERE:
            made.append(pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(numbers))), pa.array(np.tile(numbers, len(ids))), pa.array(np.zeros(len(ids) * len(numbers)))], schema=schema))
            continue
        vecs = queries.column("query_vec").combine_chunks()
        lists = [c for c in ("categories", "content_types") if c in queries.column_names]
        about = queries.select(lists).to_pylist() if lists else []
        kinds = {c: np.array(rows.column(c).to_pylist(), object).astype(str) for c in ("category", "content_type") if c in rows.column_names}
        for dim in np.unique(pc.list_value_length(vecs).to_numpy(zero_copy_only=False)).tolist():
            mine, matrix = _matrix(vecs, dim)
            matrix = _unit(matrix)
            if centers is None:
                good, values = _matrix(rows.column("embedding").combine_chunks(), dim)
                values = _unit(values)
            elif dim == centers.shape[1]:
                good = np.arange(rows.num_rows)
                codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(len(good), dim)
                values = centers[cluster] + codes * rows.column("scale").to_numpy()[:, None]
            else:
                continue
            if not len(good):
                continue
            for at in range(0, len(mine), AT_ONCE):
                part = mine[at : at + AT_ONCE]
                fits = _allowed([about[p] for p in part], {c: v[good] for c, v in kinds.items()}) if about and kinds else None
                made.append(_best(ids[part], matrix[at : at + AT_ONCE] @ values.T, fits, numbers[good], k))
    return pa.Table.from_batches(made, schema) if made else schema.empty_table()


def _asked(queries: DataFrame) -> DataFrame:
    lists = [c for c in ("categories", "content_types") if c in queries.columns]
    return queries.where("query_vec IS NOT NULL").select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec"), *lists)


def _meet(sent: DataFrame, members: DataFrame, n_queries: int, k: int, centers: np.ndarray | None = None) -> DataFrame:
    """Scores of the queries sent to parts (part, cluster_id, query_id, query_vec, ...) with what lies there. Members stay where they are, as long as
    a task can hold the queries beside its part; above QUERY_BLOCK queries there is a copy of the members for each block of queries."""
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    keys = ["part"]
    if blocks > 1:
        keys = ["part", "block"]
        sent = sent.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        members = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    grouped = sent.groupBy(*keys).cogroup(members.groupBy(*keys))
    return grouped.applyInArrow(lambda key, left, right: _scored(left, right, k, centers), SCORED)


def _top(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_index")))
    best = scored.groupBy("query_id", "chunk_index").agg(F.max("score").alias("score"))  # a vector may lie in several clusters
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_index", "score")


def flat_topk(queries: DataFrame, vectors: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """query_id, rank, chunk_index, score of the k nearest vectors, without a layout: vectors are dealt to parts once, and every query goes to every part."""
    asked = _asked(queries)
    n = parts or max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // PART_ROWS))
    sent = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), F.lit(0).alias("cluster_id"))
    held = vectors.withColumn("part", F.pmod(F.xxhash64("chunk_index"), F.lit(n)).cast("int")).withColumn("cluster_id", F.lit(0))
    scored = _meet(sent, held, asked.count(), k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_index")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_index", "score")


def bounded_topk(queries: DataFrame, layout: VectorLayout, k: int) -> tuple[DataFrame, DataFrame]:
    """The k nearest vectors of each query, exactly (query_id, rank, chunk_index, score), and what that took: query_id, n_vectors, n_scored.

    A first pass looks into the nearest rings of the nearest cluster until it has k vectors; the k-th best score is a threshold. A second pass
    looks into every other ring that may hold as good a vector. A query whose first pass finds fewer than k has no threshold, and looks everywhere.
    """
    asked = checkpointed(_asked(queries))
    n_queries = asked.count()
    # queries x clusters, then only the rings of clusters that count; cells are a row for each part and cluster
    angles = checkpointed(query_angles(asked, layout.centers))
    clusters = layout.cells.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    bound = best_cosine(F.col("angle"), F.col("least"), F.col("most"), F.col("cluster_id"))
    nearest = W.partitionBy("query_id").orderBy("angle", "cluster_id")
    before = F.coalesce(F.sum("n").over(nearest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = angles.where(F.col("cluster_id") != NOWHERE).join(clusters.select("cluster_id", "n"), "cluster_id").withColumn("before", before).where(F.col("before") < k)
    rings = first.select("query_id", "cluster_id", "angle").join(layout.cells, "cluster_id").withColumn("bound", bound)
    order = W.partitionBy("query_id").orderBy(F.desc("bound"), "part", "cluster_id").rowsBetween(W.unboundedPreceding, -1)
    rings = rings.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < k)
    started = checkpointed(rings.select("query_id", "part", "cluster_id", "n"))
    found = checkpointed(_meet(started.drop("n").join(asked, "query_id"), layout.members, n_queries, k))
    thresholds = _top(found, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_found"), F.min("score").alias("score"))
    asked_from = asked.select("query_id").join(thresholds, "query_id", "left").select("query_id", F.when(F.col("n_found") >= k, F.col("score") - SLACK).otherwise(-2.0).alias("threshold"))
    near = angles.join(clusters, "cluster_id").withColumn("bound", bound).join(asked_from, "query_id").where("bound >= threshold")
    cells = near.select("query_id", "cluster_id", "angle", "threshold").join(layout.cells, "cluster_id").withColumn("bound", bound).where("bound >= threshold")
    rest = checkpointed(cells.join(started, ["query_id", "part", "cluster_id"], "left_anti").select("query_id", "part", "cluster_id", "n"))
    more = _meet(rest.drop("n").join(asked, "query_id"), layout.members, n_queries, k)
    cost = started.unionByName(rest).groupBy("query_id").agg(F.sum("n").alias("n_scored"))
    total = layout.cells.agg(F.sum("n").alias("n_vectors"))
    return _top(found.unionByName(more), k), cost.crossJoin(F.broadcast(total)).select("query_id", "n_vectors", "n_scored")  # one row


def ivf_topk(queries: DataFrame, layout: VectorLayout, k: int, nprobe: int = 8, widen: int = 4) -> DataFrame:
    """query_id, rank, chunk_index, score of the k nearest vectors in the ``nprobe`` clusters nearest to each query.

    Clusters are read by their short codes; the best ``widen`` times k by these are scored again by the vectors themselves.
    """
    asked = checkpointed(_asked(queries))
    n_queries = asked.count()
    angles = query_angles(asked, layout.centers)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("angle", "cluster_id"))
    probed = angles.where(F.col("cluster_id") != NOWHERE).withColumn("place", place).where(F.col("place") <= nprobe).select("query_id", "cluster_id")
    probed = probed.unionByName(angles.where(F.col("cluster_id") == NOWHERE).select("query_id", "cluster_id"))
    sent = probed.join(layout.cells.select("cluster_id", "part"), "cluster_id").join(asked, "query_id")
    kinds = [c for c in ("category", "content_type") if c in layout.members.columns]
    short = layout.members.select("part", "cluster_id", "chunk_index", "code", "scale", *kinds)
    rough = _meet(sent, short, n_queries, widen * k, _unit(np.array(layout.centers, np.float64)))
    chosen = _top(rough, widen * k).select("query_id", "chunk_index")
    whole = layout.members.dropDuplicates(["chunk_index"]).select("chunk_index", "embedding", *kinds)
    pairs = chosen.join(whole, "chunk_index").join(asked, "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v, q = F.col("embedding"), F.col("query_vec")
    norm = F.sqrt(dot(v, v) * dot(q, q))
    exact = F.round(F.when(norm > 0, dot(v, q) / norm).otherwise(0.0), 6)
    scored = pairs.where(F.size(v) == F.size(q)).select("query_id", "chunk_index", exact.alias("score"))
    return _top(scored, k)
