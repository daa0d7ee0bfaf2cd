"""A written vector index that finds the exact top k without reading all of it.

Vectors lie in partitions by nearest centroid; a small table has the centroid
and radius of each.  For a query q no vector v of a cluster with centroid c and
radius r scores more than ``q.c + |q| r``, because ``q.v = q.c + q.(v - c)``.  A
search reads the most promising cluster of each query first; what is below the
k-th score that these give is not read at all.  Bounds are widened by ``SLACK``,
so rounding skips nothing, and ties are those of the plain search.

Vectors and clusters are published in one commit.  Adding keeps the centroids
and appends radii: the largest of a cluster counts, so bounds stay right.

Defined results: null vectors are left out; vectors and queries have one
length; an empty index answers with no rows; a ``k`` above the number of
vectors returns all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.snapshots import Snapshots, Version
from .retrieval import _matrix, check_k, global_top_k, top_k

SLACK = 1e-6
#: Queries of a search: they and their best scores are held by the driver.
QUERY_BLOCK = 4096


@dataclass
class Searched:
    """The hits and which of the clusters were read."""

    hits: DataFrame
    read: list[int]
    clusters: int


class VectorIndex:
    """Rows ``id, v`` below ``root``."""

    def __init__(self, spark: SparkSession, root: str, id_col: str = "vec_id"):
        self.spark, self.id_col = spark, id_col
        self.tables = Snapshots(spark, root, partition_by=("cluster",))

    def build(self, rows: DataFrame, clusters: int = 64, rounds: int = 3) -> Version:
        """Write the index anew.  Centroids are fitted by ``rounds`` of k-means over
        all rows from the ``clusters`` rows with the smallest hashes of their ids."""
        rows = rows.select(self.id_col, "v").where("v is not null")
        seeds = rows.orderBy(F.xxhash64(self.id_col), self.id_col).limit(clusters).toArrow()
        centroids = _matrix(seeds["v"].combine_chunks()) if len(seeds) else np.zeros((0, 0))
        for _ in range(rounds if len(centroids) else 0):
            placed = self._placed(rows, centroids).select("cluster", F.posexplode("v").alias("at", "x"))
            sums = placed.groupBy("cluster", "at").agg(F.avg("x").alias("x")).collect()  # clusters * length rows
            centroids = centroids.copy()
            for r in sums:
                centroids[r["cluster"], r["at"]] = r["x"]
        placed = self._placed(rows, centroids)
        return self.tables.publish(replace={"vectors": placed.drop("away").repartition("cluster"), "clusters": self._radii(placed, centroids)})

    def add(self, rows: DataFrame) -> Version:
        """Append rows to the clusters that are there."""
        _, centroids, _ = self._clusters()
        placed = self._placed(rows.select(self.id_col, "v").where("v is not null"), centroids)
        return self.tables.publish(append={"vectors": placed.drop("away").repartition("cluster"), "clusters": self._radii(placed, centroids)})

    def _placed(self, rows: DataFrame, centroids: np.ndarray) -> DataFrame:
        """Rows with their ``cluster`` and how far ``away`` its centroid is."""
        schema = T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("away", T.DoubleType())])
        sent = self.spark.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            for batch in batches:
                v = _matrix(batch["v"]) if len(batch) else np.zeros((0, c.shape[1]))
                own = (np.square(c).sum(1) - 2 * v @ c.T).argmin(1)
                away = np.sqrt(np.square(v - c[own]).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(away)], schema=to_arrow(schema))

        return rows.mapInArrow(run, schema)

    def _radii(self, placed: DataFrame, centroids: np.ndarray) -> DataFrame:
        known = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<double>")
        radii = placed.groupBy("cluster").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
        return known.join(radii, "cluster").coalesce(1)

    def _clusters(self, number: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centroids (by number) and radii of the clusters that hold something."""
        rows = self.tables.read("clusters", number).groupBy("cluster").agg(F.first("centroid").alias("centroid"), F.max("radius").alias("radius")).orderBy("cluster").collect()
        return np.array([r["cluster"] for r in rows], int), np.array([r["centroid"] for r in rows]), np.array([r["radius"] for r in rows])

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id") -> Searched:
        """``query_id, id, rank, score`` of the k largest inner products of each query (``query_id, q``)."""
        check_k(k)
        number = self.tables.version().number
        names, centroids, radii = self._clusters(number)
        asked = queries.select(query_id, "q").limit(QUERY_BLOCK + 1).toArrow()
        if len(asked) > QUERY_BLOCK:
            raise ValueError(f"more than {QUERY_BLOCK} queries at once")
        vectors = self.tables.read("vectors", number).select(self.id_col, "v", "cluster")
        hits = self._hits(queries, vectors.limit(0), query_id, k)
        if not len(asked) or not len(names):
            return Searched(hits, [], len(names))
        q = _matrix(asked["q"].combine_chunks())
        bound = q @ centroids.T + np.linalg.norm(q, axis=1)[:, None] * radii
        bound += SLACK * (1 + np.abs(bound))
        first = sorted({int(names[i]) for i in bound.argmax(1)})
        hits = self._hits(queries, vectors.where(F.col("cluster").isin(first)), query_id, k)
        hits = self.spark.createDataFrame(hits.collect(), hits.schema)  # k rows a query
        least = {r[query_id]: r["least"] for r in hits.where(F.col("rank") == k).select(query_id, F.col("score").alias("least")).collect()}
        floor = np.array([least.get(i, -np.inf) for i in asked[query_id].to_pylist()])
        rest = sorted({int(names[i]) for i in np.flatnonzero((bound >= floor[:, None]).any(0))} - set(first))
        if rest:
            more = self._hits(queries, vectors.where(F.col("cluster").isin(rest)), query_id, k)
            both = top_k(hits.drop("rank").unionByName(more.drop("rank")), query_id, k, tie=self.id_col)
            hits = both.select(query_id, self.id_col, "rank", "score")
        return Searched(hits, sorted(first + rest), len(names))

    def _hits(self, queries: DataFrame, vectors: DataFrame, query_id: str, k: int) -> DataFrame:
        return global_top_k(queries, vectors, query_id, self.id_col, k).select(query_id, self.id_col, "rank", "score")


def to_arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)
