"""Exact k-means on integer vectors, with Elkan's bounds kept beside each vector.

1. *Blocks.*  Vectors are packed, ``BLOCK`` to a row, with the bounds of each: an
   upper bound of the distance to its own centroid and a lower bound for every
   centroid.  A round reads the blocks of the round before, writes its own, and
   lets the older ones go; a lost task is done again from the written blocks.
2. *Assignment.*  A centroid moves the bounds by as far as it went.  A vector
   whose upper bound lies below half the distance from its centroid to the
   nearest other, or a centroid whose lower bound or half distance lies above
   the upper bound, is not compared.  What is compared is compared by the exact
   squared distance in whole numbers.
3. *Update.*  Each block also carries the count and the component sums of its
   clusters in columns of their own, so the new centroids come from a scan of
   these alone: they are summed by (cluster, component) with partial sums, and
   ``k * dims`` sums reach the driver, which divides in whole numbers.

Rounding: square roots and sums of bounds are rounded outward (``SLACK``), and a
centroid is skipped only where its bound is strictly greater, so every tie is
settled by whole numbers: the smaller centroid wins.

Nothing but blocks stays in a task, nothing but sums is shuffled, and no vector
goes to the driver but the ``k`` that the centroids start as.

Defined results: a vector that is null, of another length, or with a null or
non-finite component is left out; a component beyond ``LARGEST`` in magnitude
fails the job, because sums of its squares leave a long; repeated rows are
vectors of their own; a null id is kept, and never starts a centroid while other
rows are there; equal hashes are ordered by the vector; with fewer vectors than
centroids there are as many centroids as vectors; an empty centroid stays where
it is; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import delete_path, scratch_path

#: Vectors of a row of the written blocks.
BLOCK = 2048
#: Components whose squared differences, summed over any usual length, fit a long.
LARGEST = 1 << 27
#: Outward rounding of bounds, far above the error of a few double operations.
SLACK = 1e-12


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``id, v`` of the vectors that count, with components floor(scale * x)."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = rows.select(F.col(f"`{id_col}`").alias("id"), vector.alias("v")).where((F.size("v") == dims) & F.forall("v", finite))
    scaled = F.transform("v", lambda x: F.floor(x * scale))
    inside = F.forall("v", lambda x: F.abs(x * scale) <= LARGEST)
    return kept.select("id", F.when(inside, scaled).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}"))).cast("array<int>").alias("v"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest sha256 of ``seed:id``."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances, of rows to rows or of rows to one vector."""
    d = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", d, d)


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


class Round:
    """What a round of assignments needs to know of the centroids."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.now = now
        self.moved = None if before is None else up(np.sqrt(squared(now, before).astype(float)))
        self.half = np.array([down(np.sqrt(squared(now, c).astype(float))) / 2 for c in now])
        apart = self.half.copy()
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(axis=1)

    def assign(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring assignment and bounds up to date, in place; returns how many distances it took."""
        upper += self.moved[own]
        np.multiply(upper, 1 + SLACK, out=upper)
        lower -= self.moved
        np.multiply(lower, 1 - SLACK, out=lower)
        open_ = np.flatnonzero(upper >= self.nearest[own])
        if not len(open_):
            return 0
        best = squared(v[open_], self.now[own[open_]])
        upper[open_] = up(np.sqrt(best.astype(float)))
        lower[open_, own[open_]] = down(np.sqrt(best.astype(float)))
        took = len(open_)
        for c in range(len(self.now)):
            mine = own[open_]
            at = np.flatnonzero((mine != c) & (upper[open_] >= lower[open_, c]) & (upper[open_] >= self.half[mine, c]))
            rows = open_[at]
            d = squared(v[rows], self.now[c])
            took += len(rows)
            lower[rows, c] = down(np.sqrt(d.astype(float)))
            nearer = (d < best[at]) | ((d == best[at]) & (c < mine[at]))
            at, rows = at[nearer], rows[nearer]
            best[at] = d[nearer]
            own[rows] = c
            upper[rows] = up(np.sqrt(d[nearer].astype(float)))
        return took

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Assignment and bounds of vectors that have none: every distance is taken."""
        d = np.stack([squared(v, c) for c in self.now], axis=1)
        own = d.argmin(axis=1)
        root = np.sqrt(d.astype(float))
        return own, up(root[np.arange(len(v)), own]), down(root)


def block_type(id_type: T.DataType, dims: int) -> T.StructType:
    fields = {"ids": T.ArrayType(id_type), "vectors": T.BinaryType(), "own": T.BinaryType(), "upper": T.BinaryType(), "lower": T.BinaryType(), "counts": T.ArrayType(T.LongType()), "sums": T.ArrayType(T.LongType()), "inertia": T.ArrayType(T.LongType()), "distances": T.LongType()}
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def packed(ids: pa.Array, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: np.ndarray, took: int) -> dict:
    """One block as a row, with what its clusters sum up to."""
    k, dims = now.shape
    sums = np.zeros((k, dims), np.int64)
    np.add.at(sums, own, v)
    inertia = np.zeros(k, np.int64)
    np.add.at(inertia, own, squared(v, now[own]))
    return {"ids": ids, "vectors": v.astype(np.int32).tobytes(), "own": own.astype(np.int32).tobytes(), "upper": upper.tobytes(), "lower": lower.tobytes(), "counts": np.bincount(own, minlength=k), "sums": sums.ravel(), "inertia": inertia, "distances": took}


def as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def first_blocks(now: np.ndarray, schema: pa.Schema):
    """``id, v`` rows to blocks with their first assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Round(now, None)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                v = part["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                own, upper, lower = step.first(v)
                yield as_batch([packed(part["id"].to_pylist(), v, own, upper, lower, now, v.shape[0] * len(now))], schema)

    return run


def next_blocks(now: np.ndarray, before: np.ndarray, schema: pa.Schema):
    """Blocks to blocks after the centroids have moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Round(now, before)
        k, dims = now.shape
        for batch in batches:
            for i in range(len(batch)):
                raw = {c: batch[c][i].as_py() for c in ("ids", "vectors", "own", "upper", "lower")}
                v = np.frombuffer(raw["vectors"], np.int32).reshape(-1, dims)
                own = np.frombuffer(raw["own"], np.int32).astype(np.int64)
                upper = np.frombuffer(raw["upper"]).copy()
                lower = np.frombuffer(raw["lower"]).reshape(-1, k).copy()
                took = step.assign(v, own, upper, lower)
                yield as_batch([packed(raw["ids"], v, own, upper, lower, now, took)], schema)

    return run


def summed(blocks: DataFrame, column: str) -> list[int]:
    """Place by place the sum of an array column over all blocks."""
    places = blocks.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    return [r["x"] for r in sorted(places.collect())]


def moved_to(blocks: DataFrame, now: np.ndarray) -> np.ndarray:
    """The means of the clusters, rounded down; an empty one stays."""
    k, dims = now.shape
    counts, sums = summed(blocks, "counts"), summed(blocks, "sums")
    return np.array([[s // counts[c] for s in sums[c * dims : (c + 1) * dims]] if counts[c] else now[c] for c in range(k)], np.int64)


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", report: list[dict] | None = None) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that counts.

    ``report`` gets, for each round, how many distances were taken.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vector_col, dims, scale)
    id_type = vectors.schema["id"].dataType
    result = T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    now = starts(vectors, k, seed)
    if not len(now):
        empty = spark.createDataFrame([], result)
        return named(empty, id_col, [], [])
    kind = block_type(id_type, dims)
    schema = to_arrow(kind)
    path, blocks, before = "", vectors.mapInArrow(first_blocks(now, schema), kind), None
    for step in range(rounds + 1):
        if step:
            blocks = blocks.mapInArrow(next_blocks(now, before, schema), kind)
        target = scratch_path(spark, f"centroids-{step}")
        blocks.write.option("compression", "zstd").parquet(target)
        if path:
            delete_path(spark, path)
        path, blocks = target, spark.read.schema(kind).parquet(target)
        if report is not None:
            report.append({"round": step, "distances": blocks.agg(F.sum("distances")).first()[0]})
        if step < rounds:
            before, now = now, moved_to(blocks, now)
    return named(blocks.mapInArrow(unpacked(now, to_arrow(result)), result), id_col, summed(blocks, "inertia"), now.tolist())


def to_arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def unpacked(now: np.ndarray, schema: pa.Schema):
    """Blocks to one row a vector, with the exact distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                v = np.frombuffer(batch["vectors"][i].as_py(), np.int32).reshape(-1, now.shape[1])
                own = np.frombuffer(batch["own"][i].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([batch["ids"][i].values, pa.array(own), pa.array(squared(v, now[own]))], schema=schema)

    return run


def named(rows: DataFrame, id_col: str, inertia: list[int], centroids: list[list[int]]) -> DataFrame:
    """The result with the values of each cluster, ``k`` of them, as constants of the plan."""
    of = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return rows.select(F.col("id").alias(id_col), "cluster", "distance", of(inertia, "bigint").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))
