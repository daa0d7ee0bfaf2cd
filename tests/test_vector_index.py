"""The written index against the plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import retrieval
from scriptorium.operators.vector_index import VectorIndex


def vectors(spark, lo, hi, seed=1):
    """Groups of vectors around twelve directions."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(0).normal(size=(12, 8))
    v = centres[np.arange(lo, hi) % 12] + 0.05 * rng.normal(size=(hi - lo, 8))
    return spark.createDataFrame([(i, x.tolist()) for i, x in zip(range(lo, hi), v, strict=True)], "vec_id long, v array<float>")


def same(found, queries, rows, k):
    want = retrieval.global_top_k(queries, rows, "query_id", "vec_id", k).select("query_id", "vec_id", "rank", "score")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_search_is_exact_and_skips(spark, tmp_path):
    rows = vectors(spark, 0, 600)
    index = VectorIndex(spark, str(tmp_path))
    index.build(rows, clusters=24)
    one = rows.where("vec_id = 5").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    found = index.search(one, 5)
    same(found.hits, one, rows, 5)
    assert 0 < len(found.read) <= found.clusters // 3 and found.clusters == 24
    files = {p.split("cluster=")[1].split("/")[0] for p in index.tables.read("vectors").where(F.col("cluster").isin(found.read)).inputFiles()}
    assert len(index.tables.read("vectors").inputFiles()) > len(found.read) and files >= {str(c) for c in found.read}
    many = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    same(index.search(many, 7).hits, many, rows, 7)
    same(index.search(one, 1000).hits, one, rows, 1000)


def test_added_rows_are_found(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path))
    index.build(vectors(spark, 0, 120), clusters=6)
    far = spark.createDataFrame([(1000, [50.0] * 8), (1001, [-50.0] * 8), (1002, None)], "vec_id long, v array<float>")
    index.add(far)
    rows = vectors(spark, 0, 120).unionByName(far.where("v is not null"))
    queries = rows.where("vec_id in (3, 1000, 1001)").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    same(index.search(queries, 4).hits, queries, rows, 4)


def test_embeddings(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    index = VectorIndex(spark, str(tmp_path))
    index.build(rows, clusters=8, rounds=1)
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    same(index.search(queries, 5).hits, queries, rows, 5)


def test_empty(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path))
    index.build(vectors(spark, 0, 0))
    query = spark.createDataFrame([(1, [1.0] * 8)], "query_id long, q array<float>")
    assert index.search(query, 3).hits.count() == 0
    with pytest.raises(ValueError):
        index.search(query, 0)
