"""Clustering against plain k-means in Python's whole numbers."""

import hashlib
import random

import pytest
from pyspark.errors import PySparkException

from scriptorium.llm import centroids


def by_hand(rows, k, rounds, dims, scale, seed):
    import math

    kept = [(i, tuple(math.floor(x * scale) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, m), c) for c, m in enumerate(means))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        means = [tuple(sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)) if c in groups else m for c, m in enumerate(means)]
    final = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in final if c == x) for x in range(len(means))]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for i, c, d in final), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_is_plain_k_means(spark, monkeypatch, seed):
    """Few distinct coordinates, so that distances tie and vectors repeat."""
    monkeypatch.setattr(centroids, "BLOCK", 7)
    rng = random.Random(seed)
    rows = [(i // 2 if i % 5 == 0 else i, [rng.choice([-1.0, -0.26, 0.0, 0.25, 0.5]) for _ in range(3)]) for i in range(150)]
    rows += [(500, None), (501, [1.0, 2.0]), (502, [1.0, None, 2.0]), (503, [1.0, float("nan"), 0.0]), (504, [float("inf")] * 3), (None, [0.1, 0.2, 0.3]), (505, []), (506, [0.0] * 4)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, `a.b` string, cluster int").repartition(3)
    report = []
    got = centroids.cluster(frame, k=5, rounds=6, dims=3, scale=16, report=report)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows, 5, 6, 3, 16, 3)
    assert report[0]["distances"] == 151 * 5 and all(r["distances"] <= 151 * 5 for r in report)


def test_bounds_skip_distances(spark, sf):
    report = []
    n = centroids.cluster(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), report=report).count()
    assert sum(r["distances"] for r in report[1:]) < 0.7 * 8 * n * (len(report) - 1)


def test_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], kind)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [0.5] * 63)], kind)).collect() == []
    rows = [(1, [0.5] * 64), (1, [0.5] * 64), (None, [-0.001] * 64)]
    got = centroids.cluster(spark.createDataFrame(rows, kind)).collect()
    assert sorted(map(tuple, got), key=str) == by_hand([(i, v) for i, v in rows], 8, 10, 64, 1024, 3)
    with pytest.raises(PySparkException, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], kind)).collect()
