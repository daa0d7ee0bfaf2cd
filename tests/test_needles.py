"""Short and long needles against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import retrieval


@pytest.mark.parametrize("shard", [1, 30, 4 << 20])
def test_contained_is_plain_containment(spark, shard):
    rng = random.Random(shard)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randrange(40))) for _ in range(60)] + [None, ""]
    needles = ["".join(rng.choice("ab é") for _ in range(rng.randrange(1, 9))) for _ in range(40)] + ["", "a", "a", "zz"]
    body = spark.createDataFrame([(t,) for t in texts], "body string").repartition(4)
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = sorted(r.needle for r in retrieval.contained(asked, body, shard).collect())
    assert got == sorted({n for n in needles if n and any(n in (t or "") for t in texts)})


def test_one_scan_for_any_number_of_needles(spark):
    body = spark.range(100).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("body"))
    asked = spark.range(5000).select(F.col("id").cast("string").alias("needle"))
    plan = retrieval.contained(asked, body)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(int(r.needle) for r in plan.collect()) == list(range(100))


def test_evidence_of_all_lengths(spark):
    texts = ["the quick brown fox jumps", "over the lazy dog", "the quick brown fox jumps", None]
    needles = [(1, "quick brown fox"), (2, "quick fox"), (3, "dog"), (4, "ver the la"), (5, ""), (6, None), (7, "k b"), (8, "cat")]
    got = retrieval.covered_evidence(spark.createDataFrame(needles, "id int, n string"), spark.createDataFrame([(t,) for t in texts], "t string"), F.col("n"), F.col("t"), "id")
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 7]
