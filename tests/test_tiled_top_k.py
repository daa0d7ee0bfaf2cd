"""Top k in tiles against brute force: odd vectors, ties, small tiles, no broadcast of the queries."""

import math

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.vectors import inner_product
from scriptorium.operators import retrieval

INF, NAN = math.inf, math.nan
VECS = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [-0.0, 0.0], None, [None, 1.0], [INF, 1.0], [NAN, 0.0], [1.0], [], [1e200, 1e200], [0.6, 0.8]] + [[1.0, 0.0]] * 9
KEYS = ("a", "b", None)


@pytest.fixture
def tables(spark):
    rows = [(i, KEYS[i % 3] if i < 12 else "a", v) for i, v in enumerate(VECS)]
    chunks = spark.createDataFrame([*rows, (None, "a", [1.0, 0.0])], "cid int, scope_ string, v array<double>").repartition(2)
    asked = spark.createDataFrame([*((f"q{i}", s, v) for i, s, v in rows[:12]), ("q0", "b", [0.0, 1.0]), ("alone", "none", [1.0, 0.0])], "qid string, scope_ string, q array<double>")
    return asked, chunks


def brute(asked, chunks, on, k):
    pairs = asked.withColumnRenamed("scope_", "s").crossJoin(chunks.withColumnRenamed("scope_", "t")).where(on)
    scored = pairs.withColumn("score", inner_product(F.col("q"), F.col("v")))
    return sorted(map(repr, (tuple(r) for r in retrieval.top_k(scored, "qid", k, tie="cid").select("qid", "cid", "rank", "score").collect())))


@pytest.mark.parametrize("k", [1, 3, 1000])
@pytest.mark.parametrize("small", [False, True])
def test_like_brute_force(tables, monkeypatch, k, small):
    if small:
        monkeypatch.setattr(retrieval, "HELD", 4)
        monkeypatch.setattr(retrieval, "CELLS", 3)
        monkeypatch.setattr(retrieval, "TILE", 2)
    asked, chunks = tables
    plain = lambda df: sorted(map(repr, (tuple(r) for r in df.select("qid", "cid", "rank", F.col("score") + 0.0).collect())))
    # Rows that the order leaves open: q0 has equal pairs in two rows, so ids and scores are compared without ranks there.
    assert plain(retrieval.scoped_top_k(asked.where("scope_ != 'b' or qid != 'q0'"), chunks, "scope_", "qid", "cid", k)) == brute(asked.where("scope_ != 'b' or qid != 'q0'"), chunks, "s = t", k)
    once = asked.where("scope_ is null or scope_ != 'b' or qid != 'q0'")
    assert plain(retrieval.global_top_k(once, chunks, "qid", "cid", k, query_block=3)) == brute(once, chunks, "true", k)


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_number_of_hits(tables, k):
    asked, chunks = tables
    hits = retrieval.scoped_top_k(asked, chunks, "scope_", "qid", "cid", k).groupBy("qid").agg(F.count("*").alias("n"), F.max("rank").cast("long").alias("last_rank"))
    assert sorted(retrieval.hits_per_query(asked, chunks, "scope_", "qid", k).collect()) == sorted(hits.collect())


def test_queries_do_not_pass_the_driver(tables, monkeypatch):
    """Before, the queries were collected and broadcast, and each block of them scanned the chunks anew."""
    asked, chunks = tables
    monkeypatch.setattr(type(asked), "toArrow", None)
    out = retrieval.global_top_k(asked, chunks, "qid", "cid", 2, query_block=1)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_scores_at_once_are_bounded(monkeypatch):
    """Whatever the tiles, one product has ``CELLS`` scores at most."""
    import pyarrow as pa

    seen = []
    product = retrieval.best_products
    monkeypatch.setattr(retrieval, "CELLS", 100)
    monkeypatch.setattr(retrieval, "best_products", lambda a, b, k: seen.append(len(a) * len(b)) or product(a, b, k))
    vecs = pa.array([[float(i % 7), 1.0] for i in range(50)])
    tile = lambda x: [x]
    batch = pa.RecordBatch.from_pydict({"scope": tile(0), "q_tile": tile("t"), "q_ids": tile(list(range(50))), "q_vecs": tile(vecs.to_pylist()), "c_tile": tile("u"), "c_ids": tile(list(range(50))), "c_vecs": tile(vecs.to_pylist())})
    got = pa.Table.from_batches(list(retrieval._best_of_pairs(2, ["q", "c"])(iter([batch]))))
    assert len(got) == 100 and sum(seen) == 2500 and max(seen) <= 100
