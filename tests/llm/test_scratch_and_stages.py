"""Scratch scopes, and pipeline stages on nulls, empty tables, repeated rows and clashing names."""

import os

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import docs_of, odd_rows

import corpus_pipeline
from scriptorium.llm import line_dedup, shared, wu_manber

#: Names that the operators use for their own columns.
CLASHING = ("score", "predicted", "neighbours", "n_words", "hit_spans", "n_hit", "target", "copies", "taken", "tid", "gone", "sid", "component_id", "row", "had", "id", "key", "_", "__", "a.b", "back`tick", "mark", "map", "np", "line", "words")


def clashing(spark, rows):
    return docs_of(spark, rows).drop("sid", "score", "n").withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_tables(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = clashing(spark, odd_rows())
    out = stage(spark, docs, sf)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    ids = sorted({str(r.doc_id) for r in rows})
    want = {"line_dedup": ["1", "2", "3", "4", "5", "None"], "ngram_join": ["1", "2", "3", "4", "5", "None"]}
    assert ids == want.get(name, ids)
    if name in ("toxicity", "decontamination"):
        assert len(rows) == len(odd_rows())
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_earlier_result_survives_a_run(spark, sf):
    early = line_dedup.dedup_report(docs_of(spark, [(1, "a b c\na b c", "s")]))
    corpus_pipeline.run(spark, sf)
    assert early.first().n_removed == 1


def test_scope_deletes_its_own(spark):
    outside = shared.materialize(spark.range(3), "outside")
    with shared.scratch_scope(spark):
        inside = shared.materialize(spark.range(3), "inside")
        path = inside.inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(path) and outside.count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        shared.shared_dir(Session())


def test_shards_equal_one(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(14))) for i in range(40)], "item_id long, text string")
    docs = docs_of(spark, [(i, f"before {' '.join(f'w{i}x{j}' for j in range(2, 13))} after", "a") for i in range(0, 60, 3)])
    one = wu_manber.contamination(docs, items, keep=["doc_id"]).collect()
    assert sorted(map(str, one)) == sorted(map(str, wu_manber.contamination(docs, items, keep=["doc_id"], shard_bytes=900).collect()))
    assert sum(r.contaminated for r in one) == 14


def test_large_benchmark_is_held_in_arrays():
    body = [(str(i), " ".join(f"word{(i * 7 + j * j) % 5000}" for j in range(400)).encode()) for i in range(700)]
    size = sum(len(t) for _, t in body)
    vocabulary, names, starts, stream, groups = wu_manber.Searcher(body).compiled
    held = len(vocabulary) + starts.nbytes + stream.nbytes + sum(len(g[4]) + g[5].nbytes + g[6].nbytes for g in groups)
    assert held < 8 * size
