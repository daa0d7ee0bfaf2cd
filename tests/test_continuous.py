"""Streams against the batch operators on the same rows, over several splits and faults."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import incremental
from scriptorium.sources.snapshots import Snapshots
from scriptorium.streaming import continuous


def split(rows, order, bounds, folder):
    """One file for each range of ``order``, in that order."""
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        rows.where((F.col(order) >= lo) & (F.col(order) < hi)).coalesce(1).write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("bounds", [[0, 10**9], [0, 300, 310, 700, 10**9]])
def test_window_stats_equal_the_batch(spark, sf, tmp_path, bounds):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("value", F.round(F.col("value") * 100).cast("long"))
    stream = split(events, "event_id", bounds, str(tmp_path / "in"))
    run = continuous.run_window_stats(stream, str(tmp_path / "out"), "stats", str(tmp_path / "cp"), "ts", ["event_type"], "value")
    assert run.rows == events.count() and run.batches == len(bounds) - 1
    got = continuous.current_stats(spark, str(tmp_path / "out"), "stats", ["event_type"])
    want = continuous.window_stats(events, "ts", ["event_type"], "value", "1 day")
    late = want.agg(F.sum("n")).first()[0] - got.agg(F.sum("n")).first()[0]
    assert late == run.late == 0 and sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_counted(spark, tmp_path):
    rows = [(0, "2024-01-01 00:10:00", 1), (1, "2024-01-03 00:00:00", 2), (2, "2024-01-03 00:30:00", 8), (3, "2024-01-01 00:20:00", 4), (4, None, 16)]
    events = spark.createDataFrame(rows, "i long, at string, value long").withColumn("at", F.to_timestamp("at")).withColumn("k", F.lit("k"))
    stream = split(events, "i", [0, 1, 2, 3, 5], str(tmp_path / "in"))
    run = continuous.run_window_stats(stream, str(tmp_path / "out"), "stats", str(tmp_path / "cp"), "at", ["k"], "value")
    got = continuous.current_stats(spark, str(tmp_path / "out"), "stats", ["k"])
    assert run.late == 1 and sorted((str(r.window_start)[:10], r.n, r.total) for r in got.collect()) == [("2024-01-01", 1, 1), ("2024-01-03", 2, 10)]


@pytest.mark.parametrize("bounds", [[0, 10**9], [0, 7, 50, 51, 130, 10**9]])
def test_first_seen_equals_the_batch(spark, sf, tmp_path, bounds):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 100_000)).unionByName(spark.createDataFrame([(200_000, None), (200_001, None)], docs.schema))
    stream = split(docs, "doc_id", bounds, str(tmp_path / "in"))
    key = tx.match_key(F.col("text"))

    def fault(number):
        if number == len(bounds) - 2:
            raise RuntimeError("lost")

    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    with pytest.raises(Exception, match="lost"):
        continuous.run_first_seen(stream, out, "kept", cp, key, F.col("doc_id"), before_publish=fault)
    continuous.run_first_seen(stream, out, "kept", cp, key, F.col("doc_id"))
    got = sorted(tuple(r) for r in Snapshots(spark, out).read("kept").select("doc_id", "text").collect())
    want = sorted(tuple(r) for r in incremental.first_seen(docs, key, [F.col("doc_id")]).collect())
    assert got == want
    # A replay of published batches, as after the loss of the checkpoint's last entries, adds nothing.
    continuous.run_first_seen(stream, out, "kept", cp + "-lost", key, F.col("doc_id"))
    assert Snapshots(spark, out).read("kept").count() == len(want)


def test_keys_expire(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, text string")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for part in range(2):
        stream = split(rows.withColumn("doc_id", F.col("doc_id") + 10 * part), "doc_id", [10 * part, 10 * part + 5], str(tmp_path / "in"))
        continuous.run_first_seen(stream, out, "kept", cp, F.col("text"), F.col("doc_id"), expiry_ms=1)
    assert sorted(r.doc_id for r in Snapshots(spark, out).read("kept").collect()) == [0, 1, 10, 11]
