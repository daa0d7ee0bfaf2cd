import json
import tarfile

import pytest
from pyspark.sql import functions as F

from scriptorium import schemas
from scriptorium.operators.incremental import NOT_FOUND
from scriptorium.sources import http, readers, sinks
from scriptorium.streaming.resume import run_available


def test_files(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "a.v1.pdf").write_bytes(b"<html>")
    (tmp_path / "z.xml").write_text("<a/>")
    (tmp_path / "y.xml").write_text("<b>\n</b>")
    got = {r.arxiv_id: r.is_pdf for r in readers.read_pdfs(spark, str(tmp_path)).collect()}
    assert got == {"b": True, "a.v1": False}
    assert sorted(r.arxiv_id for r in readers.existing_ids(spark, str(tmp_path)).collect()) == ["a.v1", "b"]
    assert [tuple(r) for r in readers.read_tei(spark, str(tmp_path), 1).collect()] == [("y", "<b>\n</b>")]


def test_questions_and_ids(spark, tmp_path):
    data = {"p1": {"qas": [{"question": "q?", "question_id": "1", "answers": [{"answer": {"yes_no": True}}]}, {"question": "r?", "question_id": "2"}]}, "p2": {}}
    (tmp_path / "dev.json").write_text(json.dumps(data))
    (tmp_path / "train.json").write_text(json.dumps({"p2": {}, "p0": {}}))
    rows = readers.read_questions(spark, str(tmp_path / "dev.json")).orderBy("question_id").collect()
    assert [(r.paper_id, r.question_id, len(r.answers)) for r in rows] == [("p1", "1", 1), ("p1", "2", 0)]
    ids = readers.read_ids(spark, [str(tmp_path / "dev.json"), str(tmp_path / "train.json")]).orderBy("pos").collect()
    assert [r.id for r in ids] == ["p1", "p2", "p0"]


def test_manifests(spark, tmp_path):
    assert readers.read_json_map(spark, str(tmp_path / "none.json"), schemas.INDEX_MANIFEST).count() == 0
    (tmp_path / "m.json").write_text(json.dumps({"a": {"num_chunks": 3, "done": True}, "b": {"done": False}}))
    rows = readers.read_json_map(spark, str(tmp_path / "m.json"), schemas.INDEX_MANIFEST)
    assert [r.id for r in readers.completed_ids(rows).collect()] == ["a"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": \n')
    assert sorted(r.a for r in readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()


def test_archives_and_env(tmp_path):
    (tmp_path / "d-dev.json").write_text('{"p": {}}')
    (tmp_path / "c.jsonl").write_text('{"a":1}\n{"a":2}\n')
    with tarfile.open(tmp_path / "t.tgz", "w:gz") as t:
        for n in ("d-dev.json", "c.jsonl"):
            t.add(tmp_path / n, n)
    assert readers.extract_json_members(str(tmp_path / "t.tgz"), str(tmp_path / "o"), {"dev": "-dev.json", "claims": "c.jsonl"}) == {"dev": 1, "claims": 2}
    env = {"KEPT": "1"}
    readers.load_env("# no\nKEPT=2\nX = 'y z'\nnothing\n", env)
    assert env == {"KEPT": "1", "X": "y z"}


class Script:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), 0

    def __call__(self, url):
        self.calls += 1
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def test_retries():
    waits = []
    ask = lambda *a, policy=http.METADATA: http.fetch_one("u", Script(*a), policy, waits.append)
    assert ask((200, b"x")) == ("ok", b"x", None)
    assert ask((429, b""), OSError("down"), (200, b"y"))[0] == "ok" and waits == [2.0, 4.0]
    assert ask((404, b"")) == ("missing", None, None)
    assert ask((500, b""))[0] == "failed"
    waits.clear()
    assert ask(*[(429, b"")] * 6)[0] == "failed" and waits == [2.0, 4.0, 8.0, 16.0, 32.0]
    assert ask((200, b"<html>"), policy=http.PDF)[0] == "failed"


def test_fetch_in_tasks_and_cache(spark):
    def build():
        return lambda url: (200, b'{"paperId": "x"}') if url == "good" else (404, b"")

    asked = spark.createDataFrame([("a", "good"), ("b", "bad")], "id string, url string")
    rows = http.fetched(asked, build, http.Policy(spacing=0))
    got = {r.paper_id: r.response_json for r in http.cache_rows(rows, 5).collect()}
    assert got == {"a": '{"paperId": "x"}', "b": NOT_FOUND}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "# A"), ("b", "# B")], "arxiv_id string, markdown string")
    sinks.write_jsonl(rows, str(tmp_path / "j"))
    sinks.write_jsonl(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.write_jsonl(rows, str(tmp_path / "j"), rebuild=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_pages(rows, str(tmp_path / "p"))
    assert (tmp_path / "p" / "arxiv_id=a").exists()
    sinks.write_summary(rows.groupBy().count(), str(tmp_path / "s"))
    sinks.write_graph(rows, rows, str(tmp_path / "g"))
    sinks.write_index(rows, str(tmp_path / "i"))
    sinks.write_index(rows, str(tmp_path / "i"))
    assert [t.count() for t in sinks.read_graph(spark, str(tmp_path / "g"))] == [2, 2]
    assert sinks.read_index(spark, str(tmp_path / "i")).count() == 4
    sinks.write_index(rows, str(tmp_path / "i"), rebuild=True)
    assert sinks.read_index(spark, str(tmp_path / "i")).count() == 2


def test_a_manifest_outlives_a_failed_replacement(spark, tmp_path):
    entry = "struct<grobid:string>"
    sinks.write_manifest(spark.createDataFrame([(str(i), "ok") for i in range(5)], "arxiv_id string, grobid string"), str(tmp_path))
    lost = spark.range(4).repartition(4).select(F.col("id").cast("string").alias("arxiv_id"), F.when(F.col("id") < 3, "ok").otherwise(F.raise_error(F.lit("lost"))).alias("grobid"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_manifest(lost, str(tmp_path))
    assert sinks.read_manifest(spark, str(tmp_path), entry).count() == 5


def test_stream_equals_batch_and_runs_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "id long, v string"
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema).coalesce(1).write.parquet(src)
    go = lambda c=cp: run_available(spark, src, schema, out, c, "id", files_per_batch=1)
    go()
    go()
    spark.createDataFrame([(2, "again"), (3, "c")], schema).coalesce(1).write.mode("append").parquet(src)
    go()
    go(cp + "-lost")  # all files once more: nothing is added
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "c")]
