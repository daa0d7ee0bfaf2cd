"""Services over HTTP against a local server, and the writers for what they return."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from scriptorium import schemas
from scriptorium.functions import plugins
from scriptorium.operators import incremental
from scriptorium.plans import evaluation
from scriptorium.sources import http, sinks


@pytest.fixture
def server():
    seen = []

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.path, dict(self.headers), body))
            if self.path == "/api/chat":
                code, said = 200, json.dumps({"message": {"content": "said"}}).encode()
            else:
                code, said = (500, b"x" * 300) if b"broken" in body else (200, "<TEI>é</TEI>".encode())
            self.reply(code, said)

        def do_GET(self):
            seen.append((self.path, dict(self.headers), b""))
            self.reply(200, b"{}")

        def reply(self, code, said):
            self.send_response(code)
            self.send_header("Content-Length", str(len(said)))
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *_):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", seen
    httpd.shutdown()


def test_model_server(server):
    url, seen = server
    model = plugins.OllamaGenerator(host=url)
    assert model.generate("sys", "ask", max_tokens=9, temperature=0.0, response_format="json", num_ctx=4096) == "said"
    asked = json.loads(seen[0][2])
    assert asked["options"] == {"num_predict": 9, "temperature": 0.0, "num_ctx": 4096} and asked["format"] == "json" and not asked["stream"]
    assert [m["role"] for m in asked["messages"]] == ["system", "user"]
    model.generate("sys", "ask")
    asked = json.loads(seen[1][2])
    assert "format" not in asked and "num_ctx" not in asked["options"]


def test_metadata_request(server, monkeypatch, spark):
    url, seen = server
    monkeypatch.setenv(http.METADATA_KEY_VARIABLE, "from-env")
    assert http.metadata_fetcher()(url) == (200, b"{}") and http.metadata_fetcher("given")(url)[0] == 200 and http.metadata_fetcher("")(url)[0] == 200
    sent = [{k.lower(): v for k, v in h.items()}.get("x-api-key") for _, h, _ in seen]
    assert sent == ["from-env", "given", None]
    built = spark.range(1).select(http.metadata_url(F.lit("1706.03762")).alias("u")).first().u
    assert built.endswith("/paper/ARXIV:1706.03762?fields=paperId,title,externalIds,references.paperId,references.title,references.externalIds")


def test_conversion(server, spark):
    url, seen = server
    body, kind = http.multipart("input", 'a"b.pdf', b"%PDF", "application/pdf")
    mark = kind.split("boundary=")[1]
    assert body.startswith(f"--{mark}\r\n".encode()) and body.endswith(f"\r\n--{mark}--\r\n".encode()) and b'filename="a_b.pdf"' in body
    pdfs = spark.createDataFrame([("p1", bytearray(b"%PDF good")), ("p2", bytearray(b"broken")), ("p3", None)], "arxiv_id string, content binary")
    got = {r.arxiv_id: r for r in http.converted(pdfs, lambda: http.converter(url)).collect()}
    assert got["p1"].tei == got["p3"].tei == "<TEI>é</TEI>" and got["p1"].error is None
    assert got["p2"].tei is None and got["p2"].error == "status 500: " + "x" * 200
    assert {path for path, _, _ in seen} == {"/api/processFulltextDocument"}
    away = http.converted(pdfs.limit(1), lambda: http.converter("http://127.0.0.1:9")).first()
    assert away.tei is None and away.error


def test_one_attempt():
    calls = []
    assert http.fetch_one("u", lambda u: calls.append(u) or (429, b""), http.PDF_ONCE, lambda s: None)[0] == "failed" and len(calls) == 1


def test_tei_and_manifest_writers(spark, tmp_path):
    papers = spark.createDataFrame([("p1", "<TEI>\n a</TEI>"), ("p2", None)], "arxiv_id string, tei string")
    sinks.write_tei(papers, str(tmp_path / "tei"))
    assert [tuple(r) for r in sinks.read_written_tei(spark, str(tmp_path / "tei")).collect()] == [("p1", "<TEI>\n a</TEI>")]
    rows = spark.createDataFrame([("p1", "ok", 3), ("p2", "failed", None)], "arxiv_id string, grobid string, num_sections int")
    for _ in range(2):  # replaced, not added to
        sinks.write_manifest(rows, str(tmp_path / "m"))
    got = sinks.read_manifest(spark, str(tmp_path / "m"), "struct<grobid:string,num_sections:int>")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))


def test_run_report_counts_earlier_rows(spark, tmp_path):
    row = lambda i, r: json.dumps({"question_id": str(i), "recall_at_k": r, "answer_f1": 0.5, "latency_ms": {"retrieval": None, "llm": 1}})
    (tmp_path / "a.json").write_text("\n".join([row(1, 1.0), row(2, None)]))
    (tmp_path / "b.json").write_text(row(3, 0.0))
    out = evaluation.run_report(spark, str(tmp_path), 9, 2, 1, 5, run_name="r", llm_model="m", git_commit=None).first()
    assert (out.run_name, out.git_commit, out.n_total_questions, out.n_evaluated, out.n_with_evidence, out.mean_recall_at_k) == ("r", None, 9, 3, 2, 0.5)
    assert "latency_ms" in schemas.EVALUATION_ROW


def test_attempts_and_picks(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(10)], "at int, ok boolean")
    ids = lambda n: sorted(r["at"] for r in incremental.until_successes(rows, F.col("ok"), [F.col("at")], n).collect())
    assert ids(2) == [0, 1, 2, 3] and ids(9) == list(range(10)) and ids(0) == []
    with pytest.raises(ValueError):
        incremental.first_in_order(rows, [F.col("at")], -1)
    papers = spark.createDataFrame([("b", 1), ("a", 1), ("bert", 0), ("bert", 0), ("c", 1)], "id string, small int")
    got = incremental.pick_papers(papers, "id", ["gpt", "bert"], F.col("small") == 1, 2).collect()
    assert sorted((r.place, r.id) for r in got) == [(2, "bert"), (3, "a"), (4, "b")]


def test_first_seen_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, None), (4, ""), (5, None)], "k int, t string")
    got = incremental.first_seen(rows, F.col("t"), [F.col("k")]).collect()
    assert sorted((r.k, r.t or "-") for r in got) == [(1, "a"), (3, "-"), (4, "-")]
