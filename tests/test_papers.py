import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import plugins
from scriptorium.operators import chunking, citations, incremental, parsing, retrieval, summaries
from scriptorium.plans import evaluation, indexing

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Deep <b>x</b> nets</title></titleStmt></fileDesc>
<profileDesc><abstract><div><p>We study <i>mixed</i> content.</p><p> </p><p>Second.</p></div></abstract></profileDesc></teiHeader>
<text><body><div><head n="1">Introduction</head><p>An introduction of some length.</p><div><head>Inner</head><p>A nested section here.</p></div></div>
<div><head>Fig 1</head><p>ab</p></div><div><p>No heading but enough text.</p><p>More.</p></div></body></text></TEI>"""
EMPTY = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body/></text></TEI>'


@pytest.fixture(scope="module")
def parsed(spark):
    papers = spark.createDataFrame([("p1", TEI), ("p2", EMPTY), ("p3", "<broken"), ("p4", None)], "arxiv_id string, tei string")
    return {r.arxiv_id: r for r in parsing.parsed_papers(papers).collect()}


def test_tei(parsed):
    p = parsed["p1"]
    assert (p.title, p.abstract) == ("Deep", "We study mixed content. Second.")
    assert [(s.head, s.n) for s in p.sections] == [("Introduction", "1"), ("Inner", ""), ("[untitled]", "")]
    assert p.sections[2].text == "No heading but enough text.\nMore."
    assert parsed["p2"].title == "[unknown title]" and parsed["p2"].sections == []
    assert parsed["p3"].error and parsed["p4"].error


def test_section_length_limits():
    assert len(parsing.parse_tei(TEI, 0)["sections"]) == 4
    assert parsing.parse_tei(TEI, 10_000)["sections"] == []


def test_reports(spark):
    rows = parsing.parsed_papers(spark.createDataFrame([("p1", TEI), ("p3", "<broken")], "arxiv_id string, tei string"))
    report = {r.arxiv_id: r for r in parsing.smoke_report(rows).collect()}
    assert report["p1"].num_sections == 3 and report["p1"].sections[0].text_len == len("An introduction of some length.")
    entry = {r.arxiv_id: r for r in parsing.manifest_entry(rows).collect()}
    assert (entry["p1"].grobid, entry["p1"].num_sections, entry["p1"].xml_size) == ("ok", 3, len(TEI))
    assert entry["p3"].grobid == "failed" and entry["p3"].error


def loop_windows(n, size, overlap):
    out, at = [], 0
    while at < n:
        out.append((at, min(at + size, n)))
        if at + size >= n:
            break
        at += size - overlap
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 70), min_size=1, max_size=5), st.integers(1, 12), st.integers(0, 11))
def test_windows_cover_all_tokens(spark, counts, size, overlap):
    overlap = min(overlap, size - 1)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate(counts)], "id int, text string")
    for rows in (chunking.chunk_words(docs, "id", "text", size, overlap).collect(), chunking.chunk_offsets(docs, "id", "text", plugins.offsets()(F.col("text")), size, overlap).collect()):
        for i, n in enumerate(counts):
            mine = sorted((r.chunk_idx, r.text, r.token_count) for r in rows if r.id == i)
            assert mine == [(k, " ".join(f"w{x}" for x in range(a, b)), b - a) for k, (a, b) in enumerate(loop_windows(n, size, overlap))]


def test_bad_windows():
    for size, overlap in ((8, 8), (0, 0), (4, -1)):
        with pytest.raises(ValueError):
            chunking.check_window(size, overlap)


def test_build_index(spark):
    papers = spark.createDataFrame([("p1", TEI), ("p2", EMPTY), ("p0", TEI)], "arxiv_id string, tei string")
    done = spark.createDataFrame([("p0",)], "arxiv_id string")
    index = indexing.build_index(papers, plugins.offsets(), plugins.embed(lambda: plugins.HashedEmbedder(8)), done, 8, 2)
    rows = sorted(index.collect(), key=lambda r: r.chunk_idx)
    assert [r.chunk_id for r in rows] == [f"p1::{i}" for i in range(len(rows))] and len(rows) > 1
    assert "Deep" in rows[0].text and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)
    manifest = {r.arxiv_id: r.num_chunks for r in indexing.index_manifest(papers, index).collect()}
    assert manifest["p2"] == 0 and manifest["p1"] == len(rows)


def test_top_k(spark):
    chunks = spark.createDataFrame([(0, "p1", [1.0, 0.0]), (1, "p1", [0.0, 1.0]), (2, "p2", [1.0, 0.0])], "cid int, paper string, v array<double>")
    asked = spark.createDataFrame([(7, "p1", [1.0, 0.0]), (8, "none", [1.0, 0.0])], "qid int, paper string, q array<double>")
    scoped = retrieval.scoped_top_k(asked, chunks, "paper", "qid", "cid", 999).collect()
    assert sorted((r.qid, r.cid, r.rank, r.score) for r in scoped) == [(7, 0, 1, 1.0), (7, 1, 2, 0.0)]
    got = retrieval.global_top_k(asked, chunks, "qid", "cid", 2, query_block=1).collect()
    assert sorted((r.qid, r.rank, r.cid) for r in got) == [(7, 1, 0), (7, 2, 2), (8, 1, 0), (8, 2, 2)]
    with pytest.raises(ValueError):
        retrieval.top_k(chunks, "qid", 0)


def test_covered_evidence(spark):
    texts = spark.createDataFrame([("the quick brown fox",), ("xa by c",)], "t string")
    items = spark.createDataFrame([(1, "quick brown"), (2, "uick brown fo"), (3, "a b"), (4, "slow fox"), (5, ""), (6, "a by c")], "i int, n string")
    got = retrieval.covered_evidence(items, texts, F.col("n"), F.col("t"), "i", shard_bytes=2).collect()
    assert sorted(r.i for r in got) == [1, 2, 3, 6]


def test_graph(spark):
    ref = lambda a, t=None: {"paperId": "x", "title": t, "externalIds": {"ArXiv": a} if a else None}
    record = lambda refs: {"paperId": "x", "title": "t", "externalIds": None, "references": refs}
    from scriptorium.schemas import CITATION_RECORD

    rows = spark.createDataFrame([("a", record([ref("b"), ref("c"), ref("b"), ref(None)])), ("b", record(None)), ("d", record([ref("d")]))], f"arxiv_id string, record {CITATION_RECORD}")
    refs = citations.reference_rows(rows)
    corpus = spark.createDataFrame([("a",), ("b",), ("d",)], "id string")
    m = citations.graph_metrics(corpus, refs).first()
    assert (m.total_refs, m.in_corpus_edges, m.n_edges, m.n_nodes, m.avg_out_degree) == (4, 3, 3, 4, 1.5)
    assert abs(m.density - 3 / 12) < 1e-12
    assert sorted(tuple(r) for r in citations.nodes(corpus, refs).collect()) == [("a", True), ("b", True), ("c", False), ("d", True)]
    empty = citations.graph_metrics(corpus.limit(0), refs.limit(0)).first()
    assert (empty.n_edges, empty.n_nodes, empty.density, empty.avg_out_degree) == (0, 0, 0.0, 0.0)


def test_incremental(spark):
    cache = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", incremental.NOT_FOUND, 1)], "paper_id string, response_json string, fetched_at long")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    got = {r.paper_id: (r.status, r.response_json) for r in incremental.probe(ids, cache).collect()}
    assert got == {"a": ("hit", "new"), "b": ("negative", incremental.NOT_FOUND), "c": ("miss", None)}
    left = spark.createDataFrame([(1, "x", "l"), (2, "y", "l")], "k int, s string, only_l string")
    right = spark.createDataFrame([(2, "z", 5), (3, None, 6)], "k int, s string, only_r int")
    assert sorted(tuple(r) for r in incremental.merged_status(left, right, "k").collect()) == [(1, "x", "l", None), (2, "z", "l", 5), (3, None, None, 6)]
    assert incremental.coverage(left.limit(0), F.lit(True)).first().pct == 0.0


def test_excerpt_budget(spark):
    sections = spark.createDataFrame([(1, 0, "abcde"), (1, 1, "fghij"), (1, 2, "x"), (2, 0, "abcdefghij"), (2, 1, "z"), (3, 0, "long text")], "id int, k int, t string")
    for budget, want in ((10, {(1, "abcde"), (1, "fghij"), (2, "abcdefghij"), (3, "long text")}), (7, {(1, "abcde"), (1, "fg [...]"), (2, "abcdefg [...]"), (3, "long te [...]")}), (-5, {(1, " [...]"), (2, " [...]"), (3, " [...]")})):
        rows = summaries.budgeted_blocks(sections, "id", "k", F.col("t"), F.lit(0), budget).collect()
        assert {(r.id, r.piece) for r in rows} == want


def test_summaries(spark):
    class Scripted:
        def generate(self, system, user, *, temperature, **_):
            if "Deep" in user:
                return '{"tldr":"t","problem":null,"method":" ","results":"a\\n---\\nb","limitations":"l"}'
            return "bad" if temperature else "still bad"

    papers = parsing.parsed_papers(spark.createDataFrame([("p1", TEI), ("p2", EMPTY), ("p3", TEI.replace("Deep", "Other"))], "arxiv_id string, tei string"))
    rows = {r.arxiv_id: r for r in summaries.summarize(papers, Scripted, "sys", "m", F.lit("T")).collect()}
    assert {k: r.status for k, r in rows.items()} == {"p1": "ok", "p2": "empty_tei", "p3": "parse_error"}
    assert rows["p1"].markdown == '---\narxiv_id: p1\ntitle: "Deep"\ngenerated_by: m\ngenerated_at: T\nstatus: ok\n---\n\n# Deep\n\n## TL;DR\nt\n\n## Problem\nNone\n\n## Method\nUnknown\n\n## Results\na\nb\n\n## Limitations\nl\n'
    assert rows["p3"].raw_output == "still bad" and "[PARSE_ERROR]" in rows["p3"].markdown and rows["p2"].raw_output is None


def test_evaluation_plan(spark):
    index = spark.createDataFrame([("p1::0", "p1", 0, "alpha beta", [1.0, 0.0]), ("p1::1", "p1", 1, "gamma", [0.0, 1.0])], "chunk_id string, arxiv_id string, chunk_idx int, text string, embedding array<double>")
    asked = spark.createDataFrame([("q1", "p1", "?", ["alpha beta"], ["Alpha  BETA"], [1.0, 0.0]), ("q2", "px", "?", [], [], [1.0, 0.0]), ("q3", "p1", "?", [], [], [0.0, 1.0])], "question_id string, paper_id string, question string, gold_answers array<string>, gold_evidence array<string>, q array<double>")
    done = spark.createDataFrame([("q3",)], "question_id string")
    rows = evaluation.evaluate(asked, index, plugins.ExtractiveGenerator, 5, done).collect()
    assert [(r.question_id, r.retrieved_chunk_ids, r.recall_at_k, r.answer_f1, r.predicted_answer) for r in rows] == [("q1", ["p1::0", "p1::1"], 1.0, 1.0, "alpha beta")]
    scored = spark.createDataFrame([(1.0, 0.8), (None, 0.6), (0.5, 0.4)], "recall_at_k double, answer_f1 double")
    s = evaluation.run_summary(scored).first()
    assert (s.n_evaluated, s.n_with_evidence, s.mean_recall_at_k) == (3, 2, 0.75) and abs(s.mean_answer_f1 - 0.6) < 1e-12
    assert tuple(evaluation.run_summary(scored.limit(0)).first()) == (0, 0, None, None)


def test_providers(monkeypatch):
    monkeypatch.delenv(plugins.PROVIDER_VARIABLE, raising=False)
    assert plugins.provider_name() == "ollama"
    monkeypatch.setenv(plugins.PROVIDER_VARIABLE, " Extractive ")
    assert plugins.provider_name() == "extractive" and plugins.provider_name("Ollama") == "ollama"
    with pytest.raises(ValueError, match="extractive"):
        plugins.provider_name("nobody")
    plugins.register_provider("Mine", plugins.ExtractiveGenerator)
    assert isinstance(plugins.get_provider("mine"), plugins.ExtractiveGenerator)
    assert plugins.HashedEmbedder(8).encode([]).shape == (0, 8)


def test_first_seen_ties_do_not_depend_on_arrival(spark):
    rows = [(1, "same", "a"), (1, "same", "b"), (1, "same", "c"), (2, "other", "d")]
    got = set()
    for k in range(3):
        frame = spark.createDataFrame(rows[k:] + rows[:k], "n int, text string, tag string").repartition(k + 1)
        got.add(tuple(sorted(tuple(r) for r in incremental.first_seen(frame, F.col("text"), [F.col("n")]).collect())))
    assert len(got) == 1 and len(next(iter(got))) == 2
