"""Lines of one to four words are deduplicated as well."""

import os

from test_corpus_operators import docs_of

import corpus_pipeline
from scriptorium.llm.queries import QUERIES

ROWS = [(1, "home\nabout us\na line of six words here", "a"), (2, "Home\nabout\tus\nus at home\n\n", "a"), (3, "x\nhome\nhome", "b"), (4, None, "b"), (5, "a line of six words here\n\n", "b"), (6, "home\nhome", "b")]


def test_repeated_short_lines_go(spark, tmp_path):
    docs_of(spark, ROWS).write.parquet(os.path.join(str(tmp_path), "documents.parquet"))
    got = {r.doc_id: r.removed_lines for r in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: "", 2: "0,1", 3: "1,2", 4: "", 5: "0", 6: "0,1"}


def test_pipeline_stage_removes_short_lines(spark, sf):
    """Document 5 keeps only blank lines and 6 nothing, so both go; 4 came without a text and stays."""
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs_of(spark, ROWS), sf).collect()}
    assert got == {1: (ROWS[0][1], len(ROWS[0][1])), 2: ("us at home\n\n", 12), 3: ("x", 1), 4: (None, 0)}
