"""Every link between similar documents, against brute force."""

from collections import Counter

import pytest
from test_corpus_operators import docs_of, odd_rows, random_docs
from test_corpus_queries import shingles, similar_pairs

from scriptorium.llm import ngram_join


def star():
    """A pivot with two versions that are similar to each other, and a far one."""
    words = [f"w{i}" for i in range(60)]
    edit = lambda at: " ".join("new" if i in at else w for i, w in enumerate(words))
    return [(1, edit(()), "a"), (2, edit((0,)), "a"), (3, edit((59,)), "a"), (4, edit((0,)), "a"), (5, edit(range(20, 60)), "a")]


@pytest.mark.parametrize("rows", [star(), random_docs(1), random_docs(2), random_docs(5, 150)])
def test_pairs_and_counts_equal_brute_force(spark, rows):
    sets = [shingles(t) for _, t, _ in rows]
    want = {(rows[j][0], rows[i][0]): len(sets[i] & sets[j]) for j, i in similar_pairs(sets)}
    docs = docs_of(spark, rows)
    got = ngram_join.join_pairs(docs).collect()
    assert {(r.left, r.right): r.shared for r in got} == want and len(got) == len(want)
    links = Counter(k for pair in want for k in pair)
    assert {r.doc_id: r.n_links for r in ngram_join.link_counts(docs).collect()} == {k: links[k] for k, _, _ in rows}


def test_odd_rows(spark):
    docs = docs_of(spark, odd_rows())
    assert {(r.left, r.right) for r in ngram_join.join_pairs(docs).collect()} == {(4, 7), (5, 6)}
    got = sorted((str(r.doc_id), r.n_links) for r in ngram_join.link_counts(docs).collect())
    assert got == [("1", 0), ("2", 0), ("3", 0), ("4", 2), ("4", 2), ("5", 1), ("6", 1), ("7", 2), ("None", 0)]
    assert ngram_join.join_pairs(docs_of(spark, [])).count() == 0
