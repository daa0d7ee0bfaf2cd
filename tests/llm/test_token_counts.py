"""Token counts against the library itself."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scriptorium.llm import token_counts
from scriptorium.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def by_library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query_is_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_token_counts"](spark, sf).collect()}
    for d, n in zip(docs, by_library([d.text for d in docs]), strict=True):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), n, n > 2048)


def test_any_characters(monkeypatch):
    monkeypatch.setattr(token_counts, "SLAB", 40)
    rng = random.Random(3)
    parts = [*"ab'sStTdDmMlL09!?.<|>_-&éÉßΣςİ́ 　\x1c\x85\x00\x7f日本ﬁⅧ²가", "\U0001f642", "‍", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "'RE", *" \n\t\x0b\r", *[" "] * 8]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(4000)]
    with open(PATH, encoding="utf-8") as file:
        lengths = token_counts.Lengths({}, token_counts.tokenizer(file.read()))
    assert [sum(lengths[p] for s in token_counts.slabs(t) for p in token_counts.pieces(s)) for t in texts] == by_library(texts)


@pytest.mark.parametrize("cache", [2, 1 << 19])
def test_odd_rows(spark, monkeypatch, cache):
    monkeypatch.setattr(token_counts, "CACHE", cache)
    long = " ".join(f"Word{i % 977} ñandú{i % 31}" for i in range(60_000))
    texts = [None, "", " \n\t ", "one two", "one two", long, "x" * 300_000, "don't <|endoftext|> stop"]
    rows = [(k, t, 7, 1.5, "s") for k, t in enumerate(texts)] + [(None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, `a.b` double, `_` string")
    out = token_counts.with_token_counts(docs, PATH)
    assert sorted(out.columns) == sorted(["doc_id", "text", "a.b", "_", "n_bytes", "n_tokens", "over_limit"])
    want = sorted((str(r[0]), len((r[1] or "").encode()), n) for r, n in zip(rows, by_library([r[1] for r in rows]), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out.collect()) == want
    assert token_counts.with_token_counts(docs.limit(0), PATH).count() == 0
