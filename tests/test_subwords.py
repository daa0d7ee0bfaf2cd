"""Subword windows against the library, window by window."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.functions import subwords
from scriptorium.operators import chunking
from scriptorium.queries import QUERIES

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
SPACE = " \t\n\r\x0b\f"


def by_hand(text, tokenizer, size, overlap):
    offsets = tokenizer.encode(text or "", add_special_tokens=False).offsets
    out, start = [], 0
    while start < len(offsets):
        end = min(start + size, len(offsets))
        piece = text[offsets[start][0] : offsets[end - 1][1]].strip()
        if piece:
            out.append((len(out), piece, end - start))
        if end == len(offsets):
            break
        start += size - overlap
    return out


def test_query_is_the_library(spark, sf):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["subword_windows"](spark, sf).collect())
    assert got == sorted((d.doc_id, *w) for d in docs for w in by_hand(d.text, tokenizer, 128, 32))


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("shape", [(1, 0), (3, 2), (5, 1)])
def test_any_text(spark, name, shape):
    path = public_tokenizers.path(name)
    texts = [None, "", " \n ", "one", "Don't\n\nstop, BIBREF19 néé 日本 \U0001f642\U0001f642 end", "  a \n\n\n\n b  ", "x" * 3000, "<|endoftext|> a <|endoftext|>"]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "k int, t string, other int").repartition(3)
    windows = subwords.subword_windows(spark, path, *shape)
    got = chunking.chunk_spans(docs, "k", "t", windows(F.col("t")), keep=("other",)).drop("other")
    tokenizer = Tokenizer.from_file(path)
    assert sorted(map(tuple, got.collect())) == sorted((k, *w) for k, t in enumerate(texts) for w in by_hand(t, tokenizer, *shape))
    with pytest.raises(ValueError):
        subwords.subword_windows(spark, path, 3, 3)


def test_cut(spark):
    path = public_tokenizers.path(FILES[0])
    docs = spark.createDataFrame([("one two three four",), ("one two",), (None,), ("",)], "t string")
    got = docs.select(subwords.cut_to_tokens(spark, path, 3)(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["one two three", "one two", None, ""]


def test_stretches_have_the_tokens_of_the_whole_text(spark, sf):
    """White space of every kind, special strings, marks that combine, and words beyond what a task keeps."""
    definition = [subwords.read_definition(public_tokenizers.path(n)) for n in FILES]
    assert [subwords.split_at_space(d) for d in definition] == [True, False]
    tokenizer = subwords.tokenizer_of(definition[0])
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    texts = [d.text or "" for d in docs] + ["a b c ́e é\tDON'T 's\x0b'S İI \x1c\x85 <|endoftext|>x y<|endoftext|> <| startoftext|>", "", " \n", "́ ​", "x" * 3000 + " " + "é" * 70]
    known = subwords.Stretches(tokenizer)
    for text in texts:
        whole = tokenizer.encode(text, add_special_tokens=False).offsets
        for shape in ((128, 32), (1, 0), (3, 2)):
            assert subwords.borders_by_stretch(text, known, *shape) == subwords.window_borders(whole, *shape)
    assert max(map(len, known)) <= subwords.KEPT
