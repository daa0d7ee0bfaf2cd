"""Windows of subword tokens, by the files of public tokenizers.

A file of the ``tokenizers`` library is a parameter: the driver reads it and
sends its text along (a few MB), so executors need the library but not the file.
Nothing is trained here.  Tokens come without special tokens added; special
strings in a text are what the library makes of them.

Only the borders of windows leave Python, not the offsets of all tokens: for
each window its first character, the one after its last, and its tokens.

Where a vocabulary ends every pre-token at white space (:func:`split_at_space`),
a text is tokenized by its stretches between white space.  Most of them are few
distinct ones, whose numbers of tokens a worker keeps; the library is asked for the
others, and for the borders within a stretch where a window begins or ends.

Defined results: null and empty texts, and texts without a token, have no
window; a text of any length is tokenized whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import check_window

#: The longest text in tokens that the usual scientific embedder takes; a fixed value.
MAX_TOKENS = 512
#: Characters that are given to the library at once.
TOGETHER = 1 << 20
#: Stretches whose number of tokens a worker keeps, those whose borders it keeps, and the characters of each at most.
CACHE, BORDERS, KEPT = 1 << 19, 1 << 14, 64
#: What stands between stretches: ASCII white space.
SPACES = re.compile(r"([ \t-\r]+)")
#: Pre-token patterns that never match white space, and normalizers that do not reach across it.
APART = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",)
WITHIN = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def tokenizer_of(definition: str):
    """The library's tokenizer, one thread, nothing cut or filled up."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(definition)
    made.no_truncation()
    made.no_padding()
    return made


def encoded(tokenizer, texts: list[str]) -> Iterator[list[tuple[int, int]]]:
    """Character offsets of the tokens of each text, some texts at a time."""
    some: list[str] = []
    size = 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield from (e.offsets for e in tokenizer.encode_batch(some, add_special_tokens=False))
            some, size = [], 0
    yield from (e.offsets for e in tokenizer.encode_batch(some, add_special_tokens=False))


def window_borders(offsets: list[tuple[int, int]], size: int, overlap: int) -> list[dict[str, int]]:
    """First character, end and tokens of each window; the last is the first to reach the end."""
    out = []
    for at in range(0, len(offsets), size - overlap):
        last = min(at + size, len(offsets))
        out.append({"s": offsets[at][0], "e": offsets[last - 1][1], "n": last - at})
        if last == len(offsets):
            break
    return out


def split_at_space(definition: str) -> bool:
    """Whether it is known that a text has the tokens of its stretches between white space."""
    made = json.loads(definition)
    normalizer, first = made.get("normalizer"), made.get("pre_tokenizer") or {}
    steps = (normalizer or {}).get("normalizers", [normalizer] if normalizer else [])
    first = (first.get("pretokenizers") or [first])[0]
    cut = first.get("type") == "Split" and (first["behavior"], first["invert"]) == ("Removed", True) and first["pattern"].get("Regex") in APART
    bare = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in made.get("added_tokens", []))
    return cut and bare and all(s in WITHIN for s in steps) and made.get("post_processor") is None


class Stretches(dict):
    """Tokens of each stretch: kept numbers, then the library's; and the borders of the tokens of one."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.spans = lru_cache(BORDERS)(lambda stretch: tokenizer.encode(stretch, add_special_tokens=False).offsets)

    def __missing__(self, stretch: str) -> int:
        n = len(self.tokenizer.encode(stretch, add_special_tokens=False))
        if len(stretch) <= KEPT:
            if len(self) >= CACHE:
                self.clear()
            self[stretch] = n
        return n


def worker_stretches(key: str, definition: Broadcast) -> Stretches:
    """The table of this Python worker, which outlives the task: functions are sent anew with each."""
    kept = sys.modules.setdefault("_subword_stretches", types.ModuleType("_subword_stretches")).__dict__
    if kept.get("key") != key:
        kept["key"], kept["stretches"] = key, Stretches(tokenizer_of(definition.value))
    return kept["stretches"]


def borders_by_stretch(text: str, known: Stretches, size: int, overlap: int) -> list[dict[str, int]]:
    """:func:`window_borders` of a text whose stretches are tokenized apart."""
    parts = SPACES.split(text)  # stretches and what is between them, in turn
    first = list(accumulate(map(known.__getitem__, parts[::2]), initial=0))
    start = list(accumulate(map(len, parts), initial=0))

    def place(token: int, end: int) -> int:
        i = bisect_right(first, token) - 1
        stretch = parts[2 * i]
        spans = known.spans(stretch) if len(stretch) <= KEPT else known.spans.__wrapped__(stretch)
        return start[2 * i] + spans[token - first[i]][end]

    out = []
    for at in range(0, first[-1], size - overlap):
        last = min(at + size, first[-1])
        out.append({"s": place(at, 0), "e": place(last - 1, 1), "n": last - at})
        if last == first[-1]:
            break
    return out


def subword_windows(spark: SparkSession, path: str, size: int = 512, overlap: int = 64) -> Callable[[Column], Column]:
    """Windows of a text as ``array<struct<s,e,n>>``."""
    check_window(size, overlap)
    definition = read_definition(path)
    sent, apart = spark.sparkContext.broadcast(definition), split_at_space(definition)
    key = f"{spark.sparkContext.applicationId} {sent._jbroadcast.id()}"

    @F.pandas_udf("array<struct<s:int,e:int,n:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if apart:
            known = worker_stretches(key, sent)
            for texts in batches:
                yield pd.Series([borders_by_stretch(t or "", known, size, overlap) for t in texts])
            return
        tokenizer = tokenizer_of(sent.value)
        for texts in batches:
            yield pd.Series([window_borders(o, size, overlap) for o in encoded(tokenizer, [t or "" for t in texts])])

    return run


def cut_to_tokens(spark: SparkSession, path: str, most: int = MAX_TOKENS) -> Callable[[Column], Column]:
    """A text up to the end of its ``most``-th token, which is all that an embedder of that length sees."""
    windows = subword_windows(spark, path, most, 0)
    return lambda text: F.when(F.size(windows(text)) > 1, F.substring(text, F.lit(1), F.get(windows(text), F.lit(0))["e"])).otherwise(text)
