"""Token counts by a two-tier table of pre-token lengths, without a shuffle.

A byte-pair encoder works on each pre-token alone, so a text has as many tokens
as its pre-tokens have together.  Most pre-tokens of a corpus are few distinct
ones:

1. *Frequent ones.*  A few splits of the input count the pre-tokens of some rows
   each; the driver encodes the most frequent ``TABLE`` of them.  What is
   broadcast is one string and one byte for each: at most ``TABLE * (PIECE + 2)``
   characters.  The sample decides only what is looked up in this tier.
2. *The rest* is encoded where it stands, by the library itself, and kept in a
   cache of the Python worker, which lives as long as the worker does and holds
   at most ``CACHE`` pre-tokens.

No pre-token leaves its task.  Exactness: stretches of printable ASCII between
white space are lower-cased and split by the tokenizer's own pattern, which for
them has no case of its own; a stretch with any other character, or with the
beginning of a special token, is one piece that the library normalizes, splits
and encodes whole.  White space always ends a pre-token, and neither
normalization nor special tokens reach across it.

Defined results: a null text is empty, and an empty text has no tokens;
repeated rows are counted alike; a text of any length is worked on whole, in
stretches cut at white space; a null limit column does not exist; columns of
other names, whatever they are, stay out of the work and pass through
``with_token_counts`` (a column named like a result gives way to it); an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import types
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spread

#: Pre-tokens of the first tier, and the characters that one of them has at most.
TABLE, PIECE = 1 << 16, 32
#: Pre-tokens that a worker keeps in the second tier, and the characters of each at most.
CACHE, KEPT = 1 << 19, 64
#: The sample that chooses the first tier: splits, rows of each, characters of each.
SPLITS, ROWS, CHARS = 32, 2_000, 1 << 22
#: Characters of a text that are split at once.
SLAB = 1 << 20

#: Fixed value: the pre-token pattern of the vocabulary on lower-case printable ASCII.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
#: A stretch between ASCII white space that the library has to split itself.
ODD = re.compile(r"(?<![^ \t-\r])[!-~]*+[^ \t-\r!-~][^ \t-\r]*")
ODD_OR_SPECIAL = re.compile(r"(?<![^ \t-\r])(?:(?!<\|)[!-~])*+(?:<\||[^ \t-\r!-~])[^ \t-\r]*")
UNPLAIN = re.compile(r"[^ \t-\r!-~]")
SPACE = re.compile(r"[ \t-\r]")
#: A pre-token of :data:`PLAIN`, whole.
SPELLED = re.compile(r"(?!.*<\|)(?:'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[!-/:-@\[-`{-~]+)")


class Lengths(dict):
    """Tokens of each pre-token: the frequent ones, then the cache, then the library."""

    def __init__(self, frequent: dict[str, int], encode: Callable[[str], int]):
        super().__init__(frequent)
        self.cache: dict[str, int] = {}
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if (n := self.cache.get(piece)) is None:
            n = self.encode(piece)
            if len(piece) <= KEPT:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = n
        return n


def slabs(text: str) -> Iterator[str]:
    """The text in stretches of about ``SLAB`` characters, cut at white space only."""
    start = 0
    while len(text) - start > SLAB:
        cut = SPACE.search(text, start + SLAB)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def pieces(text: str) -> list[str]:
    """The pre-tokens of a text; odd stretches are one piece each."""
    pattern = ODD_OR_SPECIAL if "<|" in text else ODD if UNPLAIN.search(text) else None
    if pattern is None:
        return PLAIN.findall(text.lower())
    return PLAIN.findall(pattern.sub(" ", text).lower()) + pattern.findall(text)


def tokenizer(definition: str) -> Callable[[str], int]:
    """Number of tokens of a text by the library, nothing added, special strings as is its default."""
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_str(definition)
    encoder.no_truncation()
    encoder.no_padding()
    merge = encoder.model.tokenize

    def count(piece: str) -> int:
        # Bytes of printable ASCII stand for themselves in the model, and a piece of them is one pre-token.
        return len(merge(piece)) if SPELLED.fullmatch(piece) else len(encoder.encode(piece, add_special_tokens=False))

    return count


def count_pieces(rows: Iterator) -> list[tuple[str, int]]:
    """The most frequent pre-tokens of the first rows of a split."""
    counts: Counter[str] = Counter()
    left = CHARS
    for (text,) in islice(rows, ROWS):
        for slab in slabs(text or ""):
            counts.update(p for p in pieces(slab) if len(p) <= PIECE)
            left -= len(slab)
            if left <= 0:
                return counts.most_common(TABLE // 4)
    return counts.most_common(TABLE // 4)


def frequent_lengths(docs: DataFrame, encode: Callable[[str], int], text_col: str = "text") -> tuple[str, bytes]:
    """The first tier: pre-tokens, each ended by a line feed, and their lengths.

    Only ``SPLITS`` splits of the input are started, evenly spread, and each
    stops after some rows; at most ``SPLITS * TABLE / 4`` counts reach the driver.
    """
    rows = docs.select(F.col(f"`{text_col}`").alias("text")).rdd
    n = rows.getNumPartitions()
    chosen = sorted({i * n // SPLITS for i in range(SPLITS)}) if n else []
    counts: Counter[str] = Counter()
    for piece, count in docs.sparkSession.sparkContext.runJob(rows, count_pieces, chosen) if chosen else []:
        counts[piece] += count
    best = [p for p, c in counts.most_common(TABLE) if c > 1]
    return "".join(f"{p}\n" for p in best), bytes(encode(p) for p in best)


def worker_lengths(key: str, definition: Broadcast, frequent: Broadcast) -> Lengths:
    """The tables of this Python worker, which outlive the task: functions are sent anew with each."""
    kept = sys.modules.setdefault("_token_lengths", types.ModuleType("_token_lengths")).__dict__
    if kept.get("key") != key:
        names, lengths = frequent.value
        kept["key"], kept["lengths"] = key, Lengths(dict(zip(names.split("\n"), lengths)), tokenizer(definition.value))
    return kept["lengths"]


def with_token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``vocabulary`` is the path of a ``tokenizers`` file with white space as the
    end of each pre-token; the driver reads it and sends it along (a few MB).
    ``keep`` names the columns to carry along; all by default.
    """
    with open(vocabulary, encoding="utf-8") as file:
        definition = file.read()
    context = docs.sparkSession.sparkContext
    frequent = frequent_lengths(docs, tokenizer(definition), text_col)
    sent = context.broadcast(definition), context.broadcast(frequent)
    key = f"{context.applicationId} {sent[0]._jbroadcast.id()} {sent[1]._jbroadcast.id()}"

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = worker_lengths(key, *sent)
        for texts in batches:
            yield pd.Series([sum(map(lengths.__getitem__, (p for s in slabs(t or "") for p in pieces(s)))) for t in texts], dtype="int64")

    made = ("n_bytes", "n_tokens", "over_limit")
    carried = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in made]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    counted = spread(docs).select(*carried, F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
