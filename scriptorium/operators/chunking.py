"""Overlapping token windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip, words

# What stands for a missing title or heading.
NO_TITLE, NO_HEADING = "[unknown title]", "[untitled]"


def check_window(size: int, overlap: int) -> None:
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("overlap must be at least 0 and smaller than the window")


def window_starts(n_tokens: Column, size: int, overlap: int) -> Column:
    """Starts of the windows; the last window is the first to reach the end."""
    check_window(size, overlap)
    stride = size - overlap
    more = F.greatest(F.ceil((n_tokens - size) / stride), F.lit(0)).cast("int")
    return F.when(n_tokens > 0, F.transform(F.sequence(F.lit(0), more), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))


def chunk_words(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 64, keep: Sequence[str] = ()) -> DataFrame:
    """``id, chunk_idx, text, token_count`` with words as tokens, and the
    columns named in ``keep``; no shuffle."""
    tokens = docs.select(id_col, *keep, words(F.col(text_col)).alias("w"))
    starts = tokens.select(id_col, *keep, "w", F.posexplode(window_starts(F.size("w"), size, overlap)).alias("chunk_idx", "at"))
    piece = F.slice("w", F.col("at") + 1, size)
    return starts.select(id_col, *keep, "chunk_idx", F.array_join(piece, " ").alias("text"), F.size(piece).alias("token_count"))


def chunk_offsets(docs: DataFrame, id_col: str, text_col: str, offsets: Column, size: int = 512, overlap: int = 64) -> DataFrame:
    """The same with tokens at given character offsets (``array<struct<s,e>>``).

    The text of a window is the original from its first to its last token,
    stripped; blank windows are dropped and do not use up an index.  Each row is
    a text of its own, rows of the same id too; no shuffle.
    """
    tokens = docs.select(id_col, F.col(text_col).alias("body"), offsets.alias("o"))
    last = lambda at: F.least(at + size, F.size("o"))
    border = lambda at: F.struct(F.get("o", at)["s"].alias("s"), F.get("o", last(at) - 1)["e"].alias("e"), (last(at) - at).alias("n"))
    return chunk_spans(tokens, id_col, "body", F.transform(window_starts(F.size("o"), size, overlap), border))


def chunk_spans(docs: DataFrame, id_col: str, text_col: str, windows: Column, keep: Sequence[str] = ()) -> DataFrame:
    """``id, chunk_idx, text, token_count`` for windows given by their borders
    (``array<struct<s,e,n>>``), and the columns named in ``keep``.

    The text is the original between the borders, stripped; blank windows are
    dropped and do not use up an index.  All of it happens within the row: no shuffle.
    """
    rows = docs.select(id_col, *keep, F.col(text_col).alias("body"), windows.alias("w"))
    piece = lambda w: F.struct(strip(F.substring("body", w["s"] + 1, w["e"] - w["s"])).alias("text"), w["n"].alias("token_count"))
    pieces = F.filter(F.transform("w", piece), lambda p: p["text"] != "")
    return rows.select(id_col, *keep, F.posexplode(pieces).alias("chunk_idx", "piece")).select(id_col, *keep, "chunk_idx", "piece.text", "piece.token_count")


def full_text(title: Column, abstract: Column, sections: Column) -> Column:
    """Title, abstract and sections with blank lines between; placeholders left out."""
    bodies = F.transform(sections, lambda s: F.when(s["head"].isin("", NO_HEADING), s["text"]).otherwise(F.concat(s["head"], F.lit("\n"), s["text"])))
    head = F.array(F.when(~title.isin("", NO_TITLE), title), F.when(~is_blank(abstract), abstract))
    return F.array_join(F.array_compact(F.concat(head, bodies)), "\n\n")


def index_rows(chunks: DataFrame, id_col: str) -> DataFrame:
    """Adds the composite key ``<id>::<chunk_idx>``."""
    return chunks.select(F.concat_ws("::", F.col(id_col).cast("string"), F.col("chunk_idx").cast("string")).alias("chunk_id"), *chunks.columns)
