"""From TEI documents to index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chunking import chunk_offsets, full_text, index_rows
from ..operators.incremental import pending
from ..operators.parsing import parsed_papers


def build_index(papers: DataFrame, offsets, embed, done: DataFrame | None = None, size: int = 512, overlap: int = 64) -> DataFrame:
    """Index rows of papers that are not in ``done`` (``arxiv_id``) yet.

    ``offsets`` and ``embed`` are column functions (see ``functions.plugins``).
    """
    todo = papers if done is None else pending(papers, done, "arxiv_id")
    text: Column = full_text(F.col("title"), F.col("abstract"), F.col("sections"))
    bodies = parsed_papers(todo).where("error is null").select("arxiv_id", text.alias("body"))
    chunks = chunk_offsets(bodies, "arxiv_id", "body", offsets(F.col("body")), size, overlap)
    return index_rows(chunks, "arxiv_id").withColumn("embedding", embed(F.col("text")))


def index_manifest(papers: DataFrame, index: DataFrame) -> DataFrame:
    """``arxiv_id, num_chunks, done``; papers without chunks are done too."""
    counts = index.groupBy("arxiv_id").agg(F.count("*").cast("int").alias("num_chunks"))
    return papers.select("arxiv_id").distinct().join(counts, "arxiv_id", "left").select("arxiv_id", F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"), F.lit(True).alias("done"))
