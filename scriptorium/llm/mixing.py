"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words.  Every document of the source
expects ``target / source words`` copies.  The documents of a source stand in
a fixed order, their expected copies are summed up along it, one random offset
is added, and a document is emitted once per integer boundary that its step
crosses.  Standing them by size class makes the words taken, not only the
documents, come out near the target.

The prefix sum is never made by one task over a source.  The order is (size
class, hash bucket, hash): counts of the first two give the offset of every
bucket, and only the rows of one bucket are numbered together.  The number of
buckets grows with the square root of the rows, so that a source, or even a
single size class, with a third of all rows is spread over many tasks.

Defined results: a null text has no words; a null source is a source of its
own, last in order; sources whose documents have no words take nothing; rows
that are repeated are numbered one after the other; other columns are passed
through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import hex_fraction, materialize, word_count

#: Denominator of the random offset; a power of two keeps the sums exact.
OFFSET_STEPS = 1 << 20


def size_class(size: Column) -> Column:
    """Sixteen classes for each doubling of the size; monotone in the size."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 5, F.lit(0))
    return (shift * 16 + F.call_function("shiftright", size, shift)).cast("long")


def source_targets(per_source: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Add ``target`` to one row per source (``key``, ``source_size``).

    Shares by weight stop at ``cap`` times the size of the source and the
    excess is shared anew by weight: each source takes ``min(cap * size,
    level * weight)``.  With the sources by rising cap for each unit of weight,
    ``level`` is the largest of the levels that result if the first i are
    full.  There is one row for each source here, not for each document.
    """
    by_key, by_ratio = W.orderBy("key"), W.orderBy("ratio", "key")
    rest = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int"))
    out = per_source.withColumn("weight", weight.cast("long")).withColumn("full", F.col("source_size") * cap)
    out = out.withColumn("ratio", F.col("full").cast("double") / F.col("weight").cast("double"))
    out = out.withColumn("free", F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0)))
    out = out.withColumn("level", F.col("free").cast("double") / F.sum("weight").over(rest).cast("double"))
    out = out.withColumn("level", F.max("level").over(W.partitionBy()))
    return out.withColumn("target", F.least(F.col("full").cast("double"), F.col("level") * F.col("weight").cast("double")))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """Decide how often each document is taken.

    Returns ``id, size, source_size, target, copies, taken`` and the columns
    named in ``carry``.
    """
    n_rows = docs.count()
    buckets = 1 << max(4, (max(n_rows, 1).bit_length() + 1) // 2)
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    base = docs.select(F.col(id_col).alias("id"), key.alias("key"), word_count(F.col(text_col)).alias("size"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    base = base.withColumn("hash", hex_fraction(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    base = base.withColumn("cls", size_class(F.col("size"))).withColumn("bucket", F.call_function("shiftright", F.col("hash"), F.lit(33 - buckets.bit_length())))
    base = materialize(base, "mix")

    targets = source_targets(base.groupBy("key").agg(F.sum("size").alias("source_size")), weights, cap)
    targets = targets.select("key", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0).alias("rate"), (hex_fraction(F.concat(F.lit(seed + "@"), F.col("key")), 5).cast("double") / OFFSET_STEPS).alias("offset"))

    cells = base.groupBy("key", "cls", "bucket").agg(F.count("*").alias("n"))
    classes = cells.groupBy("key", "cls").agg(F.sum("n").alias("n"))
    classes = classes.select("key", "cls", F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("cls").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("class_start"))
    starts = cells.withColumn("start", F.coalesce(F.sum("n").over(W.partitionBy("key", "cls").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.join(classes, ["key", "cls"]).select("key", "cls", "bucket", (F.col("start") + F.col("class_start")).alias("start"))

    order = W.partitionBy("key", "cls", "bucket").orderBy("hash", F.col("id").asc_nulls_last(), "size")
    ranked = base.withColumn("at", F.row_number().over(order)).join(starts, ["key", "cls", "bucket"])
    ranked = ranked.join(targets, "key")
    rank = F.col("start") + F.col("at")
    upto = F.floor(F.col("offset") + F.col("rate") * rank.cast("double"))
    from_ = F.floor(F.col("offset") + F.col("rate") * (rank - 1).cast("double"))
    ranked = ranked.withColumn("copies", (upto - from_).cast("long"))
    return ranked.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy that the mix takes, numbered by ``copy_no`` from 1."""
    return mixed.where("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
