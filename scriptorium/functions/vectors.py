"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import words


def inner_product(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(inner_product(vector, vector))


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    length = norm(vector)
    return F.transform(vector, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))


def hashed_bag(docs: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """Deterministic stand-in for a text model: ``id, bucket, weight``.

    Words are hashed into ``dims`` buckets and counted; weights have unit
    length for each row.  Buckets come from md5, so any engine agrees.  The
    counts are the distances between the first places of the buckets in their
    sorted array, all within the row: no shuffle, but each row is its own text.
    """
    bucket = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long"), F.lit(dims))
    rows = docs.select(id_col, F.sort_array(F.transform(words(F.lower(text_col)), bucket)).alias("all"))
    rows = rows.select(id_col, "all", F.array_distinct("all").alias("held"))
    rows = rows.select(id_col, "held", F.size("all").alias("n"), F.transform("held", lambda b: F.array_position("all", b)).alias("first"))
    count = F.transform("first", lambda at, i: F.coalesce(F.get("first", i + 1), F.col("n") + 1) - at)
    rows = rows.select(id_col, "held", count.alias("counts"))
    length = F.sqrt(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n * n).cast("double"))
    weights = F.zip_with("held", "counts", lambda b, n: F.struct(b.alias("bucket"), n.alias("n")))
    return rows.select(id_col, length.alias("length"), F.inline(weights)).select(id_col, "bucket", (F.col("n") / F.col("length")).alias("weight"))
