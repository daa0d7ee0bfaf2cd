"""Resumption, caches, manifests and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the cached answer for a paper that does not exist.
NOT_FOUND = '{"_s2_not_found": true}'


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet; repeats on the left stay."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def gated(work: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Adds ``in_corpus``, so that kept and skipped rows can be counted in one pass."""
    return work.join(corpus.select(key).distinct().withColumn("in_corpus", F.lit(True)), key, "left").withColumn("in_corpus", F.col("in_corpus").isNotNull())


def latest(rows: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """The newest row of each key, by aggregation: partial maxima are made
    before the shuffle, so a hot key costs one row for each task."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(by, tie)).alias("best"))
    return best.select(key, *[F.col("best")[c].alias(c) for c in rest])


def probe(ids: DataFrame, cache: DataFrame, key: str = "paper_id") -> DataFrame:
    """``status``: ``hit``, ``negative`` (known not to exist) or ``miss``."""
    newest = latest(cache, key, "fetched_at", "response_json")
    status = F.when(F.col("response_json").isNull(), "miss").when(F.col("response_json") == NOT_FOUND, "negative").otherwise("hit")
    return ids.join(newest, key, "left").withColumn("status", status)


def merged_status(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Entries of both sides; where both have a field, the right one wins."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    only = [F.col(f"l.{c}") for c in left.columns if c not in right.columns] + [F.col(f"r.{c}") for c in right.columns if c not in left.columns]
    joined = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full")
    return joined.select(F.coalesce(f"r.{key}", f"l.{key}").alias(key), *[F.coalesce(f"r.{c}", f"l.{c}").alias(c) for c in shared], *only)


def first_positions(ids: DataFrame, key: str, position: str) -> DataFrame:
    """Each id once, with the place at which it first stood."""
    return ids.groupBy(key).agg(F.min(position).alias(position))


def first_seen(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key, whole; by aggregation, not by a window.

    Only a 128-bit digest of the key and the order are shuffled; the chosen
    rows are found again by both.  Of rows that tie in the order the one with
    the smallest hash of its columns (maps left out) stays, however they arrive.
    """
    digest = F.unhex(F.md5(key.cast("string").cast("binary")))
    settled = F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()])
    marked = rows.withColumns({"_key": F.coalesce(digest, F.lit(b"")), "_at": F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], settled.alias("row"))})
    picked = marked.groupBy("_key").agg(F.min("_at").alias("_at"))
    return marked.join(picked, ["_key", "_at"], "left_semi").dropDuplicates(["_key", "_at"]).drop("_key", "_at")


def first_in_order(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in the order of the input, after all joins; each task
    keeps its own n before they meet."""
    if n < 0:
        raise ValueError("n must not be negative")
    return rows.orderBy(*order).limit(n)


def until_successes(attempts: DataFrame, ok: Column, order: list[Column], n: int) -> DataFrame:
    """The attempts made until n have succeeded, the n-th included; all of
    them if there are fewer successes, none if n is 0 or less."""
    if n <= 0:
        return attempts.limit(0)
    at = F.struct(*order)
    successes = attempts.where(ok).select(at.alias("at")).orderBy("at").limit(n)
    last = successes.agg(F.max("at").alias("last"), F.count("*").alias("found"))
    return attempts.join(F.broadcast(last), (F.col("found") < n) | (at <= F.col("last"))).drop("last", "found")  # one row


def pick_papers(papers: DataFrame, key: str, fixed: list[str], group: Column, n: int) -> DataFrame:
    """``key, place``: the fixed ids that exist, in their order, then the first n by id of the group."""
    place = F.array_position(F.array(*[F.lit(k) for k in fixed]), F.col(key)) if fixed else F.lit(0)
    named = papers.where(place > 0).select(key, place.cast("long").alias("place")).distinct()
    rest = papers.where(group).select(key).distinct().orderBy(key).limit(n)
    numbered = rest.select(key, (F.row_number().over(W.orderBy(key)) + len(fixed)).cast("long").alias("place"))  # n rows
    return named.unionByName(numbered)


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, ok: Column) -> DataFrame:
    """Processed rows, good ones (rows skipped as done before count as good),
    and their share in per cent."""
    return rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), (100.0 * F.count_if(ok) / F.greatest(F.count("*"), F.lit(1))).alias("pct"))


def running_mean(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Mean so far within each group, in order."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("running", F.avg(value).over(w))
