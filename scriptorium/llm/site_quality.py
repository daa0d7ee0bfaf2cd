"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model on surface features gives each document a probability of
being good.  Its sums by host and by path are grouped aggregates over all
documents.  A host's posterior is its mean shrunk towards the global mean, a
path's is its mean shrunk towards its host's; the strengths are moment
estimates from the spread between sites, so that sparse sites lean on what is
above them.  The score adds the path's log odds, relative to the global ones,
to the document's.  The document's own part is taken out of the sums of its
host and of its path before, so that no evidence counts twice.

Scale: texts are read once and only ids, sites and probabilities are shuffled.
Sums are partial before the shuffle.  Joining them back, the paths with a
thousandth of all rows or more (a thousand at most) are broadcast, and the
others are joined by key, so no key is hot.

The model is fitted on at most ``max_examples`` labelled rows (the smallest
hashes of their ids).

Defined results: null and empty texts have zero features; a null host or path
is a site of its own; null labels are ignored, repeated labels of an id count
once (the largest); without labels of both kinds every document scores the
share of good labels (1 if there are none); repeated rows give repeated
results, and rows of equal features on one path have equal scores; ids whose
hashes tie are ordered by the id where the sample is drawn; texts of any length are read whole; other columns of the tables are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize

FEATURES = ("upper", "symbols", "bars", "marks", "digits", "stops", "word_length", "distinct", "repeated_lines", "size")
_BLANK = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))


def features(text: bytes | None) -> list[float]:
    """Shares by word or by letter of a whole text."""
    text = text or b""
    words = text.translate(_BLANK).split()
    n, size = max(1, len(words)), max(1, len(text))
    count = lambda chars: size_of - len(text.translate(None, chars)) if (size_of := len(text)) else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = sum(map(len, words))
    return [
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size,
        count(b"#*$%&<>") / n,
        count(b"|") / n,
        count(b"!?") / n,
        count(b"0123456789") / size,
        count(b".,;:") / n,
        letters / n / 10,
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words)) / 10,
    ]


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.column_stack((np.ones(len(x)), np.clip((x - self.mean) / self.scale, -6, 6)))
        w = np.zeros(z.shape[1])
        keep = np.full(len(w), ridge)
        keep[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(z @ w)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        self.weights = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack((np.ones(len(x)), np.clip((x - self.mean) / self.scale, -6, 6)))
        return 1 / (1 + np.exp(-(z @ self.weights)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["y"], pa.array([features(t) for t in batch["text"].to_pylist()], pa.list_(pa.float64()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_examples: int = 10_000) -> Logistic | float:
    """A model, or a constant where the labels are of one kind."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_examples)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "id")
    rows = sample.mapInArrow(_featured, "y int, x array<double>").orderBy("y", "x").toArrow()
    if not len(rows):
        return 1.0
    y = rows["y"].to_numpy().astype(np.float64)
    if y.min() == y.max():
        return float(y[0])
    return Logistic(np.array(rows["x"].to_pylist()), y)


def document_scores(docs: DataFrame, model: Logistic | float, sites: Sequence[Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, host, path, doc_score`` for every document."""
    rows = docs.select(F.col(id_col).alias("id"), *[F.coalesce(c.cast("string"), F.lit("\x00")).alias(n) for c, n in zip(sites, ("host", "path"), strict=True)], F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([rows.schema[c] for c in ("id", "host", "path")] + [T.StructField("doc_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                p = np.full(len(batch), model)
            else:
                p = model(np.array([features(t) for t in batch["text"].to_pylist()]).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["host"], batch["path"], pa.array(np.round(p, 9))], ["id", "host", "path", "doc_score"])

    return rows.mapInArrow(run, schema)


def strength(sites: DataFrame, mean: float) -> float:
    """Prior rows of a site, by moments: m(1-m)/variance between sites - 1."""
    row = sites.where("n > 1").agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) * (F.col("s") / F.col("n") - mean)).alias("v"), F.sum("n").alias("n"), F.sum(F.col("q") / F.col("n")).alias("within")).first()
    if not row["n"]:
        return 20.0
    between = row["v"] / row["n"] - row["within"] / row["n"]
    return float(min(1000.0, max(2.0, mean * (1 - mean) / between - 1))) if between > 1e-9 else 1000.0


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def combine(scored: DataFrame, weight: float = 0.5, hot_share: int = 1000) -> DataFrame:
    """Add ``host_posterior, path_posterior, score``, the posteriors without the row itself."""
    p = F.col("doc_score").cast("decimal(20,9)")  # exact sums, in any order
    sums = [F.count("*").alias("n"), F.sum(p).cast("double").alias("s"), F.sum((p * (1 - p)).cast("decimal(20,9)")).cast("double").alias("q")]
    paths = materialize(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    n_all = total["n"] or 0
    mean = (total["s"] + 0.5) / (n_all + 1) if n_all else 0.5
    by_host, by_path = strength(hosts, mean), strength(paths, mean)
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    stats = paths.select("host", "path", "n", "s").join(hosts, "host")
    hot = F.col("n") * hot_share >= n_all
    few = stats.where(hot).select("host", "path", F.struct("n", "s", "host_n", "host_s").alias("few"))
    rest = stats.where(~hot).select("host", "path", F.struct("n", "s", "host_n", "host_s").alias("rest"))
    out = scored.join(F.broadcast(few), ["host", "path"], "left")
    # Rows that have their sums already go to partitions by their own id.
    key = F.when(F.col("few").isNull(), F.xxhash64("host", "path")).otherwise(F.xxhash64("id", "doc_score"))
    rest = rest.withColumnRenamed("host", "h2").withColumnRenamed("path", "p2").withColumn("k2", F.xxhash64("h2", "p2"))
    out = out.withColumn("key", key)
    out = out.join(rest, (F.col("key") == F.col("k2")) & F.col("few").isNull(), "left").where(F.col("few").isNotNull() | ((F.col("h2") == F.col("host")) & (F.col("p2") == F.col("path"))))
    site = F.coalesce("few", "rest")
    above = (site["host_s"] - F.col("doc_score") + by_host * mean) / (site["host_n"] - 1 + by_host)
    own = (site["s"] - F.col("doc_score") + by_path * above) / (site["n"] - 1 + by_path)
    out = out.select("id", "doc_score", above.alias("host_posterior"), own.alias("path_posterior"))
    odds = logit(F.col("doc_score")) + weight * (logit(F.col("path_posterior")) - logit(F.lit(mean)))
    return out.withColumn("score", 1 / (1 + F.exp(-odds)))


def quality(docs: DataFrame, labels: DataFrame, sites: Sequence[Column], threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, doc_score, host_posterior, path_posterior, score, kept``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    scored = materialize(document_scores(docs, model, sites, id_col, text_col), "doc-scores")
    out = combine(scored).withColumnRenamed("id", id_col)
    return out.withColumn("kept", F.col("score") >= threshold)
