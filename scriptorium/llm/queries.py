"""The queries ``opN_<name>`` over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cascade, centroids, licenses, line_dedup, mixing, ngram_join, periodic_runs, secrets_scan, site_quality, token_counts, toxicity, warc, wu_manber
from .shared import held_out, read_table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources; a path is the language section of a source."""
    return site_quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), (F.col("source"), F.col("lang")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the removed lines, from 0, are joined by commas."""
    out = line_dedup.dedup_report(read_table(spark, sf_dir, "documents"))
    return out.withColumn("removed_lines", F.array_join(F.col("removed_lines").cast("array<string>"), ","))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wu_manber.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 10, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    forest = secrets_scan.fit(secrets_scan.planted_findings(secrets_scan.corpus_contexts(docs)))
    return secrets_scan.scan(docs, forest, keep=["doc_id"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.quality(read_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("copies")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "neighbours")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("template_spans")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(read_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.with_token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048, keep=["doc_id"])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_periods(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs, least=24, repeats=3, keep=["doc_id"])
    best = periodic_runs.strongest(F.col("runs"))
    found = found.withColumn("best", best)
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[f].cast("string") for f in ("start", "length", "period")]))
    report = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    exponent = F.call_function("div", 1000 * F.col("best.length"), F.col("best.period"))
    digests = [F.sha2(report, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), *digests)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_quality_classifier, op3_line_dedup, op4_decontamination, op5_secret_scan, op6_quality_rules, op7_source_mixing, op8_toxicity, op9_license_scan, op10_ngram_join, op11_token_counts, op12_periodic_runs, op13_centroid_clustering)}
