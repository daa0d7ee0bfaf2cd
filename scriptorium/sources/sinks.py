"""Writers.  What is added goes through Spark's commit protocol.  What is replaced
as a whole, or has to change together (manifest, graph, index), is a snapshot:
a job that fails leaves the version before it (see ``snapshots``).  Rebuilding
JSON lines, pages and TEI overwrites the folder first and is not atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .snapshots import Snapshots


def mode(rebuild: bool) -> str:
    return "overwrite" if rebuild else "append"


def write_jsonl(rows: DataFrame, path: str, rebuild: bool = False) -> None:
    rows.write.mode(mode(rebuild)).json(path)


def write_index(rows: DataFrame, path: str, rebuild: bool = False) -> None:
    """Chunks with their vectors in one row, so that they cannot come apart."""
    rows = {"index": rows}
    Snapshots(rows["index"].sparkSession, path).publish(**{"replace" if rebuild else "append": rows})


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return Snapshots(spark, path).read("index")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables in one commit: no reader sees the nodes of one graph with the edges of another."""
    Snapshots(nodes.sparkSession, path).publish(replace={"nodes": nodes, "edges": edges})


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one version."""
    graph = Snapshots(spark, path)
    number = graph.version().number
    return graph.read("nodes", number), graph.read("edges", number)


def write_pages(pages: DataFrame, path: str, id_col: str = "arxiv_id", text_col: str = "markdown") -> None:
    """Documents as text under ``<id_col>=<id>/``."""
    pages.select(id_col, F.col(text_col).alias("value")).write.mode("overwrite").partitionBy(id_col).text(path)


def write_tei(papers: DataFrame, path: str, rebuild: bool = False) -> None:
    """TEI documents as text under ``arxiv_id=<id>/``; papers without one are left out."""
    papers.where("tei is not null").select("arxiv_id", F.col("tei").alias("value")).write.mode(mode(rebuild)).partitionBy("arxiv_id").text(path)


def read_written_tei(spark: SparkSession, path: str) -> DataFrame:
    """``arxiv_id, tei`` of what :func:`write_tei` wrote."""
    rows = spark.read.schema("value string, arxiv_id string").option("wholetext", "true").format("text").load(path)
    return rows.select("arxiv_id", F.regexp_replace("value", "\n$", "").alias("tei"))


def write_manifest(entries: DataFrame, path: str, key: str = "arxiv_id") -> None:
    """A manifest as JSON lines ``{"id": ..., "entry": {...}}``, replaced as a whole
    in one commit: a job that fails leaves the manifest as it was.

    One line for each paper and not one object for all, so that no task holds
    the whole manifest.
    """
    rest = [c for c in entries.columns if c != key]
    rows = entries.select(F.col(key).alias("id"), F.struct(*rest).alias("entry"))
    Snapshots(entries.sparkSession, path, "json").publish(replace={"manifest": rows})


def read_manifest(spark: SparkSession, path: str, entry_schema: str, key: str = "arxiv_id") -> DataFrame:
    manifest = Snapshots(spark, path, "json")
    folders = manifest.version().folders.get("manifest", [])
    rows = spark.read.schema(f"id string, entry {entry_schema}").json([f"{manifest.root}/{f}" for f in folders])
    return rows.select(F.col("id").alias(key), "entry.*")


def write_summary(one_row: DataFrame, path: str) -> None:
    one_row.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def init_cache(spark: SparkSession, table: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schemas.RESPONSE_CACHE}) USING parquet")


def put_cache(rows: DataFrame, table: str) -> None:
    """Append; the newest row of a key is the one that counts (see ``latest``)."""
    rows.select("paper_id", "response_json", "fetched_at").write.mode("append").insertInto(table)
