"""Citation graph: nodes, edges and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arxiv_id(reference: Column) -> Column:
    """The arXiv id of a reference, null wherever the path breaks off."""
    return reference["externalIds"]["ArXiv"]


def reference_rows(records: DataFrame) -> DataFrame:
    """``src, dst`` for every reference with an arXiv id, repeats included."""
    refs = records.select(F.col("arxiv_id").alias("src"), F.explode(F.coalesce(F.col("record")["references"], F.array())).alias("ref"))
    return refs.select("src", arxiv_id(F.col("ref")).alias("dst")).where("dst is not null")


def nodes(corpus: DataFrame, references: DataFrame) -> DataFrame:
    """Corpus and cited papers, each once; ``in_corpus`` if it is in the corpus."""
    both = corpus.select(F.col("id"), F.lit(True).alias("in_corpus")).unionByName(references.select(F.col("dst").alias("id"), F.lit(False).alias("in_corpus")))
    return both.groupBy("id").agg(F.bool_or("in_corpus").alias("in_corpus"))


def edges(references: DataFrame) -> DataFrame:
    return references.select("src", "dst").distinct()


def marked(references: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds ``dst_in_corpus``; the corpus side is distinct, so no row is multiplied."""
    known = corpus.select(F.col("id").alias("dst"), F.lit(True).alias("known")).distinct()
    return references.join(known, "dst", "left").select("src", "dst", F.col("known").isNotNull().alias("dst_in_corpus"))


def out_degrees(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.groupBy("src").agg(F.count("*").alias("out_degree"))


def graph_metrics(corpus: DataFrame, references: DataFrame) -> DataFrame:
    """One row: references, those into the corpus, distinct edges and nodes,
    density m/(n(n-1)) and mean out-degree over citing papers."""
    refs = marked(references, corpus).agg(F.count("*").alias("total_refs"), F.count_if("dst_in_corpus").alias("in_corpus_edges"))
    n = nodes(corpus, references).agg(F.count("*").alias("n_nodes"))
    m = out_degrees(edges(references)).agg(F.coalesce(F.sum("out_degree"), F.lit(0)).alias("n_edges"), F.coalesce(F.avg("out_degree"), F.lit(0.0)).alias("avg_out_degree"))
    one = refs.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").join(m.withColumn("k", F.lit(1)), "k").drop("k")
    size = F.col("n_nodes").cast("double")
    return one.withColumn("density", F.coalesce(F.try_divide(F.col("n_edges").cast("double"), size * (size - 1)), F.lit(0.0)))
