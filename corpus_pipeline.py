"""The corpus pipeline: five stages over ``documents``, each written and reread.

``STAGES`` lists (name, function); each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame.  All but the last return the columns of
documents; the last adds the size of the document and the number of the copy.
The first stage cannot be written as SQL (nearest neighbours under a learnt
calibration), so ``ORACLE_SQL`` is None and the stages are tested against
brute force.

Defined results, for every stage: a null text has no words, so it is not
toxic, loses no line, is linked with nothing, is not contaminated, and has
size 0 in the mix, which takes it zero times or more by the rate of its source;
the same holds of a text that came empty.  A text that *becomes* empty, because
all its lines with words were repeats, goes.  Rows with a null id stay.  Rows
repeated whole are scored alike; the mix counts each.  An empty table gives an
empty table.  Further columns pass through untouched, whatever their names:
an operator sees only the id, the text and, for the mix, the source.  Where
lines were removed, ``n_chars`` is the length of the text that is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import line_dedup, mixing, ngram_join, shared, toxicity, wu_manber


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the other columns as one, so that no name clashes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    filler = "_".join(["_", *others]).replace("`", "")  # for a table of two columns; longer than any name, so none of them
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias(filler), *[quoted(c).alias(c) for c in others]).alias("row"))


def unpacked(rows: DataFrame, columns: list[str], *more: str) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c).alias(c) for c in columns], *more)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic.

    The examples are documents of the corpus as it came, before any stage.
    """
    model = toxicity.fit(shared.read_table(spark, sf_dir, "documents"), shared.read_table(spark, sf_dir, "labels"))
    return unpacked(toxicity.score(packed(docs), model).where("predicted = 0"), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line matches, those that become empty left out."""
    had = F.struct(F.length("text").alias("length"), F.col("text").rlike(shared.WORD).alias("words"))
    out = line_dedup.dedup_texts(packed(docs).withColumn("had", had))
    out = out.where(F.col("text").isNull() | ~F.col("had.words") | F.col("text").rlike(shared.WORD))
    if "n_chars" in docs.columns:
        length = F.when(F.col("had.length") != F.length("text"), F.length("text")).otherwise(F.col("row.n_chars"))
        out = out.withColumn("row", F.col("row").withField("n_chars", length.cast(docs.schema["n_chars"].dataType)))
    return unpacked(out, docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return unpacked(ngram_join.keep_one(packed(docs)), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = wu_manber.contamination(packed(docs), shared.read_table(spark, sf_dir, "benchmark"), 10)
    return unpacked(found.where("not contaminated"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix of sources takes, with its ``size`` and ``copy_no``.

    Columns of the table with these two names give way to them.
    """
    rows = packed(docs).withColumn("source", F.col("row.source"))
    mixed = mixing.emit(mixing.mix(rows, carry=["text", "row"]))
    return unpacked(mixed, [c for c in docs.columns if c not in ("size", "copy_no")], "size", "copy_no")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder.

    What a stage leaves behind goes once the next has been written; the table
    of the last stays until the application ends.
    """
    docs, last = shared.read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared.scratch_path(spark, f"pipeline-{name}")
        with shared.scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            shared.delete_path(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
