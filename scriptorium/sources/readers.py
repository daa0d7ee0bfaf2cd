"""Readers for the file formats of the pipeline."""

from __future__ import annotations

import json
import os
import tarfile
from collections.abc import Mapping, MutableMapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import schemas

#: Fixed value: how a PDF begins.
PDF_MAGIC = b"%PDF"


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """``arxiv_id, content, is_pdf`` for every ``*.pdf``."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return rows.select(stem(F.col("path")).alias("arxiv_id"), "content", F.startswith("content", F.lit(PDF_MAGIC)).alias("is_pdf"))


def existing_ids(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Ids of the files there; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(stem(F.col("path")).alias("arxiv_id"))


def read_tei(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """``arxiv_id, tei`` for every ``*.xml``; ``first`` keeps the lowest ids."""
    rows = spark.read.option("pathGlobFilter", "*.xml").text(path, wholetext=True)
    rows = rows.select(stem(F.input_file_name()).alias("arxiv_id"), F.col("value").alias("tei"))
    return rows if first is None else rows.orderBy("arxiv_id").limit(first)


def read_json_value(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files parsed with a given schema as ``value``.

    Objects whose keys are data are read as maps; inference would make one
    column for each key.
    """
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("value"))


def read_json_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``pos, id, entry`` of JSON objects keyed by id; empty if there is no file."""
    try:
        rows = read_json_value(spark, path, schema)
    except AnalysisException:
        rows = spark.createDataFrame([], f"value {schema}")
    return rows.select(F.posexplode("value").alias("pos", "id", "entry"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``paper_id, question_id, question, answers``, one row for each question."""
    return questions_of(read_json_value(spark, path, schemas.QUESTION_SET))


def questions_of(papers: DataFrame) -> DataFrame:
    qas = papers.select(F.explode("value").alias("paper_id", "paper")).select("paper_id", F.explode(F.coalesce("paper.qas", F.array())).alias("qa"))
    return qas.select("paper_id", "qa.question_id", "qa.question", F.coalesce("qa.answers", F.array()).alias("answers"))


def read_ids(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``id, pos``: keys of several splits, each once at its first place."""
    rows = None
    for k, path in enumerate(paths):
        keys = read_json_value(spark, path, "map<string,string>").select(F.posexplode(F.map_keys("value")).alias("at", "id"))
        keys = keys.select("id", (F.lit(k << 40) + F.col("at")).alias("pos"))
        rows = keys if rows is None else rows.unionByName(keys)
    return rows.groupBy("id").agg(F.min("pos").alias("pos"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped.  Strict reading fails on a bad
    line, tolerant reading drops it."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def completed_ids(manifest: DataFrame) -> DataFrame:
    return manifest.where("entry.done").select("id")


def extract_json_members(archive: str, out: str, suffixes: Mapping[str, str]) -> dict[str, int]:
    """Write the members of a ``.tar.gz`` that end in the given suffixes as
    ``<name>.json``; JSON lines become an array.  Returns entries by name.

    Runs on one machine, for a single small archive; ``archives`` reads any number in place.
    """
    counts: dict[str, int] = {}
    os.makedirs(out, exist_ok=True)
    with tarfile.open(archive) as tar:
        for member in tar:
            name = next((n for n, s in suffixes.items() if member.name.endswith(s)), None)
            if name is None or not member.isfile():
                continue
            text = tar.extractfile(member).read().decode()
            value = [json.loads(x) for x in text.splitlines() if x.strip()] if member.name.endswith(".jsonl") else json.loads(text)
            with open(os.path.join(out, f"{name}.json"), "w") as f:
                json.dump(value, f)
            counts[name] = len(value)
    return counts


def load_env(text: str, env: MutableMapping[str, str]) -> None:
    """``name=value`` lines into ``env``; what is set already stays."""
    for line in text.splitlines():
        name, eq, value = line.strip().partition("=")
        if eq and not name.startswith("#"):
            env.setdefault(name.strip(), value.strip().strip("\"'"))
