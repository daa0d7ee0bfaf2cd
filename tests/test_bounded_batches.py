"""Python works on a part of a batch at a time, and rows of the same id are texts of their own."""

from compare import same
from pyspark.sql import functions as F

from scriptorium.functions import plugins
from scriptorium.operators import parsing
from scriptorium.queries import QUERIES
from scriptorium.sql import ORACLE_SQL


def test_parts_of_a_batch():
    texts = ["ab", None, "c" * 9, "", "d", "ee"]
    parts = list(plugins.in_parts(texts, 3))
    assert parts == [["ab", "", "c" * 9], ["", "d", "ee"]]
    assert list(plugins.in_parts([])) == []


def test_windows_of_rows_with_the_same_id(spark, tmp_path):
    words = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(2)]
    rows = [(1, words[0]), (1, words[1]), (1, words[1]), (2, None), (3, " \n "), (4, " one two ")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["offset_windows"](spark, str(tmp_path))
    same(out, ORACLE_SQL["offset_windows"], str(tmp_path), ["documents"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_batches_are_worked_on_in_parts(spark):
    """Texts of more than a part's characters in one batch, against one text at a time."""
    texts = [None, "", "<broken"] + [f"<a>{'word ' * 30000}</a>"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "arxiv_id long, tei string").coalesce(1)
    got = {r.arxiv_id: r for r in parsing.parsed_papers(docs).collect()}
    assert [bool(got[i].error) for i in range(4)] == [True, True, True, False] and len(got) == len(texts)
    n = docs.select("arxiv_id", F.size(plugins.offsets()(F.col("tei"))).alias("n")).collect()
    assert [r.n for r in sorted(n)] == [len((t or "").split()) for t in texts]
