"""Question answering evaluation from questions to run summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.evaluation import evidence_sentences, gold_answers, max_token_f1, recall_at_k
from ..functions.text import numbered_context
from ..operators.incremental import pending
from ..operators.retrieval import global_top_k, scoped_top_k
from ..operators.summaries import generate_timed
from ..schemas import EVALUATION_ROW

#: Defaults of the wording; both are parameters of :func:`evaluate`.
SYSTEM = "You read excerpts of research papers. Reply with the shortest statement that the excerpts support; reply Unanswerable where they support none."
PROMPT = ("Excerpts, by number:\n", "\n\nWhat is asked: ", "\nReply:")


def with_gold(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", "paper_id", "question", gold_answers(F.col("answers")).alias("gold_answers"), evidence_sentences(F.col("answers")).alias("gold_evidence"))


def retrieve(questions: DataFrame, index: DataFrame, k: int = 5, scoped: bool = True) -> DataFrame:
    """Questions (``question_id, paper_id, q``) with their k nearest chunks as
    ``hits``, ordered; questions without chunks keep an empty array.

    The chunks are those of the question's paper, or all of them if not ``scoped``.
    """
    chunks = index.select(F.col("arxiv_id").alias("paper_id"), "chunk_id", "chunk_idx", "text", F.col("embedding").alias("v"))
    if scoped:
        found = scoped_top_k(questions.select("question_id", "paper_id", "q"), chunks, "paper_id", "question_id", "chunk_idx", k)
    else:
        found = global_top_k(questions, chunks, "question_id", "chunk_idx", k).join(chunks.drop("v"), "chunk_idx")
    hits = found.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.col("paper_id").alias("arxiv_id"), "chunk_idx", "text", "score"))).alias("hits"))
    none = F.array().cast(hits.schema["hits"].dataType)
    return questions.join(hits, "question_id", "left").withColumn("hits", F.coalesce("hits", none))


def evaluate(questions: DataFrame, index: DataFrame, build: Callable, k: int = 5, done: DataFrame | None = None, max_answer_tokens: int = 128, scoped: bool = True, system: str = SYSTEM, wording: tuple[str, str, str] = PROMPT) -> DataFrame:
    """Evaluation rows for questions that are not done yet, and whose paper is
    in the corpus if the search is ``scoped``; else ``chunk_idx`` must be unique.

    ``latency_ms.llm`` is the time that the generator took for the question.
    All questions are retrieved in one plan, so ``latency_ms.retrieval``, the
    time of one, does not exist and is null.
    """
    todo = questions if done is None else pending(questions, done, "question_id")
    if scoped:
        todo = todo.join(index.select(F.col("arxiv_id").alias("paper_id")).distinct(), "paper_id", "left_semi")
    rows = retrieve(todo, index, k, scoped)
    texts = F.transform("hits", lambda h: h["text"])
    before, between, after = (F.lit(w) for w in wording)
    prompt = F.concat(before, numbered_context(texts), between, F.col("question"), after)
    rows = generate_timed(rows.withColumn("prompt", prompt), build, system, "prompt", "said", max_tokens=max_answer_tokens, temperature=0.0, num_ctx=4096)
    answer = F.trim(F.col("said.text"))
    return rows.select(
        "question_id",
        "paper_id",
        "question",
        "gold_answers",
        "gold_evidence",
        F.transform("hits", lambda h: h["chunk_id"]).alias("retrieved_chunk_ids"),
        F.transform("hits", lambda h: h["arxiv_id"]).alias("retrieved_arxiv_ids"),
        recall_at_k(texts, F.col("gold_evidence")).alias("recall_at_k"),
        answer.alias("predicted_answer"),
        max_token_f1(answer, F.col("gold_answers")).alias("answer_f1"),
        F.struct(F.lit(None).cast("int").alias("retrieval"), F.col("said.ms").alias("llm")).alias("latency_ms"),
    )


def run_summary(rows: DataFrame) -> DataFrame:
    """Counts and means; questions without evidence stay out of the recall."""
    return rows.agg(F.count("*").alias("n_evaluated"), F.count("recall_at_k").alias("n_with_evidence"), F.avg("recall_at_k").alias("mean_recall_at_k"), F.avg("answer_f1").alias("mean_answer_f1"))


def run_report(spark: SparkSession, rows_path: str, n_total: int, n_skipped: int, n_done_before: int, k: int, **provenance: str) -> DataFrame:
    """One row for a run: the summary of all evaluation rows written so far,
    those of earlier runs included, with counts and where it all came from."""
    rows = spark.read.schema(EVALUATION_ROW).json(rows_path)
    counts = {"n_total_questions": n_total, "n_skipped_no_corpus_this_run": n_skipped, "n_done_before_this_run": n_done_before, "k": k}
    return run_summary(rows).select(*[F.lit(v).cast("string").alias(c) for c, v in provenance.items()], *[F.lit(v).cast("long").alias(c) for c, v in counts.items()], "*")
