"""Excerpts under a character budget, and summary pages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import default_if_blank, object_with_keys, quoted_title, without_rules
from ..schemas import SUMMARY_KEYS
from .chunking import NO_HEADING

# The budget, the mark of a cut, and how a failed page reads.
BUDGET, CUT_MARK, PARSE_ERROR = 6000, " [...]", "[PARSE_ERROR]"
# Fixed value: the headings of a page, one for each key in order.
HEADINGS = {"tldr": "TL;DR", "problem": "Problem", "method": "Method", "results": "Results", "limitations": "Limitations"}


def budgeted_blocks(sections: DataFrame, id_col: str, order: str, block: Column, spent: Column, budget: int = BUDGET) -> DataFrame:
    """Blocks of each id in order until the budget is used up.

    ``spent`` is what stands before the first block.  The block that does not
    fit is cut to what is left, marked, and ends the excerpt; an exact fit ends
    it unmarked.  A negative rest counts as nothing.
    """
    before = W.partitionBy(id_col).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = sections.withColumn("_block", block).withColumn("_left", F.lit(budget) - spent)
    rows = rows.withColumn("_left", F.greatest(F.col("_left") - F.coalesce(F.sum(F.length("_block")).over(before), F.lit(0)), F.lit(0)))
    rows = rows.where((F.col("_left") > 0) | (F.col(order) == 0))
    cut = F.concat(F.left("_block", F.col("_left").cast("int")), F.lit(CUT_MARK))
    return rows.withColumn("piece", F.when(F.length("_block") > F.col("_left"), cut).otherwise(F.col("_block"))).drop("_block", "_left")


def section_block(head: Column, text: Column) -> Column:
    name = F.when(head == NO_HEADING, "SECTION").otherwise(head)
    return F.concat(F.lit("\n"), name, F.lit(":\n"), text)


def excerpts(sections: DataFrame, titles: DataFrame, id_col: str = "arxiv_id") -> DataFrame:
    """``id, excerpt`` from section rows (``sec_idx, head, text``) and titles
    (``title, abstract``)."""
    head = F.concat(F.lit("TITLE: "), F.col("title"))
    abstract = F.when(F.col("abstract") != "", F.concat(F.lit("ABSTRACT: "), F.col("abstract")))
    titles = titles.select(id_col, F.array_join(F.array_compact(F.array(head, abstract)), "\n").alias("top"), (F.length(head) + F.coalesce(F.length(abstract), F.lit(0))).alias("spent"))
    blocks = budgeted_blocks(sections.join(titles.select(id_col, "spent"), id_col), id_col, "sec_idx", section_block(F.col("head"), F.col("text")), F.col("spent"))
    body = blocks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("sec_idx", "piece"))).alias("pieces"))
    joined = titles.join(body, id_col, "left")
    parts = F.concat(F.array("top"), F.coalesce(F.transform("pieces", lambda p: p["piece"]), F.array().cast("array<string>")))
    return joined.select(id_col, F.array_join(parts, "\n").alias("excerpt"))


def render_page(arxiv_id: Column, title: Column, model: Column, timestamp: Column, status: Column, fields: dict[str, Column]) -> Column:
    """The Markdown page with its header."""
    header = [("arxiv_id", arxiv_id), ("title", quoted_title(title)), ("generated_by", model), ("generated_at", timestamp), ("status", status)]
    lines: list[Column] = [F.lit("---\n")]
    for name, value in header:
        lines += [F.lit(f"{name}: "), value, F.lit("\n")]
    lines += [F.lit("---\n\n# "), title, F.lit("\n")]
    for key in SUMMARY_KEYS:
        lines += [F.lit(f"\n## {HEADINGS[key]}\n"), without_rules(fields[key]), F.lit("\n")]
    return F.concat(*lines)


def summary_fields(raw: Column) -> dict[str, Column]:
    """Fields of the model's JSON: null if it is no object with all keys; a
    JSON null reads ``None`` and blanks read ``Unknown``."""
    parsed = object_with_keys(raw, SUMMARY_KEYS)
    return {k: F.when(parsed.isNotNull(), default_if_blank(F.coalesce(parsed[k], F.lit("None")))) for k in SUMMARY_KEYS}


def generate(prompts: DataFrame, build: Callable, system: str, prompt_col: str = "prompt", out_col: str = "raw", **options) -> DataFrame:
    """Adds the generator's answers; the generator is built once a task.

    For a server that answers one request at a time, ``coalesce`` first.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generator = build()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else generator.generate(system, t, **options))

    return prompts.withColumn(out_col, run.asNondeterministic()(prompt_col))


def generate_timed(prompts: DataFrame, build: Callable, system: str, prompt_col: str = "prompt", out_col: str = "said", **options) -> DataFrame:
    """The same with a struct of the ``text`` and the milliseconds (``ms``) that it took."""

    @F.pandas_udf("struct<text:string,ms:int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        generator = build()
        for texts in batches:
            rows = []
            for t in texts:
                began = time.perf_counter()
                said = None if t is None else generator.generate(system, t, **options)
                rows.append((said, round(1000 * (time.perf_counter() - began))))
            yield pd.DataFrame(rows, columns=["text", "ms"])

    return prompts.withColumn(out_col, run.asNondeterministic()(prompt_col))


def summarize(papers: DataFrame, build: Callable, system: str, model_name: str = "unknown", timestamp: Column | None = None) -> DataFrame:
    """``arxiv_id, markdown, status, raw_output`` for parsed papers.

    A paper with neither sections nor an abstract is ``empty_tei``.  Others are
    asked for JSON; a bad answer is asked for once more at temperature 0, and
    is a ``parse_error`` with the answer cut at 500 if that fails too.
    """
    from .parsing import section_rows

    stamp = timestamp if timestamp is not None else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    empty = (F.size("sections") == 0) & (F.col("abstract") == "")
    body = papers.join(excerpts(section_rows(papers), papers), "arxiv_id").withColumn("prompt", F.when(~empty, F.concat(F.col("excerpt"), F.lit("\n\nReturn the JSON object."))))
    ask = {"max_tokens": 1024, "response_format": "json", "num_ctx": 8192}
    once = generate(body, build, system, "prompt", "raw", temperature=0.2, **ask)
    bad = ~empty & object_with_keys(F.col("raw"), SUMMARY_KEYS).isNull()
    again = once.withColumn("retry", F.when(bad, F.concat("prompt", F.lit("\n\nAnswer with one valid JSON object that has the keys " + ", ".join(SUMMARY_KEYS) + " and nothing else."))))
    both = generate(again, build, system, "retry", "raw2", temperature=0.0, **ask).withColumn("raw", F.coalesce("raw2", "raw"))
    parsed = object_with_keys(F.col("raw"), SUMMARY_KEYS).isNotNull()
    status = F.when(empty, "empty_tei").when(parsed, "ok").otherwise("parse_error")
    both = both.withColumn("status", status)
    got = summary_fields(F.col("raw"))
    fields = {k: F.when(F.col("status") == "ok", got[k]).when(F.col("status") == "empty_tei", "Unknown").otherwise(PARSE_ERROR) for k in SUMMARY_KEYS}
    page = render_page(F.col("arxiv_id"), F.col("title"), F.lit(model_name), stamp, F.col("status"), fields)
    return both.select("arxiv_id", page.alias("markdown"), "status", F.when(F.col("status") == "parse_error", F.left("raw", F.lit(500))).alias("raw_output"))
