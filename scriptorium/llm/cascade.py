"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a named boolean expression that is true for a text that passes, with
the work that it is for a text: the characters that it reads, or nothing to
speak of where it only compares measures.  One pass over a sample of about
``sample_rows`` texts estimates each rule's work and the share of texts that it
rejects; the rules are then put in order of rejection per cost, and a text meets
the rules in that order until one fails.  The order changes the time taken and
never the verdict, which is that all rules pass.

Work is counted and not timed: a rule costs microseconds a text, and times of
a sample differed more from run to run than rules do among each other.

Defined results: a null or empty text has no words and fails the base test;
texts of any length are measured whole; repeated rows give repeated results;
rules of equal rejection per cost are ordered by name; other columns of the
table are ignored, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import GAP, WORD

SYMBOLS = r"[#*$%&|<>]"


def pair_hashes(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def window_hashes(words: Column, n_words: Column) -> Column:
    """A hash of every window of eight words: pairs, then fours, then eights."""
    two = pair_hashes(F.slice(words, 1, n_words - 1), F.slice(words, 2, n_words - 1))
    return F.transform(F.array(two), lambda h2: F.transform(F.array(pair_hashes(F.slice(h2, 1, n_words - 3), F.slice(h2, 3, n_words - 3))), lambda h4: pair_hashes(F.slice(h4, 1, n_words - 7), F.slice(h4, 5, n_words - 7)))[0])[0]


def covered(places: Column, width: int) -> Column:
    """Words under windows of ``width`` that begin at the ascending ``places``."""
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-width).cast("long").alias("last"))
    step = lambda a, p: F.struct((a["sum"] + F.least(p - a["last"], F.lit(width))).cast("long").alias("sum"), p.cast("long").alias("last"))
    return F.aggregate(places, state, step, lambda a: a["sum"])


def repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more.

    The hashes are sorted first; only where two neighbours are equal are the
    places sorted as well.
    """
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    twice = F.transform(F.array(ordered), lambda s: F.filter(s, lambda x, j: (F.get(s, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(x["h"]))))[0]
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(F.array_sort(F.transform(twice, lambda x: x["i"])), 8))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long),
    and the text as ``_text`` for rules that look at it themselves."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = docs.select(*keep, text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    out = out.select(*keep, "_text", "_words", F.size("_words").alias("_n"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    hashes = F.when(F.col("_n") >= 8, window_hashes(F.col("_words"), F.col("_n"))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("_hashes", hashes)
    return out.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        (F.length("_text") - F.regexp_count("_text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        "n_dup_lines",
        repeated_words(F.col("_hashes")).alias("n_repeat_words"),
        "_text",
    )


@dataclass(frozen=True)
class Rule:
    """``passes`` maps the columns of the measures to a boolean column, ``reads``
    to the characters that it has to look at."""

    name: str
    passes: Callable[[], Column]
    reads: Callable[[], Column] = lambda: F.lit(0)


def text_length() -> Column:
    return F.length("_text")


#: Production thresholds: whole numbers only, so that every engine agrees.
RULES = (
    Rule("mean_word_length", lambda: (F.col("word_chars") >= 2 * F.col("n_words")) & (F.col("word_chars") <= 14 * F.col("n_words"))),
    Rule("symbol_share", lambda: 10 * F.col("n_symbols") <= F.col("n_words")),
    Rule("duplicate_lines", lambda: 10 * F.col("n_dup_lines") <= 3 * (F.regexp_count("_text", F.lit(r"\n")) + 1), text_length),
    Rule("exclamations", lambda: 10 * F.regexp_count("_text", F.lit("!")) <= F.col("n_words"), text_length),
    Rule("capitals", lambda: 2 * F.regexp_count("_text", F.lit("[A-Z]")) <= F.col("word_chars"), text_length),
)
#: Characters that take as long to read as it takes to ask a rule at all.
ASKING = 16


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sample_of(docs: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows, drawn alike from all partitions without a shuffle."""
    total = docs.count()
    return docs.sample(False, min(1.0, rows / max(1, total)), seed)


def estimate_order(measured: DataFrame, rules: Sequence[Rule] = RULES) -> list[tuple[Rule, float, float]]:
    """Rules by falling rejection per cost, with both; one aggregation over ``measured``, a sample."""
    sums = [F.count("*").alias("n")]
    for i, rule in enumerate(rules):
        sums += [F.count_if(~rule.passes()).alias(f"rejected{i}"), F.coalesce(F.sum(rule.reads()), F.lit(0)).alias(f"reads{i}")]
    found = measured.agg(*sums).first()
    n = max(1, found["n"])
    estimates = [(rule, found[f"rejected{i}"] / n, ASKING + found[f"reads{i}"] / n) for i, rule in enumerate(rules)]
    return sorted(estimates, key=lambda x: (-x[1] / x[2], x[0].name))


def cascade(order: Sequence[Rule]) -> Column:
    """The first rule that a row fails, null if it passes all; later rules are
    not evaluated once one has failed."""
    out = None
    for rule in order:
        out = F.when(~rule.passes(), F.lit(rule.name)) if out is None else out.when(~rule.passes(), F.lit(rule.name))
    return out if out is not None else F.lit(None).cast("string")


def quality(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES, sample_rows: int = 2000) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for every document.

    Columns in ``keep`` must not have the name of a measure or of ``_text``,
    ``_words``, ``_lines``, ``_n`` or ``_hashes``; a ValueError says so.
    """
    if clash := {*keep} & {*MEASURES, "_text", "_words", "_lines", "_n", "_hashes", "base_failed", "kept"}:
        raise ValueError(f"columns with names of results: {sorted(clash)}")
    order = [r for r, _, _ in estimate_order(measures(sample_of(docs.select(text_col), sample_rows), text_col), rules)]
    out = measures(docs, text_col, keep).withColumn("base_failed", base_failed())
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order).isNull())).drop("_text")
