"""Scores of answers and retrieved evidence, and gold extraction, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import answer_tokens, is_blank, match_key, strip

# The answers that flags stand for.
UNANSWERABLE, YES, NO = "Unanswerable", "Yes", "No"


def multiset_overlap(left: Column, right: Column) -> Column:
    """Sum over distinct tokens of the smaller count.

    Both sides are sorted together once and read as runs of equal tokens, so
    the work is that of one sort.
    """
    tagged = F.array_sort(F.concat(F.transform(left, lambda t: F.struct(t.alias("t"), F.lit(1).alias("l"))), F.transform(right, lambda t: F.struct(t.alias("t"), F.lit(0).alias("l")))))
    state = lambda t, l, r, n: F.struct(t.alias("t"), l.cast("int").alias("l"), r.cast("int").alias("r"), n.cast("int").alias("n"))  # noqa: E731, E741
    start = state(F.lit(None).cast("string"), F.lit(0), F.lit(0), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        same = state(s["t"], s["l"] + x["l"], s["r"] + 1 - x["l"], s["n"])
        return F.when(s["t"] == x["t"], same).otherwise(state(x["t"], x["l"], 1 - x["l"], s["n"] + F.least(s["l"], s["r"])))

    return F.aggregate(tagged, start, step, lambda s: s["n"] + F.least(s["l"], s["r"]))


def f1_of_tokens(left: Column, right: Column) -> Column:
    """Harmonic mean of precision and recall; 1 if both are empty, 0 if one is."""
    same, total = multiset_overlap(left, right), F.size(left) + F.size(right)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * same / total)


def token_f1(prediction: Column, gold: Column) -> Column:
    return f1_of_tokens(answer_tokens(prediction), answer_tokens(gold))


def max_token_f1(prediction: Column, golds: Column) -> Column:
    """Best score over the gold answers; 0 without any."""
    return F.coalesce(F.array_max(F.transform(golds, lambda g: token_f1(prediction, g))), F.lit(0.0))


def recall_at_k(retrieved: Column, evidence: Column) -> Column:
    """Share of non-blank gold sentences that some retrieved text contains.

    Null without such sentences; repeated sentences count each time.
    """
    keys = F.filter(F.transform(F.coalesce(evidence, F.array().cast("array<string>")), match_key), lambda n: n != "")
    texts = F.transform(retrieved, match_key)
    covered = F.size(F.filter(keys, lambda n: F.exists(texts, lambda t: F.contains(t, n))))
    return F.try_divide(covered.cast("double"), F.size(keys).cast("double"))


def gold_answers(answers: Column) -> Column:
    """One answer for each annotation that has any, by fixed priority."""

    def one(annotation: Column) -> Column:
        a = annotation["answer"]
        return (
            F.when(a["unanswerable"], F.lit(UNANSWERABLE))
            .when(a["yes_no"], F.lit(YES))
            .when(~a["yes_no"], F.lit(NO))
            .when(F.size(a["extractive_spans"]) > 0, F.array_join(a["extractive_spans"], " "))
            .when(strip(F.coalesce(a["free_form_answer"], F.lit(""))) != "", a["free_form_answer"])
        )

    return F.array_compact(F.transform(answers, one))


def evidence_sentences(answers: Column) -> Column:
    """Highlighted sentences of each annotation, or else its paragraphs; all
    annotations together, first of equal keys only, blank ones dropped."""
    empty = F.array().cast("array<string>")

    def of(annotation: Column) -> Column:
        a = annotation["answer"]
        return F.when(F.size(a["highlighted_evidence"]) > 0, a["highlighted_evidence"]).otherwise(F.coalesce(a["evidence"], empty))

    sentences = F.filter(F.flatten(F.transform(answers, of)), lambda s: ~is_blank(s))
    keys = F.transform(sentences, match_key)
    return F.filter(sentences, lambda s, i: F.array_position(keys, match_key(s)) == i + 1)
