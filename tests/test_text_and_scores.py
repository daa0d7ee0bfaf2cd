from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import evaluation as ev
from scriptorium.functions import text as tx


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_answer(spark):
    cases = ["The Quick, brown-fox!", "an apple a day", "  A\tthe AN ", "", "Pre-Training isn't", "theory of cats"]
    assert column(spark, cases, tx.normalize_answer) == ["quick brownfox", "apple day", "", "", "pretraining isnt", "theory of cats"]


def test_match_key_keeps_punctuation(spark):
    assert column(spark, ["  A,  b.\n", "\x1c"], tx.match_key) == ["a, b.", ""]


def f1(spark, pairs):
    rows = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(pairs)], "i int, p string, g string")
    return [r.y for r in rows.select("i", ev.token_f1(F.col("p"), F.col("g")).alias("y")).orderBy("i").collect()]


def test_token_f1(spark):
    got = f1(spark, [("dense vectors", "dense vectors"), ("red", "blue"), ("one two", "two three"), ("the model", "a model"), ("", ""), ("", "x"), ("x", "the"), ("b b b", "b b")])
    assert got == [1.0, 0.0, 0.5, 1.0, 1.0, 0.0, 0.0, 0.8]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("xyzw"), max_size=6), st.lists(st.sampled_from("xyzw"), max_size=6)), min_size=1, max_size=6))
def test_f1_is_the_multiset_overlap(spark, pairs):
    texts = [(" ".join(a), " ".join(b)) for a, b in pairs]
    want = [1.0 if not a and not b else 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)) for a, b in pairs]
    got = f1(spark, texts)
    assert all(abs(x - y) < 1e-12 for x, y in zip(got, want, strict=True))
    assert got == f1(spark, [(b, a) for a, b in texts])


def test_max_token_f1(spark):
    rows = spark.createDataFrame([(0, "one two", ["x", "two one"]), (1, "one", [])], "i int, p string, g array<string>")
    assert [r.y for r in rows.select("i", ev.max_token_f1(F.col("p"), F.col("g")).alias("y")).orderBy("i").collect()] == [1.0, 0.0]


def test_recall(spark):
    rows = [(0, ["Some evidence here.", "more"], ["evidence  HERE", "MORE"]), (1, ["a b"], ["b", "c"]), (2, ["a"], []), (3, ["a"], ["  ", ""]), (4, [], ["a"]), (5, ["zz yy"], ["yy", "yy", "q"]), (6, ["a"], None)]
    df = spark.createDataFrame(rows, "i int, t array<string>, e array<string>")
    got = [r.y for r in df.select("i", ev.recall_at_k(F.col("t"), F.col("e")).alias("y")).orderBy("i").collect()]
    assert got == [1.0, 0.5, None, None, 0.0, 2 / 3, None]


def answer(**kw):
    base = {"unanswerable": False, "yes_no": None, "extractive_spans": [], "free_form_answer": "", "evidence": [], "highlighted_evidence": []}
    return {"answer": base | kw}


def test_gold(spark):
    from scriptorium.schemas import ANSWERS

    answers = [
        answer(unanswerable=True, yes_no=True),
        answer(yes_no=True, extractive_spans=["x"]),
        answer(yes_no=False),
        answer(extractive_spans=["two", "spans"], free_form_answer="no"),
        answer(free_form_answer=" kept as is "),
        answer(free_form_answer="   "),
        answer(highlighted_evidence=["First  one.", "b"], evidence=["unused"]),
        answer(evidence=["first ONE.", " ", "paragraph"]),
        answer(evidence=None, highlighted_evidence=None),
    ]
    df = spark.createDataFrame([(answers,)], f"a {ANSWERS}")
    row = df.select(ev.gold_answers(F.col("a")).alias("g"), ev.evidence_sentences(F.col("a")).alias("e")).first()
    assert row.g == ["Unanswerable", "Yes", "No", "two spans", " kept as is "]
    assert row.e == ["First  one.", "b", "paragraph"]


def test_small_helpers(spark):
    assert column(spark, ["a\n---\nb", " --- ", "x--- y"], tx.without_rules) == ["a\nb", "", "x--- y"]
    assert column(spark, ['say "hi"'], tx.quoted_title) == ['"say \\"hi\\""']
    assert column(spark, [" ", None, " v "], tx.default_if_blank) == ["Unknown", "Unknown", "v"]
    assert column(spark, [["p", "q"], []], tx.numbered_context, "array<string>") == ["[1] p\n\n[2] q", ""]
    got = column(spark, ['{"a":1,"b":null}', '{"a":1}', "[1]", "nope"], lambda c: tx.object_with_keys(c, ("a", "b")).isNotNull())
    assert got == [True, False, False, False]
