"""Offline providers, ids and reports."""

import uuid

import pytest
from pyspark.sql import functions as F

from millrace.functions import providers as P
from millrace.operators import questions as Q
from millrace.operators.reports import markdown


def test_uuid5_is_pythons(spark):
    names = ["a_000", "b", "خط", ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").coalesce(1).select(P.uuid5(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_embeddings_have_length_one(spark):
    rows = P.embed(spark.createDataFrame([("one two",), ("",), (None,)], "text string")).collect()
    assert sum(x * x for x in rows[0].embedding) == pytest.approx(1) and set(rows[1].embedding) == set(rows[2].embedding) == {0.0}


def test_markdown(spark):
    assert markdown(spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string").coalesce(1)) == "| n | t |\n| - | - |\n| 1 | a\\|b |\n| 2 |  |\n"
    with pytest.raises(ValueError):
        markdown(spark.range(5), 4)


def test_wrapped_lines_and_headings(spark):
    lines = ["This line is long enough to be wrapped, so", "it goes on here", "• bullet", "and not here", "Dial *123# for the", "code", "Short title", "Next sentence ends.", "one,", "Two"]
    (got,) = spark.createDataFrame([(lines,)], "l array<string>").select(Q.merge_wrapped(F.col("l"))).first()
    assert got == ["This line is long enough to be wrapped, so it goes on here", "• bullet", "and not here", "Dial *123# for the", "code", "Short title", "Next sentence ends.", "one, Two"]
    cases = {"Data offer You can use it abroad": ["Data offer", "You can use it abroad"], "Roaming Plans Enjoy the lowest rates abroad.": ["Roaming Plans", "Enjoy the lowest rates abroad."], "nothing to split": ["nothing to split"]}
    got = {r[0]: r[1] for r in spark.createDataFrame([(c,) for c in cases], "x string").select("x", Q.split_heading(F.col("x"))).collect()}
    assert got == cases


def test_twins(spark):
    pdfs = spark.createDataFrame([("en", "a", "abcdef"), ("en", "b", "abcdef"), ("en", "c", "x"), ("ar", "b", "zzzz")], "folder string, stem string, text string")
    pages = spark.createDataFrame([("en", "a", "abcdeg"), ("en", "b", "zzzz"), ("ar", "a", "q")], "folder string, stem string, text string")
    assert {r.folder + r.stem: r.status for r in Q.twin_check(pdfs, pages).collect()} == {"ena": "ok", "enb": "rejected", "enc": "ok", "arb": "ok"}


def test_requests_and_ask(spark):
    schema = "query_id int, question string, language string, top_k int, mode string, embedding_backend string"
    asked = Q.requests(spark.createDataFrame([(1, " How do I pay? ", "", 0, "", None), (2, " ", None, None, None, None), (3, "aaaa", "en", 3, "vector", "local"), (4, "shu ba3mal", None, None, None, None), (5, "Pay?", "en", 1, None, "hosted")], schema))
    verdicts = P.default_verdict(spark.createDataFrame([(1,), (4,)], "query_id int"))
    ranked = spark.createDataFrame([(1, 1, "b", 0.7), (1, 2, "a", 0.6), (4, 1, "c", 0.06), (5, 1, "d", 0.2)], "query_id int, rank int, source string, similarity double")
    got = {r.query_id: r for r in Q.ask(asked, verdicts, ranked).collect()}
    assert [(got[k].action, got[k].status, got[k].language, got[k].model) for k in range(1, 6)] == [("answer_normally", 200, "en", "small"), ("invalid", 400, "en", None), ("too_vague", 200, "en", None), ("answer_normally", 200, "ar", "main"), ("no_info", 200, "en", None)]
    assert got[1].sources == ["a", "b"] and got[5].sources is None


def test_embeddings_are_put_in_order_and_checked(spark):
    rows = spark.createDataFrame([(k, "x" * k if k % 5 else None) for k in range(70)], "id int, text string")
    got = {r.id: r.embedding for r in P.embedded(rows, lambda texts: [(k, [float(len(t)), float(len(texts))]) for k, t in reversed(list(enumerate(texts)))], 2).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: float(k if k % 5 else 0) for k in range(70)} and max(v[1] for v in got.values()) <= 32
    for bad in (lambda texts: [], lambda texts: [(0, [1.0])] * len(texts)):
        with pytest.raises(Exception, match="one vector of 2 numbers"):
            P.embedded(rows, bad, 2).collect()


def test_calls_are_tried_again():
    waited, errors = [], ["Please try again in 1m2.5s", "try again in 250ms", "busy"]

    def call():
        if errors:
            raise RuntimeError(errors.pop(0))
        return "done"

    assert P.retried(call, wait=waited.append) == "done" and waited == [63.0, 0.75, 6.0]
    with pytest.raises(ZeroDivisionError):
        P.retried(lambda: 1 / 0, attempts=2, wait=waited.append)


def test_display_score_and_defaults(spark):
    rows = spark.createDataFrame([(0.1, None, None), (0.1, 0.2, None), (0.1, 0.2, 0.3)], "score double, rrf_score double, rerank_score double").coalesce(1)
    assert [r[0] for r in rows.select(P.display_score(rows)).collect()] == [0.1, 0.2, 0.3] and [r[0] for r in rows.select("score").select(P.display_score(rows.select("score"))).collect()] == [0.1] * 3
    asked = spark.createDataFrame([("shu",)], "question string")
    assert P.transliterated(asked).first().asDict() == {"question": "shu", "arabic": "shu", "english": "shu"} and set(P.unjudged(asked).first()[1:]) == {None}
