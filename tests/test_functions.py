"""Literal cases of scalar functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import guards as G
from millrace.functions import text as T
from millrace.operators import chunking as C


def values(spark, cases, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(cases, schema).coalesce(1).select(*columns).collect()]


@pytest.mark.parametrize(("text", "want"), [("إأآٱ", "اااا"), ("خدمة", "خدمه"), ("محـــفظة", "محفظه"), ("كِتَابٌ", "كتاب"), ("٠١٢۳۴", "01234"), ("a  b \n\n c\t", "a b\nc"), ("", ""), (None, "")])
def test_normalize_arabic(spark, text, want):
    assert values(spark, [(text,)], "x string", T.normalize_arabic(F.col("x"))) == [(want,)]


def test_white_space_agrees_with_plain_python(spark):
    r = random.Random(5)
    pieces = ["a", "b", " ", "  ", "\t", "\n", "\r", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "ة", "ً", "*1#", "١", "é", "_"]
    made = ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    arabic = str.maketrans("ة١", "ه1", "ً")
    columns = {"n": T.normalize_arabic(F.col("x")), "l": T.normalized_lines(F.col("x")), "k": T.key(F.col("x")), "one": T.normalize_line(F.col("x")), "t": T.tokens(F.col("x"), False)}
    rows = spark.createDataFrame(list(enumerate(made)), "id int, x string").select("id", *[c.alias(k) for k, c in columns.items()]).collect()

    def line(x):
        return re.sub("[ \t]+", " ", x.replace("\xa0", " ").replace("\u200b", "")).strip()

    for row in rows:
        x = made[row.id]
        assert row.n == "\n".join(y for p in x.translate(arabic).splitlines() if (y := " ".join(p.split()))), repr(x)
        assert row.l == [y for p in x.splitlines() if (y := line(p))] and row.one == line(x) and row.k == " ".join(x.split()).lower(), repr(x)
        assert row.t == re.findall(r"\*[0-9]+(?:\*[0-9]+)*#|[\w\u0600-\u06FF]+", row.n.lower()), repr(x)


def test_tokens_keep_short_codes_and_stem(spark):
    cases = [("Dial *١٢٣*4# now!", ["dial", "*123*4#", "now"]), ("محفظتي المحفظة محفظه", ["محفظه"] * 3), ("ال", ["ال"]), ("", []), (None, [])]
    got = values(spark, [(k, a) for k, (a, _) in enumerate(cases)], "k int, x string", "k", T.tokens(F.col("x")))
    assert {k: v for k, v in got} == {k: b for k, (_, b) in enumerate(cases)}


def test_language(spark):
    cases = [("مرحبا كيف الحال", "ar"), ("hello there", "en"), ("hello مرحبا بكم في", "ar"), ("a long english text with واحد", "en"), ("*140#", "en"), ("", "en"), ("shu ba3mal", "en"), ("رصيد 5G", "ar"), ("؟؟", "ar"), ("123", "en")]
    assert [r[0] for r in values(spark, [(a,) for a, _ in cases], "x string", T.language(F.col("x")))] == [b for _, b in cases]


def test_arabizi_and_vague(spark):
    cases = [("shu ba3mal", True), ("kif fi ashtare", True), ("How do I pay my bill", False), ("كيف أدفع", False), ("*140#", False), ("", False), ("shu ye3ni QR؟", True), ("What is 5G?", True)]
    assert [r[0] for r in values(spark, [(a,) for a, _ in cases], "x string", T.is_arabizi(F.col("x")))] == [b for _, b in cases]
    vague = [("ز", True), ("??", True), ("12345", True), ("aaaaa", True), ("ااااا", True), ("bill", False), (None, True)]
    assert [r[0] for r in values(spark, [(a,) for a, _ in vague], "x string", T.is_vague(F.col("x")))] == [b for _, b in vague]


def test_boilerplate(spark):
    cases = [("Home", True), ("  MAIN   menu ", True), ("• • •", True), ("12.", True), ("12345", False), ("Read more", True), ("Contact us today for help", True), ("We're here to help you", True), ("Read more books", False), ("الرئيسية", True), ("A+", True), ("Step one", False)]
    assert [r[0] for r in values(spark, [(a,) for a, _ in cases], "x string", T.is_boilerplate(F.col("x")))] == [b for _, b in cases]


def test_relevance_and_decision(spark):
    cases = [(0.85, "hosted", "en", False, True), (0.05, "hosted", "en", False, False), (None, "hosted", "en", False, False), (0.6, "unknown", "fr", False, True), (0.095, "hosted", "ar", True, True), (0.095, "hosted", "ar", False, False), (0.3, "local", "ar", False, True), (0.55, None, "ar", None, True)]
    got = values(spark, [c[:4] for c in cases], "s double, b string, l string, a boolean", G.is_relevant(F.col("s"), F.col("b"), F.col("l"), F.col("a")))
    assert [r[0] for r in got] == [c[4] for c in cases]
    verdicts = [(False, True, True, "x", True, "out_of_domain"), (True, True, True, "x", True, "needs_account_data"), (None, None, True, "x", False, "ambiguous"), (True, False, True, "", False, "no_info"), (None, None, None, None, True, "answer_normally")]
    got = values(spark, [v[:5] for v in verdicts], "d boolean, n boolean, a boolean, c string, r boolean", G.action(*[F.col(c) for c in "dnacr"]))
    assert [r[0] for r in got] == [v[5] for v in verdicts]
    assert values(spark, [("no_info", "fr")], "r string, l string", G.refusal(F.col("r"), F.col("l")))[0][0] == G.REFUSALS[("no_info", "en")]
    assert len({v for v in G.REFUSALS.values()}) == len(G.REFUSALS)


def test_routing_status_and_waiting(spark):
    assert [r[0] for r in values(spark, [(0.65,), (0.64,), (None,)], "s double", G.route(F.col("s")))] == ["small", "main", "main"]
    assert [r[0] for r in values(spark, [("q",), (" ",), (None,), ("x" * 1001,), ("x" * 1000,)], "q string", G.status(F.col("q")))] == [200, 400, 400, 400, 200]
    waits = [("Please try again in 1m2.5s", 0, 63.0), ("try again in 250ms", 0, 0.75), ("busy", 2, 6.0), (None, 0, 2.0)]
    assert [r[0] for r in values(spark, [w[:2] for w in waits], "m string, a int", G.retry_after(F.col("m"), F.col("a")))] == [w[2] for w in waits]


def test_salvage(spark):
    cases = [('{"score": 1}', 1.0), ('x {"score": 0.5} y', 0.5), ("none", None), (None, None)]
    assert [r[0] for r in values(spark, [(a,) for a, _ in cases], "x string", G.salvage(F.col("x"), "score double")["score"])] == [b for _, b in cases]


def plain_fixed(text, size, overlap):
    out, at = [], 0
    while at < len(text):
        out.append(text[at : at + size])
        if at + size >= len(text):
            break
        at += size - overlap
    return out


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (7, 0), (5, 4)])
def test_fixed_chunks_agree_with_a_loop(spark, size, overlap):
    texts = ["", "a", "x" * size, "x" * (size + 1)] + ["".join(chr(97 + k % 26) for k in range(n)) for n in range(11, 40)]
    got = values(spark, [(t,) for t in texts], "x string", F.col("x"), C.fixed(F.col("x"), size, overlap))
    assert all(list(c) == plain_fixed(t, size, overlap) for t, c in got)


def test_fixed_chunks_must_advance():
    with pytest.raises(ValueError):
        C.fixed(F.lit("x"), 5, 5)


def test_sentences_pack_and_keep_long_ones(spark):
    text = "One. Two! Three? " + "long " * 10 + "end. Last"
    (chunks,) = values(spark, [(text,)], "x string", C.sentences(F.col("x"), 12))[0]
    assert chunks == ["One. Two!", "Three?", ("long " * 10 + "end.").strip(), "Last"]


def test_structure_splits_at_questions_and_headings(spark):
    text = "Intro line.\nHow do I pay?\nDial the code.\nRoaming data feature\nThis feature lets you use data when you travel.\nPress the key\nThen it works for all of the lines you own."
    rows = C.structure(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, language string")).orderBy("chunk_index").collect()
    assert [r.text.split("\n")[0] for r in rows] == ["Intro line.", "How do I pay?", "Roaming data feature"]
    assert "\n".join(r.text for r in rows) == text
    arabic = "مقدمة.\nكيف ادفع الفاتورة؟\nمن التطبيق.\nادفع؟"
    assert C.structure(spark.createDataFrame([(1, arabic, "ar")], "doc_id long, text string, language string")).count() == 2


def test_durations_round_the_exact_value_as_sql_does(spark):
    from millrace.functions import logs

    ms = [999, 1000, 1050, 1149, 1150, 1250, 1350, 1750, 1950, 1999, 2250, 2350, 9950, 10050, 12345, 64250, 99950, 1234550, *range(1050, 60000, 350)]
    found = values(spark, [(x,) for x in ms], "ms long", F.col("ms"), logs.duration(F.col("ms")))
    assert found == [(x, f"{x} ms" if x < 1000 else f"{x / 1000:.1f} s") for x in ms]
