"""Operators on small tables: invariants, ties, sources, streams."""

import io
import math
import random
import re
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunking as C
from millrace.operators import evaluation as E
from millrace.operators import lines as L
from millrace.operators import questions as Q
from millrace.operators import retrieval as R
from millrace.sources import corpus, html
from millrace.streaming import updates, versions


def test_bm25_agrees_with_a_loop(spark):
    docs = [(1, "red fish blue fish"), (2, "one fish"), (3, "blue sky"), (4, ""), (5, "blue sky")]
    got = [tuple(r) for r in R.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, "Blue fish fish nothing")], "query_id long, text string"), 4).orderBy("rank").collect()]
    words = {i: t.split() for i, t in docs}
    mean = sum(map(len, words.values())) / len(docs)
    score = {}
    for i, w in words.items():
        for t in {"blue", "fish", "nothing"}:
            df, tf = sum(t in x for x in words.values()), w.count(t)
            if tf:
                score[i] = score.get(i, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
    want = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:4]
    assert [(r[2], r[3]) for r in got] == [(i, round(s, 6)) for i, s in want] and got[-1][2] > got[-2][2]


def test_vector_search_by_blocks(spark):
    r = random.Random(1)
    rows = [(k, [float(r.randint(-3, 3)) for _ in range(4)]) for k in range(300)] + [(None, [1.0] * 4), (900, None)]
    vectors = spark.createDataFrame(rows, "id long, vec array<float>").where("id is not null")
    got = {(x.query_id, x.rank): x.vec_id for x in R.vector_top(vectors, vectors.where("id < 5"), 3).collect()}
    for q in range(5):
        best = sorted(((-sum(a * b for a, b in zip(rows[q][1], v)), i) for i, v in rows[:300]))[:3]
        assert [got[(q, k + 1)] for k in range(3)] == [i for _, i in best]


def test_rrf_ties_go_to_what_was_seen_first(spark):
    one = spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "query_id long, rank int, doc_id long")
    two = spark.createDataFrame([(1, 1, 20), (1, 2, 10), (1, 3, 30)], "query_id long, rank int, doc_id long")
    assert [r.doc_id for r in R.rrf([one, two], 5).orderBy("rank").collect()] == [10, 20, 30]


def test_line_operators(spark):
    rows = spark.createDataFrame([(1, ["A", "a", "b", "A", "x" * 101, "x" * 101, "b"]), (2, [])], "doc_id long, lines array<string>")
    read = lambda df: {r.doc_id: r.lines for r in df.collect()}
    assert read(L.without_consecutive(rows)) == {1: ["A", "b", "A", "x" * 101, "b"], 2: []}
    assert read(L.without_repeated_short(rows)) == {1: ["A", "b", "x" * 101, "x" * 101], 2: []}
    assert read(L.first_of_each(rows)) == {1: ["A", "a", "b", "x" * 101], 2: []}
    assert read(L.first_of_each(L.first_of_each(rows))) == read(L.first_of_each(rows))


def test_line_operators_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "a\nb\na", "en"), (1, None, "en"), (2, "", "ar")], "doc_id long, text string, language string")
    for made in (L.cleaned(docs), L.nav_blocks(L.with_clean_blocks(L.paged(docs))), L.repeated_blocks(L.with_clean_blocks(L.paged(docs))), C.structure(docs), Q.page_texts(L.paged(docs))):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.text, r.status) for r in L.cleaned(docs).collect()) == [(1, "", "rejected"), (1, "a\nb", "ok"), (2, "", "rejected")]


def test_long_documents_take_linear_time(spark):
    text = "\n".join(f"line {k % 3000} of a document, this is" for k in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    assert L.cleaned(docs).first().n_lines == 3000 and docs.select(F.size(T.tokens(F.col("text")))).first()[0] == 20_000 * 7
    assert time.perf_counter() - began < 20


WORDS = ["the", "Red", "fish", "swims", "and", "Home", "*12#", "x,", "end.", "https://a.b", "• item", "with", "In", "why?", "A", "Data offer", "You can", "benefit", "12", "–"]


def python_continues(before, line):
    """Whether a line goes on with the one before it, by plain rules in the order that they are stated."""
    if not before or not line:
        return False
    if any(x.startswith(("•", "◦", "▪", "▫", "●", "○", "■", "□", "- ")) or re.search(r"\*[0-9]+(\*[0-9]+)*#|https?://", x) for x in (before, line)) or before[-1] in ".?!:":
        return False
    words, open_ = before.split(), before[-1] in ",;–-"
    if len(words) <= 8 and len(before) <= 60 and not open_ and words[-1].lower() not in Q.DANGLING:
        return False
    return open_ or line[0].islower() or line.split()[0].lower() in Q.CONTINUING


def python_merge(lines):
    out = []
    for line in lines:
        if out and python_continues(out[-1], line):
            out[-1] = out[-1].rstrip() + " " + line.lstrip()
        else:
            out.append(line)
    return out


def python_split(line):
    for start in Q.CONTENT_STARTS:
        m = re.match(rf"(?i)^(.{{3,60}}?)\s+({start}\b.+)$", line)
        if m and len(m[1].split()) <= 8 and len(m[2].split()) >= 3:
            return [m[1].strip(), m[2].strip()]
    m = re.match(Q.GENERAL_HEADING, line)
    if m and len(m[1].split()) <= 6 and m[1].strip()[-1] not in ".?!:,;":
        return [m[1].strip(), m[2].strip()]
    return [line]


def test_headings_and_wrapped_lines_agree_with_plain_python(spark):
    r = random.Random(3)
    made = [[" ".join(r.choice(WORDS) for _ in range(r.randint(1, 14))) for _ in range(r.randint(0, 9))] for _ in range(400)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(made)], "id int, lines array<string>")
    got = {x.id: (x.m, x.s) for x in rows.select("id", Q.merge_wrapped(F.col("lines")).alias("m"), F.transform("lines", Q.split_heading).alias("s")).collect()}
    for k, lines in enumerate(made):
        assert got[k] == (python_merge(lines), [python_split(x) for x in lines]), lines
    assert sum(len(x) < len(y) for (x, _), y in zip(got.values(), made)) > 30 and sum(len(p) == 2 for _, s in got.values() for p in s) > 30


def test_page_texts(spark):
    pages = [
        (1, 0, 0, "Skip to main content\nEnglish العربية\nPage 3\n7.\n1. Home\nREAD more"), (1, 0, 1, "All offers of this month\nare here"), (1, 0, 2, "Personal\nBusiness\nOffers\na\nb"), (1, 0, 3, "• All Offers  of this month are here"),
        (1, 1, 0, "• all offers of this month are here"), (1, 1, 1, "Prices\u200c\n\nThe price of this very long and wide offer that is for all and\nstays so.\nstays SO.\nBalance"), (2, 0, 0, "12\n• ◦"),
    ]
    blocks = spark.createDataFrame(pages, "doc_id long, page int, block int, text string")
    got = {r.doc_id: (r.text, r.status, r.reject_reason) for r in Q.page_texts(L.collected(blocks, "doc_id")).collect()}
    assert got[1] == ("Prices\nThe price of this very long and wide offer that is for all and stays so.", "ok", None)
    assert got[2] == ("", "rejected", "no usable text layer")


def test_nearest_rank_is_half_even(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(6)] + [(None,)], "v double")
    assert E.nearest_rank(rows, "v", (50, 95, 0, 100)).first().asDict() == {"n": 6, "p50": 2.0, "p95": 5.0, "p0": 0.0, "p100": 5.0}


def test_metrics_are_monotone_and_divide_by_k(spark):
    items = spark.createDataFrame([("a",), ("b",)], "id string")
    ranked = spark.createDataFrame([("a", k, k) for k in range(1, 5)], "id string, rank int, doc_id long")
    gold = spark.createDataFrame([("a", 2), ("a", 9), ("b", 1)], "id string, doc_id long")
    a, b = (r.asDict() for r in E.ranking_metrics(items, ranked, gold).orderBy("id").collect())
    assert (a["mrr"], a["hit_1"], a["hit_3"], a["recall_10"], a["precision_10"]) == (0.5, 0, 1, 0.5, 0.1) and b["mrr"] == 0.0
    assert all(a[f"hit_{x}"] <= a[f"hit_{y}"] for x, y in zip(E.KS, E.KS[1:]))


def test_coverage_rank(spark):
    gold = spark.createDataFrame([(1, list("abcde")), (2, list("xyz")), (3, [])], "id int, tokens array<string>")
    got = spark.createDataFrame([(1, 1, list("ab")), (1, 2, list("bq")), (1, 3, list("cd")), (2, 1, list("x"))], "id int, rank int, tokens array<string>")
    assert {r.id: r.coverage_rank for r in E.coverage_rank(gold, got).collect()} == {1: 3, 2: None, 3: None}


def test_samples_repeat_and_round_robin_turns(spark):
    rows = spark.range(100).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"))
    pick = lambda df: sorted(r.id for r in E.sample_each(df, 5, 42, "id", "g").collect())
    assert pick(rows) == pick(rows.repartition(7)) and len(pick(rows)) == 15
    turns = E.round_robin(rows.where("g <> '2' or id < 9"), 10, 1, "id", "g").collect()
    assert [r.g for r in turns[:6]] == ["0", "1", "2"] * 2


def test_weighted_draws_take_each_draw_once(spark):
    items = spark.range(20).select(F.col("id").alias("item_id"), F.col("id").alias("place"))
    got = E.weighted_draws(items, spark.range(3000).select(F.col("id").alias("draw")), 1).groupBy("item_id").count().collect()
    count = {r["item_id"]: r["count"] for r in got}
    assert sum(count.values()) == 3000 and count[0] > count[5] > 0


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = E.upsert(old, new, "id")
    assert sorted(once.collect()) == sorted(E.upsert(once, new, "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_cache_prefers_exact_then_near(spark):
    cache = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [0.0, 1.0])], "id long, key string, vec array<double>")
    asked = spark.createDataFrame([(10, "a", [0.0, 1.0]), (11, "z", [0.0, 1.0]), (12, "z", [0.6, 0.6])], "id long, key string, vec array<double>")
    assert {r.question_id: (r.entry_id, r.match_type) for r in E.cache_lookup(asked, cache).collect()} == {10: (1, "identical"), 11: (2, "similar"), 12: (None, "none")}


PAGE = """<html><body><nav>menu</nav><main><p>One &amp; two<b>bold</p><script>x</script><div class="breadcrumb x">crumb</div><ul><li>item<li>item</ul>
<div class="eck-entity">tab</div><div class="eck-entity"><div class="field--name-field-body">kept</div></div><form><p>no</p></form><!-- c --></main>after</body></html>"""


@pytest.mark.parametrize(("page", "want"), [(PAGE, ("One & two\nbold\nitem\nkept", None)), ("<p>x</p>", (None, "no boundary")), ("", (None, "empty")), (None, (None, "empty")), ("<main> <nav>a</nav></main>", (None, "no text")), ("<main><p>open", ("open", None))])
def test_html(page, want):
    assert html.extract(page, ("main",)) == want


def test_html_at_any_depth():
    """End tags find their start under any number of unclosed elements, in time linear in the page."""
    assert html.extract("<main><nav>x" + "<b>" * 450 + "</nav><p>body</p></main>", ("main",)) == ("body", None)
    began = time.perf_counter()
    assert html.extract("<main>" + "<b><i>x</b>" * 60_000 + "<p>end</p></main>", ("main",)) == ("x\nend", None)
    assert time.perf_counter() - began < 10
    assert html.raw_text("<nav>menu</nav><script>no</script><p>a</p> <p>b") == "menu\na\nb"


def test_corpus_of_files(spark, tmp_path):
    (tmp_path / "en" / "faq").mkdir(parents=True)
    (tmp_path / "ar").mkdir()
    (tmp_path / "en/faq/lines.html").write_text("<main>Text</main>")
    (tmp_path / "en/empty_page.html").write_text("")
    (tmp_path / "en/.hidden.html").write_text("x")
    (tmp_path / "ar/page.htm").write_text("<main>خدمة</main>")
    (tmp_path / "en/bad.docx").write_bytes(b"no zip")
    (tmp_path / "en/x.pdf").write_bytes(b"%PDF")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Para</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "en/good.docx").write_bytes(buffer.getvalue())
    got = {r.source_file: r for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert {k: (r.text, r.language, r.topic, r.status) for k, r in got.items()} == {
        "en/faq/lines.html": ("Text", "en", "lines", "ok"), "ar/page.htm": ("خدمه", "ar", "page", "ok"), "en/bad.docx": ("", "en", "bad", "rejected"), "en/x.pdf": ("", "en", "x", "rejected"), "en/good.docx": ("Para\na | b", "en", "good", "ok"),
    }
    assert len(got["en/x.pdf"].doc_id) == 16 and "pdf" in got["en/x.pdf"].reject_reason
    page = corpus.SavedPage(lines=("Para",), parts=("| b",))
    assert {r.source_file: (r.text, r.reject_reason) for r in corpus.read_corpus(spark, str(tmp_path), page).collect()}["en/good.docx"] == ("", "no text")
    raw = {r.source_file: r.text for r in corpus.read_corpus(spark, str(tmp_path), page, clean=False).collect()}
    assert raw["en/good.docx"] == "Para\na | b" and raw["ar/page.htm"] == "خدمة"


def test_stream_replaces_documents(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "doc_id long, source_file string, text string"
    make = lambda df: df.select("source_file", F.upper("text").alias("text"))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        updates.upsert_stream(spark.readStream.schema(schema).json(source), target, "source_file", make, str(tmp_path / "state")).awaitTermination()
        return sorted(tuple(r) for r in versions.read(spark, target, "source_file string, text string").collect())

    assert run([(1, "a", "x"), (2, "b", "y"), (3, "c", "w")]) == [("a", "X"), ("b", "Y"), ("c", "W")]
    before = versions.in_force(spark, target)
    assert run([(3, "a", "z"), (3, "a", "w")]) == [("a", "W"), ("a", "Z"), ("b", "Y"), ("c", "W")]
    after = versions.in_force(spark, target)
    assert sum(before[k] != after[k] for k in before) == 1  # one bucket is written again, the others stay where they are
    assert run([(3, "a", "v")]) == [("a", "V"), ("b", "Y"), ("c", "W")]
    kept = [f for v in versions._versions(spark, target) for f in versions._folders(spark, v)]
    assert len(kept) == len(before) + 1  # what was replaced twice is gone


def test_percentiles_of_many_rows_with_far_out_values(spark):
    r = random.Random(4)
    rows = [("a", float(r.choice([1e300, -1e300, r.random(), round(r.random(), 2)]))) for _ in range(30_000)] + [("b", float(k % 7)) for k in range(15_000)] + [("c", 1.0), ("c", None), ("c", 2.0)]
    got = {x.g: (x.n, x.p0, x.p50, x.p95, x.p100) for x in E.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", (0, 50, 95, 100), "g", accuracy=1000).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (len(v), *[v[round(p / 100 * (len(v) - 1))] for p in (0, 50, 95, 100)])


def test_next_rows_across_blocks(spark):
    rows = [(g, k * 3, f"{g}{k}") for g in ("x", None) for k in range(50)]
    got = {(r.g, r.k): r.nxt for r in E.with_next(spark.createDataFrame(rows, "g string, k long, v string"), "g", "k", {"nxt": "v"}, block=10).collect()}
    assert got == {(g, k * 3): f"{g}{k + 1}" if k < 49 else None for g in ("x", None) for k in range(50)}


def test_vector_search_over_blocks_keeps_ties_and_all_ids(spark, monkeypatch):
    from millrace.operators import retrieval as R

    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 5)
    vecs = {i: [float(i % 4), float(i % 3)] for i in range(23)} | {23: [float("nan"), 0.0]}
    rows = spark.createDataFrame([*vecs.items(), (99, None)], "id long, vec array<double>").repartition(2)
    assert [len(r["ids"]) // 8 for r in R.vector_blocks(rows.coalesce(1)).collect()] == [5, 5, 5, 5, 4]
    asked = rows.where("id < 7")
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in R.vector_top(rows, asked, 4).collect())
    dot = lambda a, b: float("inf") if b[0] != b[0] else sum(x * y for x, y in zip(a, b))
    want = [(q, n + 1, i) for q in range(7) for n, i in enumerate(sorted(vecs, key=lambda i: (-dot(vecs[q], vecs[i]), i))[:4])]
    assert found == want


def test_embeddings_of_an_index_are_those_of_the_texts(spark):
    from millrace.functions import providers as P
    from millrace.operators import retrieval as R

    docs = spark.createDataFrame([(1, "one two two three *12#"), (2, ""), (3, None), (4, "خدمات الخدمة 7 seven")], "doc_id long, text string")
    want = {r["doc_id"]: list(r["embedding"]) for r in P.embed(docs).collect()}
    assert {r["id"]: list(r["vec"]) for r in R.index_embeddings(R.build_index(docs)).collect()} == want


def test_index_and_scores_work_in_bounded_slices(spark, monkeypatch):
    from millrace.operators import retrieval as R

    docs = spark.createDataFrame([(i, f"alpha beta{i % 5} " * (i % 7)) for i in range(60)], "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(q, f"alpha beta{q}") for q in range(5)], "query_id long, text string")
    plain = [tuple(r) for r in R.bm25(docs, asked, 4).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(R, "TOKENS", 9)
    monkeypatch.setattr(R, "CELLS", 10)
    assert [tuple(r) for r in R.bm25(docs, asked, 4).orderBy("query_id", "rank").collect()] == plain
    assert len(plain) == 20


def test_a_blank_line_among_wrapped_ones_is_no_error(spark):
    from millrace.operators import questions as Q

    lines = ["one two three four five six seven eight nine", "   ", "and more", "[see", "it goes on,", "  ", "till here"]
    found = spark.createDataFrame([(lines,)], "l array<string>").select(Q.merge_wrapped(F.col("l")).alias("m")).first()["m"]
    assert found == ["one two three four five six seven eight nine", "   ", "and more", "[see", "it goes on, ", "till here"]
