"""From questions to responses, searches put together, and tables and logs that runs go on with."""

import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.functions import logs
from millrace.functions import providers as P
from millrace.operators import answers as A
from millrace.operators import evaluation as E
from millrace.operators import questions as Q
from millrace.operators import reports
from millrace.operators import retrieval as R
from millrace.operators import search as S
from millrace.sources import shared, sinks

CHUNKS = [(1, "red fish in the blue sea", "a.html"), (2, "a green bird", "b.html"), (3, "red red wine and fish", "a.html"), (4, "nothing of it", "c.html")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "doc_id long, text string, source string")


def ranked(spark, *rows):
    return spark.createDataFrame(rows, "query_id long, rank int, doc_id long, score double")


def searches(spark):
    """Fixed lists: the vector side finds 3, 1 and 2 for every query, the keyword side 1 and 4."""
    near = [(3, 0.9), (1, 0.8), (2, 0.1)]
    side = lambda found: lambda q, k: q.select("query_id", F.explode(F.array(*[F.struct(F.lit(n + 1).alias("rank"), F.lit(d).cast("long").alias("doc_id"), F.lit(s).alias("score")) for n, (d, s) in enumerate(found[:k])])).alias("r")).select("query_id", "r.*")
    return side(near), side([(1, 7.5), (4, 2.5)])


def test_hybrid_search_and_rerank(spark):
    asked = spark.createDataFrame([(7, "fish")], "query_id long, text string")
    rows = S.hybrid(asked, *searches(spark), 3).orderBy("rank").collect()
    assert [(r.doc_id, r.score, r.rrf_score) for r in rows] == [(1, 0.8, round(1 / 62 + 1 / 61, 6)), (3, 0.9, round(1 / 61, 6)), (4, 2.5, round(1 / 62, 6))] and {r.vector_top_score for r in rows} == {0.9}
    score = lambda c: c.where("doc_id <> 2").select("query_id", "doc_id", F.when(F.col("doc_id") == 4, 0.50001).otherwise(0.5).alias("rerank_score"))
    assert [r.doc_id for r in S.hybrid(asked, *searches(spark), 4, rerank=score).orderBy("rank").collect()] == [1, 3, 4, 2]
    assert [r.doc_id for r in S.search(asked, "keyword", *searches(spark), 1).collect()] == [1]
    with pytest.raises(ValueError, match="unknown mode"):
        S.search(asked, "dense", *searches(spark), 1)


def test_merged_lists_keep_the_best_score_and_first_place(spark):
    one, two = ranked(spark, (1, 1, 10, 0.5), (1, 2, 20, 0.4)), ranked(spark, (1, 1, 20, 0.6), (1, 2, 30, 0.5))
    assert [(r.doc_id, r.score) for r in S.merged(one, two, 3).orderBy("rank").collect()] == [(20, 0.6), (10, 0.5), (30, 0.5)]


def test_search_by_join_agrees_with_map_side_search(spark, sf, monkeypatch):
    docs, asked = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    plain = docs.unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text")))
    index, bare = R.build_index(plain), R.build_index(plain, False)
    read = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())
    mapped = read(R.bm25_search(index, asked, 7)), read(R.overlap_search(bare, asked, 7))
    monkeypatch.setattr(R, "MOST_ASKED", 0)
    assert mapped == (read(R.bm25_search(index, asked, 7)), read(R.overlap_search(bare, asked, 7)))


def test_a_term_in_every_document_is_no_one_tasks(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common word "), F.col("id").cast("string")).alias("text"))
    found = R.bm25(docs, spark.createDataFrame([(1, "common 77")], "query_id long, text string"), 3)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [77, 0, 1]
    assert R.bm25(docs.limit(0), spark.createDataFrame([(1, "x")], "query_id long, text string"), 3).collect() == []


def test_questions_are_followed_to_their_responses(spark, chunks):
    asked = [(1, " "), (2, "??"), (3, "What is  RED fish"), (4, "tell me of birds please"), (5, "how do I open my account"), (6, "who won the game"), (7, "x" * 1001), (8, "some near question")]
    vec = {3: [0.0, 1.0], 8: [1.0, 0.0]}
    table = spark.createDataFrame([(i, t, None, None, None, None, vec.get(i, [0.6, 0.6])) for i, t in asked], "query_id long, question string, language string, top_k int, mode string, embedding_backend string, vec array<double>")
    cache = spark.createDataFrame([(1, "what is red fish", [0.1, 0.1], "Old answer", ["z"]), (2, "other", [1.0, 0.0], "Near answer", ["y"])], "id long, key string, vec array<double>, answer string, sources array<string>")
    verdicts = spark.createDataFrame([(4, None, None, None, None), (5, True, True, False, ""), (6, False, False, False, "")], "query_id long, in_domain boolean, needs_account_data boolean, is_ambiguous boolean, clarifying_question string")
    templates = spark.createDataFrame([("en", "C: {context}\nQ: {question}")], "language string, template string")
    got = {r.query_id: r for r in A.ask(table, cache, *searches(spark), chunks, verdicts, templates, k=2).collect()}
    assert {i: r.action for i, r in got.items()} == {1: "invalid", 2: "too_vague", 3: "cached", 4: "answer_normally", 5: "needs_account_data", 6: "out_of_domain", 7: "invalid", 8: "cached"}
    assert json.loads(got[7].body)["error"] == "Question too long (1001 chars). Maximum is 1000." and got[1].status == 400
    assert (got[3].text, got[3].match_type, got[8].text, got[8].match_type) == ("Old answer", "identical", "Near answer", "similar")
    assert got[4].prompt == "C: [Source 1: a.html]\nred fish in the blue sea\n\n[Source 2: a.html]\nred red wine and fish\nQ: tell me of birds please" and got[4].text is None and got[4].model == "small" and got[4].confidence == 0.9
    assert got[4].preview == "- red fish in the blue sea\n- red red wine and fish" and got[2].preview == A.NO_RESULTS and got[4].sources == ["a.html"]
    parsed = spark.createDataFrame([(got[5].body,)], "b string").select(Q.parsed_response(F.col("b"), "guardrail_action string, cache_hit boolean, sources array<string>").alias("p")).first().p
    assert parsed.answer == got[5].text and (parsed.metadata.guardrail_action, parsed.metadata.cache_hit, parsed.metadata.sources) == ("needs_account_data", False, ["a.html"])


def test_cache_log_is_appended_to_and_read(spark, tmp_path):
    path = str(tmp_path / "cache")
    answered = spark.createDataFrame([("  Was  IST das? ", [1.0], "Größe ✓", "en", ["s"]), ("no", [1.0], None, "en", [])], "question string, vec array<float>, answer string, language string, sources array<string>")
    assert sinks.read_log(spark, path, sinks.CACHE).collect() == []
    sinks.append_json(A.cache_entries(answered).coalesce(1), path)
    (file,) = [f for f in os.listdir(path) if f.endswith(".json")]
    assert "Größe ✓" in (tmp_path / "cache" / file).read_text("utf-8")
    (tmp_path / "cache" / "more.json").write_text('\n  \n{"question": "q2"}\n')
    rows = {r.question: r for r in sinks.read_log(spark, path, sinks.CACHE).collect()}
    assert rows["  Was  IST das? "].normalized_question == "was ist das?" and rows["q2"].answer is None and len(rows) == 2
    items = spark.createDataFrame([("1", "simple", "Was ist DAS?"), ("2", "simple", "new"), ("3", "simple", "NEW "), ("4", "should_refuse", "other")], "id string, type string, question string")
    known = sinks.read_log(spark, path, sinks.CACHE).select(F.col("normalized_question").alias("key"))
    assert [r.id for r in A.to_warm(items, known).collect()] == ["2"]


def test_token_events_and_tables(spark, tmp_path):
    path = str(tmp_path / "tokens")
    sinks.log_tokens(spark.createDataFrame([("en", 5, 6), ("ar", None, 2)], "language string, prompt_tokens int, completion_tokens int"), path)
    (row,) = sinks.read_log(spark, path, sinks.TOKENS).collect()
    assert (row.language, row.prompt_tokens, row.completion_tokens) == ("en", 5, 6) and row.ts.endswith("+00:00")
    place, size = sinks.collection(str(tmp_path), "hosted")
    assert size == 1024 and sinks.ensure_table(spark, place, "id long").count() == 0
    spark.range(3).write.mode("append").parquet(place)
    assert sinks.ensure_table(spark, place, "id long").count() == 3 and sinks.ensure_table(spark, place, "id long", recreate=True).count() == 0
    with pytest.raises(ValueError, match="unknown embedding backend"):
        sinks.collection("x", "other")


def test_a_broken_run_goes_on_where_it_was(spark, tmp_path):
    items, path, seen = spark.range(40).withColumnRenamed("id", "k"), str(tmp_path / "done"), []

    def work(part):
        if len(seen) == 3:
            seen.append(None)
            raise RuntimeError("stopped")
        seen.append([r.k for r in part.collect()])
        return part.withColumn("v", F.col("k") * 2)

    with pytest.raises(RuntimeError):
        sinks.resume(items, path, "k", work, "k long, v long")
    done = sinks.resume(items, path, "k", work, "k long, v long")
    assert sorted((r.k, r.v) for r in done.collect()) == [(k, 2 * k) for k in range(40)]
    worked = [k for part in seen if part for k in part]
    assert sorted(worked) == list(range(40))


def test_json_arrays_and_literal_items(spark, tmp_path):
    (tmp_path / "items.json").write_text('[{"id": "a", "n": 1},\n {"id": "b"}]')
    assert [tuple(r) for r in sinks.read_json_array(spark, str(tmp_path / "items.json"), "id string, n int").collect()] == [("a", 1), ("b", None)]
    assert [tuple(r) for r in sinks.literal_items(spark, {"en": ["x", "y"], "ar": ["z"]}, "should_refuse", 9).collect()] == [("q009", "en", "should_refuse", "x"), ("q010", "en", "should_refuse", "y"), ("q011", "ar", "should_refuse", "z")]


def test_log_texts(spark):
    got = spark.range(1).select(
        logs.timings(a=F.lit(2.5), b=F.lit(None).cast("double"), c=F.lit(3.6)).alias("t"), logs.cache_line(F.lit("similar"), F.lit(0.98765)).alias("near"), logs.cache_line(F.lit("identical"), F.lit(1.0)).alias("same"), logs.cache_line(F.lit("none"), F.lit(None).cast("double")).alias("miss"),
        logs.duration(F.lit(999.6)).alias("d"), logs.duration(F.lit(12345)).alias("s"), logs.shortened(F.lit("abcdef"), 3).alias("cut"), logs.shortened(F.lit(None).cast("string"), 3).alias("none"),
    ).first()
    assert tuple(got) == ("a=2ms c=4ms", "[cache] HIT match=similar similarity=0.9877", "[cache] HIT match=identical", "[cache] MISS", "1000 ms", "12.3 s", "abc…", "")


def test_containment_agrees_with_a_loop(spark):
    items = [(1, "the quick brown fox jumps"), (2, "a quick brown\nfox"), (3, ""), (4, None), (5, "brownish quick brown foxes"), (6, "ox")]
    rules = [(1, "quick brown fox"), (2, "ick brown fo"), (3, "ox"), (4, "fox jumps"), (5, "zzz"), (6, "k brown f"), (7, " quick  ")]
    got = {(r.rule_id, r.item_id) for r in Q.containing(spark.createDataFrame(rules, "rule_id int, part string"), spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert got == {(i, j) for i, part in rules for j, text in items if text and part in text}


def test_experiments_and_draws(spark):
    rows = spark.createDataFrame([("en", "simple", "answer_normally", True, 1, 0.5, 1.0, 0.7, 10.0, 4, 2, 9), ("en", "simple", "no_info", False, 0, 0.0, 0.0, 0.9, 30.0, 6, 0, 7), ("en", "should_refuse", "ambiguous", False, 1, 1.0, 1.0, None, 20.0, 8, 1, 5), ("ar", "should_refuse", "answer_normally", True, 1, 1.0, 1.0, 0.1, None, 1, 1, 1)], "language string, type string, action string, answered boolean, hit int, recall double, reciprocal_rank double, faithfulness double, total double, prompt int, completion int, context int")
    rows = rows.withColumns({s: F.lit(None).cast("double") for s in E.STAGES})
    en, ar = (E.experiment_summary(rows, 1.0, 2.0).where(F.col("language") == x).first() for x in ("en", "ar"))
    assert (en.n_items, en.hit, en.recall, en.faithfulness, en.hallucination_rate, en.answered, en.refused, en.p50, en.p95, en.prompt_tokens, en.cost, en.context_tokens, en.ttft_ms) == (3, 0.5, 0.25, 0.7, 1.0, "1/2", "1/1", 20.0, 30.0, 6.0, 0.000008, 9.0, None)
    assert (ar.hit, ar.hallucination_rate, ar.answered, ar.refused, ar.p50) == (None, None, "0/0", "0/1", None)
    items, others = spark.range(20).select(F.col("id").alias("item_id"), F.col("id").alias("place")), spark.range(100, 104).select(F.col("id").alias("item_id"))
    drawn = E.weighted_draws(items, spark.range(4000).select(F.col("id").alias("draw")), 1, others).collect()
    assert len({r.draw for r in drawn}) == len(drawn) == 4000 and 0.12 < sum(r.item_id >= 100 for r in drawn) / 4000 < 0.18
    table, n = E.delete_where(spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, s string"), "s", "a")
    assert n == 1 and table.count() == 2 and [r.id for r in E.chosen(spark.range(9), ids=[5, 3, 4], limit=2).collect()] == [3, 4]


def test_reports_and_samples(spark, tmp_path):
    table = spark.createDataFrame([("a|b", None), ("c", 1)], "x string, n int").coalesce(1)
    assert reports.report("T", {"One": "text\n", "Two": table}) == "# T\n\n## One\n\ntext\n\n## Two\n\n| x | n |\n| - | - |\n| a\\|b |  |\n| c | 1 |\n"
    before, after = spark.createDataFrame([("k", "abcdef"), ("m", "x")], "id string, text string"), spark.createDataFrame([("k", "abé")], "id string, text string")
    rows = reports.samples(before, after, "id", 3)
    assert sorted(tuple(r) for r in rows.collect()) == [("k", "after", "abé"), ("k", "before", "abc")]
    reports.write_samples(rows, "id", str(tmp_path / "s"))
    (file,) = (tmp_path / "s" / "id=k" / "part=after").glob("*.txt")
    assert file.read_text("utf-8") == "abé\n"


def test_a_shared_folder_must_be_set_on_clusters(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Cluster())


def test_saved_page_boilerplate_takes_the_callers_lists(spark):
    rows = spark.createDataFrame([("Menu",), ("menu",), ("Nav",), ("was THIS page useful?",), ("text",)], "x string")
    assert [r[0] for r in rows.coalesce(1).select(P.is_saved_page_boilerplate(F.col("x"), ("Menu",), ("Nav",), ("this page useful",))).collect()] == [True, False, True, True, False]
