"""From a question to its response: cache, search, preview, decision, prompt or refusal, and a body with metadata after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions import text as T
from ..sources import shared
from . import evaluation as E
from . import questions as Q
from . import search as S

# What a classifier is shown of results.
PREVIEW_CHUNKS, PREVIEW_CHARS, NO_RESULTS = 5, 220, "(no results found)"
BATCH_K = 5


def cache_key(text: Column) -> Column:
    """What questions are equal by: ends stripped, small letters, white space collapsed."""
    return T.even(F.lower(T.strip(F.coalesce(text, F.lit("")))))


def contexts(results: DataFrame) -> DataFrame:
    """(query_id, context, judged, preview, sources) of results (query_id, rank, text, source).

    context names each source, judged is texts alone, preview the first characters of the first results as a list.
    """
    whole = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "text", "source"))).alias("r"))
    named = F.transform("r", lambda x: F.concat(F.lit("[Source "), x["rank"].cast("string"), F.lit(": "), x["source"], F.lit("]\n"), x["text"]))
    shown = F.transform(F.slice("r", 1, PREVIEW_CHUNKS), lambda x: F.concat(F.lit("- "), F.left(x["text"], F.lit(PREVIEW_CHARS))))
    sources = F.array_sort(F.array_distinct(F.transform("r", lambda x: x["source"])))
    return whole.select("query_id", F.array_join(named, "\n\n").alias("context"), F.array_join("r.text", "\n\n").alias("judged"), F.array_join(shown, "\n").alias("preview"), sources.alias("sources"))


def body(text: Column, metadata: Column) -> Column:
    """A response: its text, the marker, and its metadata as JSON; null fields are kept."""
    return F.concat(text, F.lit("\n" + Q.MARKER), F.to_json(metadata, {"ignoreNullFields": "false"}))


def ask(asked: DataFrame, cache: DataFrame, vector: S.Search, keyword: S.Search, chunks: DataFrame, verdicts: DataFrame, templates: DataFrame, similarity: float = 0.93, k: int = BATCH_K) -> DataFrame:
    """One row for each of asked (query_id and the columns of `requests`, and vec): status, action, match_type, language, confidence, model, prompt, text and body.

    cache has (id, key, vec, answer, sources), chunks (doc_id, text, source), templates (language, template); verdicts are
    as `questions.ask` takes them. Only valid questions that are not vague are looked up in the cache, and only those
    without an entry are searched for. Where the action is to answer, prompt is what goes to a model and text is null;
    else text says why not. Repeated questions are rows of their own.
    """
    asked = Q.requests(asked)
    valid = asked.where("status = 200 and not is_vague")
    found = E.cache_lookup(valid.select(F.col("query_id").alias("id"), cache_key(F.col("question")).alias("key"), "vec"), cache.select("id", "key", "vec"), similarity)
    hits = found.join(cache.select(F.col("id").alias("entry_id"), "answer", F.col("sources").alias("cached_sources")), "entry_id", "left").select(F.col("question_id").alias("query_id"), "match_type", "answer", "cached_sources")
    hits = shared.written(hits, "cache-hits")  # these and the ranked results are read several times
    missed = valid.join(hits.where("match_type = 'none'").select("query_id"), "query_id", "left_semi")
    ranked = shared.written(S.hybrid(missed.select("query_id", F.col("question").alias("text")), vector, keyword, k), "ranked")
    told = contexts(ranked.join(chunks, "doc_id"))
    decided = Q.ask(missed, verdicts, ranked.select("query_id", "rank", F.lit("").alias("source"), F.col("vector_top_score").alias("similarity"))).select("query_id", "action", "confidence", "model")
    rows = asked.join(hits, "query_id", "left").join(decided, "query_id", "left").join(told, "query_id", "left").join(F.broadcast(templates), "language", "left").join(verdicts.select("query_id", "clarifying_question"), "query_id", "left")
    action = F.when(F.col("status") == 400, "invalid").when(F.col("is_vague"), "too_vague").when(F.col("match_type") != "none", "cached").otherwise(F.col("action"))
    rows = rows.withColumn("action", action)
    answers = F.col("action") == "answer_normally"
    language = F.when(F.col("action") == "too_vague", F.when(T.has_arabic(F.col("question")), "ar").otherwise("en")).otherwise(F.col("language"))
    text = (
        F.when(F.col("action") == "invalid", F.when(F.col("question") == "", "Question cannot be empty.").otherwise(F.concat(F.lit("Question too long ("), F.length("question").cast("string"), F.lit(f" chars). Maximum is {G.MAX_QUESTION}."))))
        .when(F.col("action") == "too_vague", G.vague_text(language)).when(F.col("action") == "cached", F.col("answer")).when(F.col("action") == "ambiguous", F.col("clarifying_question"))
        .when(~answers, G.refusal(F.col("action"), language))
    )
    rows = rows.select(
        "query_id", "status", "action", F.when(F.col("action") == "cached", F.col("match_type")).alias("match_type"), language.alias("language"), "mode", "confidence", F.when(answers, F.col("model")).alias("model"),
        F.when(answers, Q.prompt(F.col("template"), F.coalesce("context", F.lit("")), F.col("question"))).alias("prompt"), F.when(~answers, text).alias("text"), F.coalesce("preview", F.lit(NO_RESULTS)).alias("preview"), F.when(F.col("action") == "cached", F.col("cached_sources")).otherwise(F.col("sources")).alias("sources"),
    )
    metadata = F.struct("language", F.col("mode").alias("retrieval_mode"), F.col("action").alias("guardrail_action"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), (F.col("action") == "cached").alias("cache_hit"), "match_type")
    return rows.withColumn("body", F.when(F.col("status") == 400, F.to_json(F.struct(F.col("text").alias("error")))).when(F.col("text").isNotNull(), body(F.col("text"), metadata)))


def cache_entries(answered: DataFrame) -> DataFrame:
    """(normalized_question, question, embedding, answer, language, sources) to append to the cache, of answered (question, vec, answer, language, sources); what has no answer is left out."""
    rows = answered.where("answer is not null")
    return rows.select(cache_key(F.col("question")).alias("normalized_question"), "question", F.col("vec").alias("embedding"), "answer", "language", "sources")


def to_warm(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Items (id, type, question) that a warm-up asks: answerable ones whose key the cache (key) doesn't have, one of each key."""
    rows = items.where("type <> 'should_refuse'").withColumn("key", cache_key(F.col("question")))
    first = rows.groupBy("key").agg(F.min("id").alias("id"))
    return rows.join(first, ["key", "id"]).join(cache.select("key").distinct(), "key", "left_anti")
