"""Searches put together: vector and keyword lists fused, reranked, dispatched by mode, and merged over rewrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from . import retrieval as R

MODES = ("vector", "keyword", "hybrid")
#: Candidates from each side before lists are fused, or reranked.
WIDEN = 20

#: From queries and a number to (query_id, rank, doc_id, score).
Search = Callable[[DataFrame, int], DataFrame]


def fused(lists: list[DataFrame], k: int) -> DataFrame:
    """(query_id, rank, doc_id, score, rrf_score): ranked lists fused by reciprocal rank; score is that of the first list with the document."""
    rows = None
    for n, part in enumerate(lists):
        part = part.select("query_id", "doc_id", "score", F.col("rank").alias("place"), F.lit(n).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    whole = rows.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (R.RRF_K + F.col("place"))).alias("sum"), F.min(F.struct("list", "place")).alias("seen"), F.min_by("score", F.struct("list", "place")).alias("score"))
    return R.top(whole, k, F.round("sum", 9).desc(), "seen", "doc_id").select("query_id", "rank", "doc_id", "score", F.round("sum", 6).alias("rrf_score"))


def reranked(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """candidates (query_id, rank, doc_id, …) in order of rerank_score from scores (query_id, doc_id, rerank_score), to four places; ties keep their order, and what has no score comes last."""
    rows = candidates.withColumnRenamed("rank", "before").join(scores, ["query_id", "doc_id"], "left").withColumn("rerank_score", F.round("rerank_score", 4))
    return R.top(rows, k, F.desc_nulls_last("rerank_score"), "before").drop("before")


def top_scores(ranked: DataFrame) -> DataFrame:
    """(query_id, vector_top_score): the score of the first of each list."""
    return ranked.where("rank = 1").select("query_id", F.col("score").alias("vector_top_score"))


def hybrid(queries: DataFrame, vector: Search, keyword: Search, k: int, widen: int = WIDEN, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score, rrf_score, vector_top_score): the k best of `widen` results of each side, fused, and reranked if `rerank` gives scores for candidates.

    vector_top_score is of the vector list before it is fused, null where that is empty.
    """
    near = shared.written(vector(queries, widen), "vector-list")  # it is read twice
    found = fused([near, keyword(queries, widen)], widen if rerank else k)
    if rerank:
        found = reranked(found, rerank(found), k)
    return found.join(top_scores(near), "query_id", "left")


def search(queries: DataFrame, mode: str, vector: Search, keyword: Search, k: int) -> DataFrame:
    """(query_id, mode, rank, doc_id, score) by mode; an unknown mode is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}; one of {', '.join(sorted(MODES))}")
    if mode == "hybrid":
        found = hybrid(queries, vector, keyword, k)
    else:
        found = (vector if mode == "vector" else keyword)(queries, k)
    return found.select("query_id", F.lit(mode).alias("mode"), "rank", "doc_id", "score")


def merged(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the best score of each document over the lists of two rewrites of a query; ties in order of first appearance."""
    rows = first.select("*", F.lit(0).alias("list")).unionByName(second.select("*", F.lit(1).alias("list")))
    best = rows.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    return R.top(best, k, F.desc("score"), "seen", "doc_id").select("query_id", "rank", "doc_id", "score")
