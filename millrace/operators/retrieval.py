"""Keyword index and search, vector search, and fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import shared
from .lines import settled

K1, B, RRF_K = 1.5, 0.75, 60
#: Terms of all queries together that go to every worker.
MOST_ASKED = 200_000
#: Cells (document, query) that a worker scores at a time, and tokens that it counts: a posting is repeated for every query that asks for its term.
CELLS, TOKENS = 1 << 17, 1 << 18


def _posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch["tokens"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + TOKENS, "right")))
            part, lo = batch.slice(lo, hi - lo), hi
            tokens = part["tokens"]
            size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int32)
            coded = pc.list_flatten(tokens).dictionary_encode()
            n = max(1, len(coded.dictionary))
            pairs, counts = np.unique(np.repeat(np.arange(len(size)), size) * n + coded.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(size) + 1) * n).astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(pairs % n)))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(size), terms, pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))], ["doc_id", "size", "terms", "counts"])


def build_index(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """The keyword index of docs (doc_id, text), written as a table: doc_id, size (tokens), and its distinct terms with their counts. Texts are tokenised here and nowhere else."""
    tokens = docs.select("doc_id", T.tokens(F.col("text"), stemmed).alias("tokens"))
    return shared.written(tokens.mapInArrow(_posting_lists, "doc_id long, size int, terms array<string>, counts array<int>"), "keyword-index")


def build_terms(docs: DataFrame, stemmed: bool = True) -> DataFrame:
    """doc_id, size and distinct terms of an index, for what needs no counts: written as a table without a Python worker."""
    rows = settled(docs.select("doc_id", T.tokens(F.col("text"), stemmed).alias("tokens")), "tokens")
    return shared.written(rows.select("doc_id", F.size("tokens").alias("size"), F.array_distinct("tokens").alias("terms")), "terms")


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: n_docs and avg_len; documents without terms count."""
    return index.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_len"))


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, df): how many documents hold each term."""
    return index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln(1 + (n_docs - df + 0.5) / (df + 0.5))


def top(scored: DataFrame, k: int, *order: Column | str, by: str = "query_id") -> DataFrame:
    """The first k rows of each `by`, with their rank from 1."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def asked_terms(queries: DataFrame, stemmed: bool = True) -> DataFrame:
    """(query_id, term): the distinct tokens of queries (query_id, text)."""
    rows = queries.select("query_id", F.explode_outer(F.array_distinct(T.tokens(F.col("text"), stemmed))).alias("term"))
    return rows.where("term is not null")


class _Best:
    """The k best documents of each query so far, ties by id: what one task keeps and gives away at its end."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.zeros(queries)
        self.query, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """Scores (document, query); only those above 0 count."""
        d, q = np.nonzero((scores > 0) & (scores >= self.least))
        query, score, doc = np.append(self.query, q), np.append(self.score, scores[d, q]), np.append(self.doc, docs[d])
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.score, self.doc = query[kept], score[kept], doc[kept]
        last = place[kept] == self.k - 1
        self.least[self.query[last]] = self.score[last]


def _scores(index: DataFrame, asked: pd.DataFrame, k: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query_id, doc_id, score) of the k best documents of each query in each task. asked is (query_id, term, weight); a term adds its weight times part(count, size)."""
    terms, at = np.unique(asked["term"].to_numpy(str), return_inverse=True)
    ids, query = np.unique(asked["query_id"].to_numpy(np.int64), return_inverse=True)
    order = np.argsort(at, kind="stable")
    query, weight, starts = query[order], asked["weight"].to_numpy(float)[order], np.searchsorted(at[order], np.arange(len(terms) + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best = pa.array(terms.tolist(), pa.string()), _Best(len(ids), k)
        rows_each = max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for lo in range(0, batch.num_rows, rows_each):
                rows = batch.slice(lo, rows_each)
                held = pc.list_flatten(rows["terms"])
                found = pc.index_in(held.cast(pa.string()), known)
                hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                term, row = found.to_numpy(zero_copy_only=False)[hit].astype(np.int64), pc.list_parent_indices(rows["terms"]).to_numpy()[hit]
                value = part(pc.list_flatten(rows["counts"]).to_numpy()[hit], rows["size"].to_numpy()[row])
                # Each posting once for every query that asks for its term.
                n = starts[term + 1] - starts[term]
                ends = np.cumsum(n)
                each = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[term] - ends + n, n)
                cells = np.repeat(row, n) * len(ids) + query[each]
                scores = np.bincount(cells, np.repeat(value, n) * weight[each], rows.num_rows * len(ids)).reshape(rows.num_rows, len(ids))
                best.add(np.round(scores, 9), rows["doc_id"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.doc), pa.array(best.score)], ["query_id", "doc_id", "score"])

    return index.where("doc_id is not null").mapInArrow(score, "query_id long, doc_id long, score double")


def bm25_search(index: DataFrame, queries: DataFrame, k: int, stemmed: bool = True) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of the index for each of queries (query_id, text); ties by doc_id.

    Up to MOST_ASKED terms of all queries go to the workers, which score documents where they lie and give away k rows of
    a query each. Beyond that, postings are joined with the queries by term.
    """
    asked = asked_terms(queries, stemmed)
    stats = corpus_stats(index)
    if asked.count() > MOST_ASKED:
        return _bm25_by_join(index, asked, stats, k)
    found, total = asked.toPandas(), stats.first()
    wanted = index.sparkSession.createDataFrame([(t,) for t in sorted(set(found["term"]))], "term string")
    df = {r["term"]: r["df"] for r in index.select(F.explode("terms").alias("term")).join(F.broadcast(wanted), "term").groupBy("term").agg(F.count("*").alias("df")).collect()}
    n, mean = total["n_docs"], total["avg_len"] or 1.0
    found["weight"] = [float(np.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))) for t in found["term"]]
    scored = _scores(index, found, k, lambda tf, size: tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)))
    return top(scored, k, F.desc("score"), "doc_id").select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def _bm25_by_join(index: DataFrame, asked: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    postings = index.select("doc_id", "size", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("doc_id", "size", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf"))
    weights = document_frequency(index).crossJoin(F.broadcast(stats)).select("term", "avg_len", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avg_len")))
    parts = postings.join(asked.join(weights, "term"), "term").select("query_id", "doc_id", part.alias("part"))
    scored = parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")).where("score > 0")
    return top(scored, k, F.round("score", 9).desc(), "doc_id").select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, stemmed: bool = True) -> DataFrame:
    """bm25_search in an index of docs (doc_id, text) that is built for it."""
    return bm25_search(build_index(docs, stemmed), queries, k, stemmed)


def overlap_search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents of the index (of unstemmed terms) that hold most of a query's distinct tokens, as a share; ties by doc_id."""
    asked = asked_terms(queries, False)
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    if asked.count() > MOST_ASKED:
        held = index.select("doc_id", F.explode("terms").alias("term"))
        scored = held.join(asked, "term").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score"))
    else:
        scored = _scores(index, asked.toPandas().assign(weight=1.0), k, lambda tf, size: np.ones(len(tf)))
    scored = scored.join(sizes, "query_id").withColumn("score", F.round(F.col("score") / F.col("n"), 6))
    return top(scored, k, F.desc("score"), "doc_id").select("query_id", "rank", "doc_id", "score")


def overlap(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """overlap_search in an index of docs (doc_id, text) that is built for it."""
    return overlap_search(build_index(docs, False), queries, k)


def rrf(ranked: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """(query_id, rank, doc_id, score): lists of (query_id, rank, doc_id) fused by the sum of 1 / (constant + rank); ties in order of first appearance."""
    rows = None
    for n, part in enumerate(ranked):
        part = part.select("query_id", "doc_id", "rank", F.lit(n).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), F.min(F.struct("list", F.col("rank").alias("first"))).alias("seen"))
    return top(fused, k, F.round("score", 9).desc(), "seen", "doc_id").select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def merge_best(rows: DataFrame, k: int) -> DataFrame:
    """The best score of each (query_id, doc_id) over several passes; the k best of each query."""
    best = rows.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.count("*").alias("passes"))
    return top(best, k, F.desc("score"), "doc_id").select("query_id", "rank", "doc_id", "score", "passes")


#: Queries and vectors of a block: few queries with many vectors, as each pair gives k rows of a query.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192


def _packed(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, vec) to blocks of up to `rows` vectors, over the bounds of batches."""

    def block(ids: list[np.ndarray], vecs: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).tobytes()]), pa.array([np.concatenate(vecs).tobytes()])], ["ids", "vecs"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, n = [], [], 0
        for batch in batches:
            known, lo = batch.filter(pc.is_valid(batch["vec"])), 0
            while lo < known.num_rows:
                part = known.slice(lo, rows - n)
                ids.append(part["id"].to_numpy().astype("<i8"))
                vecs.append(part["vec"].flatten().to_numpy(zero_copy_only=False).astype("<f8"))
                lo, n = lo + part.num_rows, n + part.num_rows
                if n == rows:
                    yield block(ids, vecs)
                    ids, vecs, n = [], [], 0
        if n:
            yield block(ids, vecs)

    return pack


def vector_blocks(vectors: DataFrame) -> DataFrame:
    """The vectors (id, vec) packed into blocks, written as a table: what they are made from is found once, not for every pair of blocks. All vectors must have one length."""
    return shared.written(vectors.mapInArrow(_packed(VECTOR_BLOCK), "ids binary, vecs binary"), "vector-blocks")


def _nearest(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (row, column) of the k largest of each row, and of all that equal the last of them; NaN is the largest, as in SQL."""
    order = np.where(np.isnan(score), np.inf, score)
    if order.shape[1] > k:
        least = np.partition(order, order.shape[1] - k, axis=1)[:, order.shape[1] - k, None]
        row, column = np.nonzero(order >= least)
    else:
        row, column = np.nonzero(np.ones(order.shape, bool))
    by = np.lexsort((ids[column], -order[row, column], row))
    row, column = row[by], column[by]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept]


def vector_search(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of vector_blocks with the largest dot product for each of queries (id, vec); ties by id.

    A block of queries meets a block of vectors in matrix products of 64 queries, and only k rows of each query leave it.
    A worker holds one Arrow batch of pairs, which Spark bounds, and one product.
    """
    asked = shared.written(queries.mapInArrow(_packed(QUERY_BLOCK), "ids binary, vecs binary"), "query-blocks")
    pairs = blocks.crossJoin(asked.select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = lambda batch, name, at, kind: np.frombuffer(batch[name][at].as_buffer(), kind)
        for batch in batches:
            for at in range(batch.num_rows):
                qi, vi = values(batch, "q_ids", at, "<i8"), values(batch, "ids", at, "<i8")
                q, v = values(batch, "q_vecs", at, "<f8").reshape(len(qi), -1), values(batch, "vecs", at, "<f8").reshape(len(vi), -1).T
                for lo in range(0, len(qi), 64):
                    score = np.round(q[lo : lo + 64] @ v, 9)
                    row, column = _nearest(score, vi, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qi[lo + row]), pa.array(vi[column]), pa.array(score[row, column])], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(best, "query_id long, vec_id long, score double")
    return top(found, k, F.desc("score"), "vec_id").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def vector_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vector_search in blocks of vectors (id, vec) that are packed for it."""
    return vector_search(vector_blocks(vectors), queries, k)


def index_embeddings(index: DataFrame) -> DataFrame:
    """(id, vec): providers.embed of the texts of an index of stemmed terms, from its terms and counts; each term of a batch is hashed once, and no text is tokenised again."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                coded = pc.list_flatten(part["terms"]).dictionary_encode()
                digit = np.array([int(md5(t.encode()).hexdigest()[0], 16) for t in coded.dictionary.to_pylist()], np.int64)
                cell = pc.list_parent_indices(part["terms"]).to_numpy().astype(np.int64) * 16 + digit[coded.indices.to_numpy()]
                counts = np.bincount(cell, pc.list_flatten(part["counts"]).to_numpy(), part.num_rows * 16).astype(float).reshape(-1, 16)  # integers where nothing is counted
                size = np.sqrt((counts * counts).sum(1, keepdims=True))
                unit = np.divide(counts, size, out=counts, where=size > 0)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * 16), pa.array(unit.ravel()))], ["id", "vec"])

    return index.where("doc_id is not null").select("doc_id", "terms", "counts").mapInArrow(embed, "id long, vec array<double>")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of one length; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
