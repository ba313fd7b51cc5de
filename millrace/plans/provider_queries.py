"""Queries over columns of offline providers, and updates by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import providers as P
from ..functions import text as T
from ..sources.tables import spread, table
from .registry import query

_COUNTS = f"list_transform(string_split('0 1 2 3 4 5 6 7 8 9 a b c d e f', ' '), lambda d: len(list_filter(list_transform({T.sql_tokens('text')}, lambda t: left(md5(t), 1)), lambda x: x = d))::DOUBLE)"


@query(f"SELECT doc_id, round(v[1] / n, 6) AS first, round(v[16] / n, 6) AS last, round(list_max(v) / n, 6) AS most FROM (SELECT doc_id, v, CASE WHEN list_sum(v) = 0 THEN 1 ELSE sqrt(list_sum(list_transform(v, lambda x: x * x))) END AS n FROM (SELECT doc_id, {_COUNTS} AS v FROM documents))")
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.embed(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    part = lambda x: F.round(x, 6)
    return rows.select("doc_id", part(F.col("embedding")[0]).alias("first"), part(F.col("embedding")[15]).alias("last"), part(F.array_max("embedding")).alias("most"))


@query("SELECT lang, sum(ceil(length(text) * CASE lang WHEN 'es' THEN 38.67::DOUBLE ELSE 21.02::DOUBLE END / 100))::BIGINT AS tokens, count(*) AS n FROM documents GROUP BY lang")
def estimated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish stands for Arabic, which the tables lack."""
    language = F.when(F.col("lang") == "es", "ar").otherwise(F.col("lang"))
    rows = table(spark, sf_dir, "documents").select("lang", P.estimated_tokens(F.col("text"), language).alias("t"))
    return rows.groupBy("lang").agg(F.sum("t").alias("tokens"), F.count("*").alias("n"))


@query(f"""
    SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
    FROM (SELECT doc_id, sha1(unhex('{P.URL_SPACE}') || encode('c' || doc_id)) AS h FROM documents)
""")
def name_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.uuid5(F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("uuid"))
