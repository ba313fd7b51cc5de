"""Queries that write tables and logs to the shared folder and read them back, and parts of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import providers as P
from ..functions import text as T
from ..operators import chunking as C
from ..sources import corpus, shared, sinks
from ..sources.tables import spread, table
from .registry import query
from .text_queries import _FIXED


@query(f"""
    WITH c AS (SELECT doc_id, lang, source, i - 1 AS k, c FROM (SELECT doc_id, lang, source, generate_subscripts({_FIXED}, 1) AS i, unnest({_FIXED}) AS c FROM documents) WHERE {T.sql_strip('c')} <> '')
    SELECT format('{{}}_{{:03d}}', doc_id, k) AS chunk_id, doc_id::VARCHAR AS doc_id, k::INT AS chunk_index, lang AS language, source AS topic, 'fixed' AS strategy, length(c)::INT AS char_count, ceil(length(c) * 21.02::DOUBLE / 100)::INT AS token_count, md5(c) AS digest FROM c
""")
def chunk_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk records written as JSON lines and read back."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    chunks = C.chunks(docs, "fixed").join(docs.select("doc_id", "lang", "source"), "doc_id")
    file = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".html"))
    rows = chunks.select(
        C.chunk_id(F.col("doc_id").cast("string"), F.col("chunk_index")).alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "chunk_index", "text", F.col("lang").alias("language"), F.col("source").alias("topic"), file.alias("source_file"), corpus.path_format(file).alias("source_format"),
        F.lit("fixed").alias("strategy"), F.length("text").alias("char_count"), P.estimated_tokens(F.col("text"), F.lit("en")).alias("token_count"),
    )
    path = shared.new_folder(spark, "chunks")
    corpus.write_chunks(rows, path)
    return corpus.read_chunks(spark, path).select("chunk_id", "doc_id", "chunk_index", "language", "topic", "strategy", "char_count", "token_count", F.md5("text").alias("digest"))


@query("""
    WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'faq/AR/' WHEN 1 THEN 'en/' WHEN 2 THEN 'Ar/en/' ELSE 'other/' END || CASE doc_id % 5 WHEN 0 THEN '.hidden' WHEN 1 THEN 'my_Empty_page.' ELSE 'page.' END || doc_id || CASE doc_id % 3 WHEN 0 THEN '.HTML' WHEN 1 THEN '.docx' ELSE '' END AS path FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'en' WHEN 3 THEN 'unknown' ELSE 'ar' END AS language, CASE doc_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'docx' ELSE CASE doc_id % 5 WHEN 0 THEN 'hidden' || doc_id ELSE doc_id::VARCHAR END END AS format,
        CASE WHEN doc_id % 3 < 2 THEN regexp_extract(path, '([^/]+)\\.[a-zA-Z]+$', 1) ELSE CASE doc_id % 5 WHEN 0 THEN '.hidden' || doc_id WHEN 1 THEN 'my_Empty_page' ELSE 'page' END END AS topic, doc_id % 5 > 1 AS is_read FROM p
""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    folder = F.when(i % 4 == 0, "faq/AR/").when(i % 4 == 1, "en/").when(i % 4 == 2, "Ar/en/").otherwise("other/")
    name = F.when(i % 5 == 0, ".hidden").when(i % 5 == 1, "my_Empty_page.").otherwise("page.")
    path = F.concat(folder, name, i.cast("string"), F.when(i % 3 == 0, ".HTML").when(i % 3 == 1, ".docx").otherwise(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    path = F.col("path")
    return rows.select("doc_id", corpus.path_language(path).alias("language"), corpus.path_format(path).alias("format"), corpus.path_topic(path).alias("topic"), corpus.is_read(path).alias("is_read"))


@query("SELECT event_type AS language, event_id AS prompt_tokens, CASE WHEN event_id % 2 = 0 THEN user_id END AS completion_tokens, 'Größe ✓ ' || event_id AS ts FROM events")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a JSON log in two parts and read back."""
    i, path = F.col("event_id"), shared.new_folder(spark, "events")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("Größe ✓ "), i.cast("string")).alias("ts"), F.col("event_type").alias("language"), i.alias("prompt_tokens"), F.when(i % 2 == 0, F.col("user_id")).alias("completion_tokens"))
    for part in (0, 1):
        sinks.append_json(rows.where(F.col("prompt_tokens") % 2 == part), path)
    return sinks.read_log(spark, path, sinks.TOKENS)


@query("SELECT c_custkey, c_nationkey * 2 AS v FROM customer")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work whose results a first run has for some items; the second does the others alone and marks none twice."""
    path, schema = shared.new_folder(spark, "results"), "c_custkey long, v long"
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_nationkey").cast("long").alias("n"))
    work = lambda rows: rows.select("c_custkey", (F.col("n") * 2).alias("v"))
    work(items.where("c_custkey % 3 = 0")).write.parquet(path)
    return sinks.resume(items, path, "c_custkey", work, schema, batches=2)
