"""Tables and logs that a run reads, creates, appends to and goes on with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Vector tables by kind of embedding, and their dimensions.
COLLECTIONS = {"local": ("chunks_local", 384), "hosted": ("chunks_hosted", 1024)}
CACHE = "normalized_question string, question string, embedding array<float>, answer string, language string, sources array<string>"
TOKENS = "ts string, language string, prompt_tokens long, completion_tokens long"


def collection(root: str, backend: str) -> tuple[str, int]:
    """The path and dimension of a backend's vector table; an unknown backend is an error."""
    if backend not in COLLECTIONS:
        raise ValueError(f"unknown embedding backend: {backend}; one of {', '.join(sorted(COLLECTIONS))}")
    name, size = COLLECTIONS[backend]
    return f"{root}/{name}", size


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ensure_table(spark: SparkSession, path: str, schema: str, recreate: bool = False) -> DataFrame:
    """The Parquet table at path, made empty if it is missing or to be made anew."""
    if recreate or not _exists(spark, path):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log; characters beyond ASCII stay as they are."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of a JSON-lines log; blank lines are passed over, and a log that isn't there yet has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("e")).select("e.*")


def log_tokens(answered: DataFrame, path: str) -> None:
    """Append an event (TOKENS) for each of answered (language, prompt_tokens, completion_tokens) that has both counts."""
    rows = answered.where("prompt_tokens is not null and completion_tokens is not null")
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    append_json(rows.select(now.alias("ts"), "language", F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.col("completion_tokens").cast("long").alias("completion_tokens")), path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each element of a file with one JSON array."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def literal_items(spark: SparkSession, questions: dict[str, list[str]], kind: str, start: int = 1) -> DataFrame:
    """(id, language, type, question): questions by language as items, numbered on in order of language."""
    rows = [(f"q{start + n:03d}", language, kind, text) for n, (language, text) in enumerate((lang, t) for lang in questions for t in questions[lang])]
    return spark.createDataFrame(rows, "id string, language string, type string, question string")


def resume(items: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], schema: str, batches: int = 8) -> DataFrame:
    """Do `work` on the items whose key the results at path don't have, in batches whose rows are appended as each ends; all results. A run that is broken off and begun again goes on where it was."""
    spark = items.sparkSession
    for n in range(batches):
        done = ensure_table(spark, path, schema).select(key)
        part = items.where(F.pmod(F.xxhash64(key), F.lit(batches)) == n).join(done, key, "left_anti")
        work(part).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
