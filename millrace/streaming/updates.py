"""Streams: documents that arrive and replace their chunks, and the request log by the hour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluation import replace_document
from . import versions


def upsert_stream(arriving: DataFrame, table: str, attribute: str, make: Callable[[DataFrame], DataFrame], checkpoint: str, keep: int = 2, **trigger: object) -> StreamingQuery:
    """For each micro-batch, make(batch) replaces the rows of the table at `table` that share its values of `attribute`.

    A batch reads and writes only the buckets that its values fall into, as a new version of these, which counts once
    Spark has marked it complete; so a batch that is run again, or fails half-way, leaves a whole table. Buckets that
    `keep` later versions have replaced are deleted. `versions.read` reads the table.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark, new = batch.sparkSession, make(batch).persist()
        try:
            touched = [r[0] for r in new.select(versions.bucket(attribute)).distinct().collect()]  # at most BUCKETS
            if touched:
                schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
                old = versions.read(spark, table, schema, number, touched)
                versions.publish(replace_document(old, new, attribute)[0], table, attribute, number)
                versions.expire(spark, table, keep)
        finally:
            new.unpersist()

    return arriving.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def hourly_usage(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests and tokens by hour and language of a log (ts, language, prompt_tokens, completion_tokens); rows later than `late` are left out when it streams. An extension: there is no such window in what this engine's queries come from."""
    if log.isStreaming:
        log = log.withWatermark("ts", late)
    return log.groupBy(F.window("ts", "1 hour"), "language").agg(F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
