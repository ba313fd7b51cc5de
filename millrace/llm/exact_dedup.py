"""Exact deduplication by Grace hashing.

Each task first collapses the copies among its own rows, so a text that a third of all rows share leaves a task once for
each table it fills, not once for each row. What is left is dealt out by a hash of the text. A task then fills an
open-addressing table whose probes compare whole texts; when the distinct texts it holds exceed a byte budget, rows not
in the table go to spill files by the next four bits of their hash, and every file is handled the same way, until what
is left fits. Spill files lie in the shared folder and go when their task ends.

Null texts count as empty, and empty texts are equal. Null ids lose to others; a group with no other id keeps null.
Repeated rows are copies like any other; where several rows of a group have the id that stays, all of them are marked
kept, and `distinct_rows` returns one. Other columns, whatever their names, don't take part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textscan as T

#: Bytes of distinct text that a table holds before rows spill.
TABLE_BYTES = 24 << 20
FANOUT_BITS = 4
OUT_ROWS = 512


class ContentTable:
    """Open addressing with linear probing; a probe ends at an equal hash and equal content. Values are [hash, text, best row, rows]."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def find(self, h: int, text: bytes) -> tuple[int, int]:
        """The slot where the text is or would be, and its entry or -1."""
        slots, entries, mask = self.slots, self.entries, len(self.slots) - 1
        at = h & mask
        while (k := slots[at]) >= 0:
            entry = entries[k]
            if entry[0] == h and entry[1] == text:
                return at, k
            at = (at + 1) & mask
        return at, -1

    def add(self, at: int, h: int, text: bytes, row: tuple, n: int) -> None:
        self.slots[at] = len(self.entries)
        self.entries.append([h, text, row, n])
        self.bytes += len(text) + 64
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            for k, entry in enumerate(self.entries):
                mask, at = len(self.slots) - 1, entry[0] & (len(self.slots) - 1)
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = k

    def merge(self, h: int, text: bytes, row: tuple, n: int, room: bool = True) -> bool:
        """Count a row; False if it is new and there is no room."""
        at, k = self.find(h, text)
        if k >= 0:
            entry = self.entries[k]
            entry[3] += n
            if row[0] is not None and (entry[2][0] is None or row[0] > entry[2][0]):
                entry[2] = row
        elif room:
            self.add(at, h, text, row, n)
        return k >= 0 or room


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, tuple, int]]:
    yield from zip(batch["h"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), zip(*(batch[k].to_pylist() for k in batch.schema.names[3:])), batch["n"].to_pylist())


def _batches(entries: list[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(entries), OUT_ROWS):
        part = entries[lo : lo + OUT_ROWS]
        columns = [[e[0] for e in part], [e[1] for e in part], [e[3] for e in part], *zip(*(e[2] for e in part))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(f.type) if f.name == "text" else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def collapse(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int = TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text among those that pass while a table fills."""
    table = ContentTable()
    for batch in batches:
        for part in T.slices(iter([batch]), "text", 1 << 20):
            scan = T.scan(part["text"])
            part = part.set_column(0, "h", pa.array(scan.hashes(scan.offsets[:-1], scan.offsets[1:]).view(np.int64)))
            for row in _rows(part):
                table.merge(*row)
            if table.bytes > most:
                yield from _batches(table.entries, schema)
                table = ContentTable()
    yield from _batches(table.entries, schema)


def grace(batches: Iterator[pa.RecordBatch], folder: str, most: int = TABLE_BYTES, depth: int = 0) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of all batches."""
    table, spills, schema = ContentTable(), {}, None
    fs, root = shared.file_system(folder)
    try:
        for batch in batches:
            schema = batch.schema
            left: dict[int, list[int]] = {}
            for k, (h, text, row, n) in enumerate(_rows(batch)):
                if not table.merge(h, text, row, n, table.bytes < most):
                    left.setdefault((h >> (60 - FANOUT_BITS * depth % 60)) & ((1 << FANOUT_BITS) - 1), []).append(k)
            for bits, rows in left.items():
                if bits not in spills:
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(name := f"{root}/{uuid.uuid4().hex}", compression=None)
                    spills[bits] = (name, stream, pa.ipc.new_stream(stream, schema))
                spills[bits][2].write_batch(batch.take(pa.array(rows)))
        yield from _batches(table.entries, schema) if schema else ()
        del table
        for name, stream, writer in spills.values():
            writer.close()
            stream.close()
            with fs.open_input_stream(name) as source:
                yield from grace(pa.ipc.open_stream(source), f"{folder}/{uuid.uuid4().hex}", most, depth + 1)
    finally:
        if spills:
            for _, stream, _ in spills.values():
                stream.close()
            fs.delete_dir(root)


def distinct_texts(docs: DataFrame, payload: list[str], most: int = TABLE_BYTES) -> DataFrame:
    """(h, text, n, *payload): each distinct text, how many rows hold it, and the payload of the row with the largest first payload column."""
    rows = docs.select(F.lit(0).cast("long").alias("h"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("long").alias("n"), *payload)
    schema, folder = rows.schema, shared.new_folder(docs.sparkSession, "spill")
    arrow = pa.schema([pa.field(f.name, t) for f, t in zip(schema, _arrow_types(schema))])
    local = rows.mapInArrow(lambda batches: collapse(batches, arrow, most), schema)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return local.repartition(n, "h").mapInArrow(lambda batches: grace(batches, f"{folder}/{uuid.uuid4().hex}", most), schema)


def _arrow_types(schema) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(schema)]


def exact_groups(docs: DataFrame, most: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs (doc_id, text)."""
    groups = distinct_texts(docs, ["doc_id"], most).select(F.sha2("text", 256).alias("text_sha256"), F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    members = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return members.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def distinct_rows(docs: DataFrame, most: int = TABLE_BYTES) -> DataFrame:
    """One row of docs for each distinct text, the one with the largest doc_id, with all columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]).alias("others"), F.col("text").isNull().alias("absent"))
    rows = distinct_texts(packed, ["doc_id", "others", "absent"], most)
    back = {c: F.col(f"others.c{k}") for k, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.when(~F.col("absent"), F.col("text"))}
    return rows.select(*[back[c].alias(c) for c in docs.columns])
