"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a row of frames of ids (little-endian, 16 bits each if the vocabulary allows, else 32), each a whole number of
documents and compressed on its own; then a skippable frame with the document index; then the seek table of the public
seekable format: a skippable frame with the compressed size, the decompressed size and a checksum of every frame (the
low 32 bits of the xxhash64 of its content), and a footer. A reader takes the footer, the table and the index from the
end, and then decompresses only the frames of the documents asked for.

Documents stand in ascending order of doc_id, null first, rows with equal ids by the hash of their text; rows equal in
both may be parted into several files. A null or empty text is the end id alone. Extra columns don't enter, and an empty
table makes no file. Each task writes a file of its own under a name that no other attempt uses; only files named
in the manifest, which is written when all are complete, are ever read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, tokens

# Fixed values of the seekable format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX = 0x184D2A5E, 0x184D2A50
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_IDS = 1 << 16
_INDEX = np.dtype([("doc", "<i8"), ("known", "u1"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])


class Writer:
    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.zstd = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        self.parts: list[bytes] = []
        self.held = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int, int]] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.index.append((doc or 0, doc is not None, len(self.frames), self.held, len(ids)))
        self.parts.append(ids.astype(f"<u{self.width}", copy=False).tobytes())
        self.held += len(ids)
        if self.held >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if self.parts:
            raw = b"".join(self.parts)
            packed = self.zstd.compress(raw)
            self.sink.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        index = self.zstd.compress(np.array(self.index, _INDEX).tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index) + 5) + index + struct.pack("<IB", len(index), self.width))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class Reader:
    """Reads documents by their place in the file; a frame is checked against the seek table when it is decompressed."""

    def __init__(self, source):
        self.source, self.size = source, source.size()
        n, flags, magic = struct.unpack("<IBI", self._read(self.size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        table = self.size - 9 - 12 * n
        self.frames = np.frombuffer(self._read(table, 12 * n), np.dtype([("packed", "<u4"), ("raw", "<u4"), ("sum", "<u4")]))
        self.starts = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        length, self.width = struct.unpack("<IB", self._read(table - 13, 5))
        self.zstd = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.zstd.decompress(self._read(table - 13 - length, length)), _INDEX) if length else np.zeros(0, _INDEX)
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            raw = self.zstd.decompress(self._read(int(self.starts[k]), int(self.frames["packed"][k])))
            if len(raw) != self.frames["raw"][k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames["sum"][k]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, np.frombuffer(raw, f"<u{self.width}"))
        return self.last[1]

    def documents(self, places: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the documents at these places, or of all."""
        for k in range(len(self.index)) if places is None else places:
            doc, known, frame, at, n = self.index[k].tolist()
            yield (doc if known else None), self.frame(frame)[at : at + n]

    def find(self, doc: int) -> list[int]:
        known = np.flatnonzero(self.index["known"])
        ids = self.index["doc"][known]
        return known[np.searchsorted(ids, doc, "left") : np.searchsorted(ids, doc, "right")].tolist()


def write_tokens(docs: DataFrame, path: str = tokens.VOCABULARY, end: int = tokens.END) -> DataFrame:
    """Write the ids of docs (doc_id, text) and return the manifest: file, docs, ids and start (ids in files before it), in order of shard."""
    spark = docs.sparkSession
    folder = shared.new_folder(spark, "tokens")
    width = tokens.width(path, end)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shared.file_system(folder)
        name, n_docs, n_ids, writer, sink = f"{root}/{uuid.uuid4().hex}.ids.zst", 0, 0, None, None
        for part, ids, starts in tokens.encoded(batches, path, end):
            if writer is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(name, compression=None)
                writer = Writer(sink, width)
            ids = ids.astype(f"<u{width}")
            for doc, lo, hi in zip(part["doc_id"].to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                writer.add(doc, ids[lo:hi])
            n_docs, n_ids = n_docs + part.num_rows, n_ids + len(ids)
        if writer is not None:
            writer.close()
            sink.close()
            file = f"{folder}/{name.rpartition('/')[2]}"
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([file]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["shard", "file", "docs", "ids"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranges of equal ids are cut by text, and rows equal in both by the partition they come from.
    order = ["doc_id", F.xxhash64("text"), "part"]
    rows = docs.select("doc_id", "text", F.spark_partition_id().alias("part")).repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = shared.written(rows.mapInArrow(write, "shard long, file string, docs long, ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) of every document in the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist()):
                fs, name = shared.file_system(file)
                with fs.open_input_file(name) as source:
                    held: list[tuple[int | None, int, bytes]] = []
                    for doc, ids in Reader(source).documents():
                        held.append((doc, start, ids.astype("<u4").tobytes()))
                        start += len(ids)
                        if len(held) == 1000:
                            yield _batch(held)
                            held = []
                    if held:
                        yield _batch(held)

    def _batch(rows: list) -> pa.RecordBatch:
        doc, start, ids = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(read, "doc_id long, start long, ids binary")
