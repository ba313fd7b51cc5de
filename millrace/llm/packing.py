"""Packing documents into sequences of a fixed number of tokens by first-fit decreasing.

A document of more than `capacity` ids is cut into full pieces and a rest. Rows are dealt into groups by a hash of their
id, text and input partition; within a group, the pieces go, longest first, each into the first bin that has room. A
tournament tree over the bins' free room finds that bin in a number of steps logarithmic in their number. Bins of a group
are its sequences.

A null or empty text is the end id alone. Rows with equal ids are documents of their own. Groups differ in nothing but
their members, so a source or a set of copies of any size is spread over many of them: even rows equal in id and text
meet only if one input partition holds them. A task packs GROUP_BYTES of a group at a time, so however many rows fall into
one, its memory is bounded. Extra columns don't enter, and an empty table has no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from . import tokens

CAPACITY = 4096
#: Documents of a group, on average.
GROUP_ROWS = 1500
#: Bytes of ids that are packed together at most, but for a single longer document.
GROUP_BYTES = 24 << 20
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class TournamentTree:
    """The free room of bins; each inner node has the most of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """Put size into the first bin with room for it; the bin, and its room before."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had, found = room[at], at - self.leaves
        room[at] = had - size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of every piece; sizes are 1 to capacity. Pieces of equal size keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = TournamentTree(len(sizes), capacity)
    for k in np.argsort(-sizes, kind="stable").tolist():
        bins[k], had = tree.take(int(sizes[k]))
        offsets[k] = capacity - had
    return bins, offsets


def _pack_rows(held: list[pa.RecordBatch], first_bin: int, capacity: int, width: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of these rows (doc_id, ids) in bins from first_bin on, and the bin after the last."""
    rows = pa.Table.from_batches(held).combine_chunks()
    data, offsets = T.text_bytes(rows["ids"].combine_chunks())
    ids, begin = data.view(f"<u{width}").astype("<u4"), offsets // width
    total = np.diff(begin)
    parts = -(-total // capacity)  # every document has its end id, so at least one
    doc = np.repeat(np.arange(len(total)), parts)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
    size = np.minimum(total[doc] - start, capacity)
    bins, offset = first_fit_decreasing(size, capacity)
    columns = [rows["doc_id"].combine_chunks().take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(total[doc]), pa.array(bins + first_bin), pa.array(offset), tokens.binary(ids, np.append(begin[doc] + start, begin[-1]))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]), first_bin + int(bins.max()) + 1


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = tokens.VOCABULARY, seed: int = 7) -> DataFrame:
    """A row for each piece of each document of docs (doc_id, text): where it begins in its document and in which sequence, and its ids (little-endian unsigned 32-bit)."""
    groups, width = max(1, round(docs.count() / GROUP_ROWS)), tokens.width(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, starts in tokens.encoded(batches, path):
            yield pa.RecordBatch.from_arrays([part["grp"], part["doc_id"], tokens.binary(ids.astype(f"<u{width}"), starts)], ["grp", "doc_id", "ids"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, size, bin_ = None, [], 0, 0
        for batch in batches:
            for part in T.slices(iter([batch]), "ids", GROUP_BYTES // 4):
                grp = np.asarray(part["grp"])
                bounds = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
                for lo, hi in zip(bounds, bounds[1:]):
                    if held and (grp[lo] != group or size > GROUP_BYTES):
                        out, bin_ = _pack_rows(held, bin_, capacity, width)
                        yield out
                        held, size = [], 0
                    if grp[lo] != group:
                        group, bin_ = grp[lo], int(grp[lo]) << 32
                    rows = part.slice(lo, hi - lo).select(["doc_id", "ids"])
                    held, size = [*held, rows], size + rows["ids"].nbytes
        if held:
            yield _pack_rows(held, bin_, capacity, width)[0]

    order = F.xxhash64(F.lit(seed), "doc_id", "text", F.spark_partition_id())
    coded = docs.select(F.pmod(order, F.lit(groups)).alias("grp"), "doc_id", "text").mapInArrow(encode, "grp long, doc_id long, ids binary")
    n = min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return coded.repartition(n, "grp").sortWithinPartitions("grp", "doc_id", F.crc32("ids")).mapInArrow(fill, SCHEMA)
