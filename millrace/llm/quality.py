"""Quality rules: a hashed n-gram likelihood ratio between a trusted corpus and the raw corpus.

Texts are cut into runs of word characters and runs of punctuation. Runs and pairs of neighbouring runs (a run after its
like is one n-gram, whatever it repeats) are hashed to BUCKETS counters, once over the trusted rows and once over all rows. The trusted multinomial is smoothed towards the
raw one, so that what neither corpus has seen weighs nothing. A text's score is the mean log ratio of its n-grams; it
passes if that reaches a fixed threshold.

Nulls are empty texts; a text without n-grams scores 0. Repeated rows are scored alike. Without trusted rows every
score is 0, so only the base rules reject. Other columns of the input never enter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .jaccard_join import of_ids

BUCKETS = 1 << 14
#: Raw pseudo-counts for each bucket of the trusted model.
PRIOR = 2.0
#: Mean log ratio from which a text passes.
THRESHOLD = -0.3
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"

#: The n-gram of any run that follows its like.
_REPEATED = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_KIND = np.full(256, 2, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1


def _buckets(scan: T.Scan) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the row of every n-gram."""
    runs = scan.runs(_KIND[scan.data])
    pairs, at = runs.windows(2)
    pairs[runs.hash[at] == runs.hash[at + 1]] = _REPEATED
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (np.concatenate([runs.hash, pairs]) >> shift).astype(np.int64), np.concatenate([runs.row, runs.row[at]])


def ngram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all buckets over all rows. The driver receives BUCKETS rows whatever the size of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, np.int64)
        for part in T.slices(batches, "text"):
            found += np.bincount(_buckets(T.scan(part["text"]))[0], minlength=BUCKETS)
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(found[seen])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS)
    counts[rows["bucket"]] = rows["n"]
    return counts


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log(trusted / raw) of each bucket; the trusted counts get `prior` pseudo-counts a bucket, dealt out as the raw corpus is."""
    q = (raw + 1) / (raw.sum() + len(raw))
    mass = prior * len(raw)
    return np.log((target + mass * q) / (target.sum() + mass) / q)


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text of all rows of docs whose id has label quality 1."""
    return of_ids(docs, labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct())


def _repeats(words: T.Runs, k: int) -> np.ndarray:
    """For each row, how many of its words lie in a window of k words that the row has twice or more."""
    hashes, at = words.windows(k)
    rows = words.row[at]
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(h) else np.zeros(0, bool)
    first = at[order][twice]
    cover = np.zeros(len(words.row) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + k, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(words.row[covered], minlength=len(words.count))


def _dup_lines(scan: T.Scan, words: T.Runs) -> np.ndarray:
    """For each row, how many of its lines hold a word and equal an earlier line."""
    breaks = np.flatnonzero(scan.data == 10)
    start = np.sort(np.concatenate([scan.offsets[:-1], breaks + 1]))
    stop = np.sort(np.concatenate([scan.offsets[1:], breaks]))
    holds = np.searchsorted(words.start, stop) > np.searchsorted(words.start, start)
    start, stop = start[holds], stop[holds]
    row = np.searchsorted(scan.offsets, start, side="right") - 1
    hashes = scan.hashes(start, stop)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    again = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    return np.bincount(r[1:][again], minlength=scan.rows)


def assess(text: pa.Array, weights: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of each text, by name."""
    scan = T.scan(text)
    words = T.words(scan)
    bucket, row = _buckets(scan)
    count = np.bincount(row, minlength=scan.rows)
    score = np.bincount(row, weights[bucket], scan.rows) / np.maximum(count, 1)
    point = (scan.data & 0xC0) != 0x80
    repeat = _repeats(words, REPEAT_WINDOW)
    failed = (words.count < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words.count)
    return {
        "n_words": words.count, "word_chars": scan.per_row(point & (_KIND[scan.data] != 0)), "n_symbols": scan.per_row(_SYMBOL[scan.data]), "n_dup_lines": _dup_lines(scan, words),
        "n_repeat_words": repeat, "base_failed": failed, "kept": ~failed & (score >= THRESHOLD), "score": score,
    }


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of each bucket, from all of docs and the trusted rows of labels."""
    return log_ratios(ngram_counts(docs), ngram_counts(trusted_rows(docs, labels)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures and verdict for every row of docs (doc_id, text)."""
    weights = fit(docs, labels)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            found = assess(part["text"], weights)
            yield pa.RecordBatch.from_arrays([part["doc_id"], *map(pa.array, found.values())], ["doc_id", *found])

    return docs.select("doc_id", "text").mapInArrow(apply, SCHEMA)


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    weights = fit(docs, labels)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            yield part.filter(pa.array(assess(part.column(part.schema.get_field_index("text")), weights)["kept"]))

    return docs.mapInArrow(apply, docs.schema)
