"""Toxicity by class-conditional Kneser-Ney models of word pairs.

Each class has an interpolated bigram model: P(w | v) = (1 - left(v)) Q(w | v) + left(v) P(w). Pairs v w that one of the classes
keeps as its own share 1 - left(v), in Q by the class's discounted counts and, as if seen PAIR_DISCOUNT times, by those of
both classes; left(v), what discounts leave of the counts of both classes, is backoff. P(w) = kept(w) / N + free S(w), where w
counts by the number of different words that it follows in the class (its continuation count) less a discount, N is the sum
of these counts, and S is the one backoff model, of the continuation counts of both classes together. An expression is a
class's own only if its discounted rate is over RATIO times its rate in the other class; otherwise its whole count is freed,
so what is rare, and what both classes say alike, weighs as the shared counts say. Every text ends with an end mark.

A text's ratio is log P(text | toxic) - log P(text | ordinary), divided by its length in words and the end mark. A logistic
curve of this one number, rising or level, fitted on labelled rows that the models have not seen, gives the score.

Only rows of labels whose crc32(doc_id as text) mod 5 is not 0 are learnt from: all with remainders 1 to 3 for the models, all
with 4 for the curve, of which the driver gets counts by ratio and class alone. Repeated rows count as often as they stand.
Null texts are empty; a text without words has ratio 0. Without rows of both classes, ratios are 0 and the score is the
share of toxic rows, or 0 without rows. An id labelled twice is toxic if any of its labels is. Labels, lang, source and doc_id
are no inputs of a score, nor are other columns.

The model holds every expression that a class keeps. Up to MODEL_ROWS of them (and the ends of such pairs) go to the driver
and to all workers. For more, Spark computes the same ratios, and workers look them up in files of the shared folder, of
which a worker holds one at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textscan as T
from .jaccard_join import of_ids

#: Discounts of continuation counts and of pair counts; for the larger class they are larger in proportion.
WORD_DISCOUNT, PAIR_DISCOUNT = 3.0, 30.0
RATIO = 5.0
#: Bounds of the model that goes to all workers, and of a file of it: with more expressions than this, it stays in files.
MODEL_ROWS = 1_000_000
#: How many bytes of text are looked up at once where the model is in files, as each is read anew for them.
FILED_BYTES = 1 << 22
FOLDS, FIT, TUNE = 5, (1, 2, 3), (4,)
#: Ratios are counted for the curve in steps of this size, up to a bound.
STEP, BOUND = 0.0005, 4.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
#: Stands for a hash after the last word of a text, and so before the first of the next.
STOP = np.uint64(1)


class Table:
    """Values by hash, and one for all others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, other: float):
        order = np.argsort(keys)
        self.keys, self.values, self.other = keys[order], values[order], other

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), self.other)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.other)


@dataclass
class Filed:
    """A table in files of keys in order and then their values, each key in one file. One file at a time is read."""

    files: list[str]
    other: float

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        wanted, at = np.unique(keys, return_inverse=True)
        out = np.full(len(wanted), self.other)
        for file in self.files if len(wanted) else []:
            fs, name = shared.file_system(file)
            with fs.open_input_file(name) as source:
                data = source.read()
            held, values = np.frombuffer(data, "<u8", len(data) // 16), np.frombuffer(data, "<f8", offset=len(data) // 2)
            place = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
            out = np.where(held[place] == wanted, values[place], out)
        return out[at]


@dataclass
class Curve:
    """A logistic curve, rising or level, of u / (1 + |u|), where u is a ratio's distance from middle in units of spread. So no ratio, however far out, moves the curve much."""

    middle: float = 0.0
    spread: float = 0.01
    level: float = 0.0
    rise: float = 10.0

    def __call__(self, ratio: np.ndarray) -> np.ndarray:
        u = (ratio - self.middle) / self.spread
        return 1 / (1 + np.exp(-(self.level + self.rise * u / (1 + np.abs(u)))))


@dataclass
class Model:
    """Log ratios of words by themselves, and of the pairs that a class keeps (nan for others)."""

    words: Table | Filed
    pairs: Table | Filed
    curve: Curve

    @property
    def slice_bytes(self) -> int:
        """How many bytes of text to look up at once."""
        return FILED_BYTES if isinstance(self.words, Filed) else T.SLICE_BYTES


def _words(text: pa.Array) -> T.Runs:
    data, offsets = T.text_bytes(text)
    data = _LOWER[data]
    return T.Scan(data, offsets).runs(_KIND[data])


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))


def known_ids(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of labelled rows to learn from."""
    return labels.where("doc_id is not null and toxic in (0, 1)").where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def _pairs(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before (STOP at first), the word (STOP at last) and the row, at every place of every text that has words."""
    runs = _words(text)
    ends = runs.first[1:][runs.count > 0]
    word, row = np.insert(runs.hash, ends, STOP), np.insert(runs.row, ends, runs.row[ends - 1])
    return np.concatenate([[STOP], word[:-1]])[: len(word)], word, row


def _both(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return T.mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """before, word (hashes), and how often they stand together in toxic and in ordinary texts of a slice."""
    for part in T.slices(batches, "text", 1 << 20):
        before, word, row = _pairs(part["text"])
        toxic = np.asarray(part["toxic"])[row] == 1
        _, first, at = np.unique(_both(before, word), return_index=True, return_inverse=True)
        counts = [np.bincount(at[x], minlength=len(first)).astype(np.int32) for x in (toxic, ~toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(before[first].view(np.int64)), pa.array(word[first].view(np.int64)), *map(pa.array, counts)], ["before", "word", "t", "o"])


def ratios(text: pa.Array, model: Model) -> np.ndarray:
    """The log-likelihood ratio of each text, divided by its length."""
    places, start = [], 0
    for part in T.slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text"):
        before, word, row = _pairs(part["text"])
        places.append((_both(before, word), word, row + start))
        start += part.num_rows
    if not places:
        return np.zeros(0)
    pair, word, row = map(np.concatenate, zip(*places))
    out = model.pairs[pair]
    out = np.where(np.isnan(out), model.words[word], out)  # both classes leave the same part to backoff
    return np.bincount(row, out, len(text)) / np.maximum(np.bincount(row, minlength=len(text)), 1)


def score(text: pa.Array, model: Model) -> np.ndarray:
    return model.curve(ratios(text, model))


def level_curve(share: float) -> Curve:
    return Curve(level=float(np.log((share + 1e-9) / (1 - share + 1e-9))), rise=0.0)


def _median(x: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(x)
    return float(x[order][np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)])


def _split(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Where labels are best told apart: between two values, such that the fewest rows stand on the wrong side; of several such places the middle one."""
    values, at = np.unique(x, return_inverse=True)
    above, below = np.bincount(at, weight * (y == 1)), np.bincount(at, weight * (y == 0))
    wrong = np.cumsum(above)[:-1] + (below.sum() - np.cumsum(below))[:-1]  # with the border after each value but the last
    best = np.flatnonzero(wrong == wrong.min())
    k = best[len(best) // 2]
    return float(values[k] + values[k + 1]) / 2


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> Curve:
    """The curve for ratios x with labels y of both classes. Its middle is their best split, its spread a quarter of the distance of their medians; Newton's method finds the rest."""
    low, high = _median(x[y == 0], weight[y == 0]), _median(x[y == 1], weight[y == 1])
    if high <= low:
        return level_curve(np.average(y, weights=weight))
    middle, spread = _split(x, y, weight), (high - low) / 4
    u = (x - middle) / spread
    rows = np.column_stack([np.ones(len(x)), u / (1 + np.abs(u))])
    b, penalty = np.zeros(2), np.diag([0.0, ridge])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ b, -30, 30)))
        step = np.linalg.solve((rows * (weight * p * (1 - p) + 1e-9)[:, None]).T @ rows + penalty, rows.T @ (weight * (y - p)) - penalty @ b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return Curve(middle, spread, float(b[0]), float(b[1])) if b[1] >= 0 else level_curve(np.average(y, weights=weight))


def own(mine: np.ndarray, other: np.ndarray, of_mine: np.ndarray, of_other: np.ndarray, discount: float, ratio: float = RATIO) -> np.ndarray:
    """Discounted counts of the class's own expressions, 0 for all others; counts are out of of_mine and of_other."""
    times = np.where(of_other > 0, of_mine / np.maximum(of_other, 1), np.inf)
    left = mine - discount * np.maximum(np.where(np.isinf(times), 1, times), 1)
    return np.where((left > 0) & (left > ratio * np.where(other > 0, other * np.where(np.isinf(times), 0, times), 0)), left, 0.0)


@dataclass
class Counts:
    """What the driver holds: candidates for own expressions (all that a class has more often than the discounts), and sums."""

    words: pd.DataFrame  # word, nt, no, n (continuation counts in toxic, ordinary and both), t, o (plain counts)
    pairs: pd.DataFrame  # before, word, t, o
    sums: dict[str, int]  # of nt, no, n over all words
    word_discount: float = WORD_DISCOUNT
    pair_discount: float = PAIR_DISCOUNT


def combine(counts: Counts) -> Model:
    """Log ratios of the two interpolated models."""
    words, pairs, sums, word_discount, pair_discount = counts.words, counts.pairs, counts.sums, counts.word_discount, counts.pair_discount
    total = {"t": sums["nt"], "o": sums["no"]}
    # Shared backoff: continuation counts of both classes; what is not among words has ratio log(free_t / free_o) whatever its count.
    shared_part = np.maximum(words["n"].to_numpy(float) - 0.75, 0) / sums["n"]
    alone, free = {}, {}
    for c, d in (("t", "o"), ("o", "t")):
        kept = own(words[f"n{c}"].to_numpy(float), words[f"n{d}"].to_numpy(float), np.float64(total[c]), np.float64(total[d]), word_discount)
        free[c] = 1 - kept.sum() / total[c]
        alone[c] = kept / total[c] + free[c] * shared_part
    hashes = words["word"].to_numpy(np.int64).view(np.uint64)
    rest = float(np.log(free["t"]) - np.log(free["o"]))
    word_ratio = Table(hashes, np.log(alone["t"]) - np.log(alone["o"]), rest)

    place = pd.Series(np.arange(len(words)), index=words["word"])
    pairs = pairs[pairs["before"].isin(place.index) & pairs["word"].isin(place.index)]
    v, w = place[pairs["before"]].to_numpy(), place[pairs["word"]].to_numpy()
    of = {c: words[c].to_numpy(float) for c in "to"}
    kept = {c: own(pairs[c].to_numpy(float), pairs[d].to_numpy(float), of[c][v], of[d][v], pair_discount) for c, d in (("t", "o"), ("o", "t"))}
    v, w, keys, kept = *(x[(kept["t"] > 0) | (kept["o"] > 0)] for x in (v, w, _both(*(pairs[k].to_numpy(np.int64).view(np.uint64) for k in ("before", "word"))))), {c: x[(kept["t"] > 0) | (kept["o"] > 0)] for c, x in kept.items()}
    pooled = kept["t"] + kept["o"]
    per_context = lambda x: np.bincount(v, x, len(words))[v]
    left = 1 - per_context(pooled) / np.maximum(of["t"] + of["o"], 1)[v]
    after = {c: (1 - left) * (kept[c] + pair_discount * pooled / per_context(pooled)) / (per_context(kept[c]) + pair_discount) + left * alone[c][w] for c in "to"}
    return Model(word_ratio, Table(keys, np.log(after["t"]) - np.log(after["o"]), np.nan), Curve())


def expressions(docs: DataFrame, known: DataFrame, word_discount: float = WORD_DISCOUNT, pair_discount: float = PAIR_DISCOUNT) -> tuple[DataFrame, dict[str, int]]:
    """Counts over all rows of docs whose id is in known (doc_id, toxic): of all words (v is null) and pairs v w that some class may keep and of the ends of such pairs, and sums over all words."""
    rows = of_ids(docs, known).select("text", "toxic").mapInArrow(contexts, "before long, word long, t int, o int")
    pairs = rows.groupBy("word", "before").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    nt, no, none = one(F.col("t") > 0), one(F.col("o") > 0), F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    kinds = F.array(
        F.struct(F.col("word").alias("w"), none.alias("v"), nt.alias("nt"), no.alias("no"), F.lit(1).cast("long").alias("n"), F.col("t").alias("t"), F.col("o").alias("o")),
        F.when((F.col("t") > pair_discount) | (F.col("o") > pair_discount), F.struct(F.col("word").alias("w"), F.col("before").alias("v"), zero.alias("nt"), zero.alias("no"), zero.alias("n"), F.col("t").alias("t"), F.col("o").alias("o"))),
        F.struct(none.alias("w"), none.alias("v"), nt.alias("nt"), no.alias("no"), F.lit(1).cast("long").alias("n"), zero.alias("t"), zero.alias("o")),
    )
    found = pairs.select(F.explode(F.array_compact(kinds)).alias("k")).select("k.*").groupBy("w", "v").agg(*[F.sum(c).alias(c) for c in ("nt", "no", "n", "t", "o")])
    # A word that can't be its class's own may yet be a context or an end of a pair that is: those have plain counts above the pair discount.
    keep = (F.col("nt") > word_discount) | (F.col("no") > word_discount) | (F.col("t") > pair_discount) | (F.col("o") > pair_discount)
    found = shared.written(found.where(F.col("w").isNull() | F.col("v").isNotNull() | keep), "expressions")
    sums = found.where("w is null").first()
    sums = {k: (sums[k] if sums else 0) or 0 for k in ("nt", "no", "n")}
    return found, sums


def _own(found: DataFrame, sums: dict[str, int], word_discount: float, pair_discount: float) -> tuple[Column, DataFrame, int]:
    """Whether a class may keep a word, the pairs that one may keep, and the number of both."""
    words = found.where("w is not null and v is null")
    own_word = _may_keep("nt", "no", F.lit(sums["nt"] / sums["no"]), word_discount)
    ends = words.select(F.col("w").alias("v"), F.col("t").alias("vt"), F.col("o").alias("vo"))
    own_pair = found.where("v is not null").select("v", "w", "t", "o").join(ends, "v").where(_may_keep("t", "o", F.expr("try_divide(vt, vo)"), pair_discount)).select("v", "w", "t", "o")
    return own_word, own_pair, words.where(own_word).count() + own_pair.count()


def _collected(found: DataFrame, sums: dict[str, int], own_word: Column, own_pair: DataFrame, word_discount: float, pair_discount: float) -> Counts:
    """Only what can be kept by a class, and the ends of such pairs, goes to the driver."""
    words = found.where("w is not null and v is null")
    kept_pairs = own_pair.toPandas().rename(columns={"v": "before", "w": "word"}).sort_values(["before", "word"], ignore_index=True)
    wanted = np.unique(np.concatenate([kept_pairs["before"], kept_pairs["word"]])).tolist()
    chosen = words.where(own_word) if not wanted else words.join(F.broadcast(found.sparkSession.createDataFrame([(int(x),) for x in wanted], "end long")), F.col("w") == F.col("end"), "left").where(own_word | F.col("end").isNotNull())
    kept_words = chosen.select(F.col("w").alias("word"), "nt", "no", "n", "t", "o").toPandas().sort_values("word", ignore_index=True)
    return Counts(kept_words, kept_pairs, sums, word_discount, pair_discount)


def count(docs: DataFrame, known: DataFrame, word_discount: float = WORD_DISCOUNT, pair_discount: float = PAIR_DISCOUNT) -> Counts:
    """Counts for a model of at most MODEL_ROWS expressions: discounts are doubled until they fit, which leaves out what is rarer. For callers that need all of it in memory; `fit` never doubles them."""
    found, sums = expressions(docs, known, word_discount, pair_discount)
    if not sums["nt"] or not sums["no"]:
        return Counts(pd.DataFrame({k: np.zeros(0, np.int64) for k in ("word", "nt", "no", "n", "t", "o")}), pd.DataFrame({k: np.zeros(0, np.int64) for k in ("before", "word", "t", "o")}), sums)
    while True:
        own_word, own_pair, n = _own(found, sums, word_discount, pair_discount)
        if n <= MODEL_ROWS:
            return _collected(found, sums, own_word, own_pair, word_discount, pair_discount)
        word_discount, pair_discount = 2 * word_discount, 2 * pair_discount


def _kept(mine: str, other: str, of_mine: Column, of_other: Column, discount: float) -> Column:
    """`own` as a column."""
    times = F.try_divide(of_mine, of_other)
    left = F.col(mine) - discount * F.greatest(F.coalesce(times, F.lit(1.0)), F.lit(1.0))
    return F.when((left > 0) & (left > RATIO * (F.col(other) * F.coalesce(times, F.lit(0.0)))), left).otherwise(0.0)


def _kept_sum(mine: str, of_mine: Column, of_other: Column, discount: float) -> Column:
    """The sum of what `_kept` gave (in kept_t or kept_o) over expressions with the same of_mine and of_other; from whole numbers, so it doesn't depend on the order."""
    kept = F.col(f"kept_{mine[-1]}") > 0
    return F.coalesce(F.sum(F.when(kept, F.col(mine))), F.lit(0)) - F.count_if(kept) * discount * F.greatest(F.coalesce(F.try_divide(F.first(of_mine), F.first(of_other)), F.lit(1.0)), F.lit(1.0))


def _file(rows: DataFrame, n: int, other: float, name: str) -> Filed:
    """n rows of v (null for words), w and value in files of at most MODEL_ROWS."""
    most, folder = MODEL_ROWS, shared.new_folder(rows.sparkSession, name)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shared.file_system(folder)
        keys, values, files = np.zeros(0, "<u8"), np.zeros(0, "<f8"), []

        def flush() -> None:
            order = np.argsort(keys[:most])
            files.append(f"{uuid.uuid4().hex}.ratios")
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{files[-1]}", compression=None) as sink:
                sink.write(keys[order].tobytes() + values[order].tobytes())

        for batch in batches:
            word = np.asarray(batch["w"]).view(np.uint64)
            keys = np.concatenate([keys, word if batch["v"].null_count else _both(np.asarray(batch["v"]).view(np.uint64), word)])
            values = np.concatenate([values, np.asarray(batch["value"])])
            while len(keys) >= most:
                flush()
                keys, values = keys[most:], values[most:]
        if len(keys):
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], ["file"])

    manifest = shared.written(rows.select("v", "w", "value").repartition(-(-n // most) or 1, "w", "v").mapInArrow(write, "file string"), f"{name}-manifest")
    return Filed([f"{folder}/{r.file}" for r in manifest.orderBy("file").collect()], other)


def filed(found: DataFrame, sums: dict[str, int], word_discount: float = WORD_DISCOUNT, pair_discount: float = PAIR_DISCOUNT) -> Model:
    """What `combine` gives for counts of all expressions, computed by Spark and left in files, whatever their number. The driver gets sums and names of files."""
    total = {"t": F.lit(sums["nt"]), "o": F.lit(sums["no"])}
    classes = (("t", "o"), ("o", "t"))
    words = found.where("w is not null and v is null").select("w", "nt", "no", "n", "t", "o", *[_kept(f"n{c}", f"n{d}", total[c], total[d], word_discount).alias(f"kept_{c}") for c, d in classes])
    kept = words.agg(F.count_if(F.expr("kept_t > 0 or kept_o > 0")).alias("n"), *[_kept_sum(f"n{c}", total[c], total[d], word_discount).alias(c) for c, d in classes]).first()
    free = {c: 1 - kept[c] / sums[f"n{c}"] for c in "to"}
    rest = float(np.log(free["t"]) - np.log(free["o"]))
    shared_part = F.greatest(F.col("n") - 0.75, F.lit(0.0)) / sums["n"]
    words = words.select("w", "t", "o", "kept_t", "kept_o", *[(F.col(f"kept_{c}") / total[c] + free[c] * shared_part).alias(f"alone_{c}") for c in "to"])
    own_words = words.where("kept_t > 0 or kept_o > 0").select(F.lit(None).cast("long").alias("v"), "w", F.expr("ln(alone_t) - ln(alone_o)").alias("value"))

    ends = words.select(F.col("w").alias("v"), F.col("t").alias("vt"), F.col("o").alias("vo"))
    of = {"t": F.col("vt"), "o": F.col("vo")}
    pairs = found.where("v is not null").select("v", "w", "t", "o").join(ends, "v")
    pairs = pairs.select("*", *[_kept(c, d, of[c], of[d], pair_discount).alias(f"kept_{c}") for c, d in classes]).where("kept_t > 0 or kept_o > 0")
    pairs = shared.written(pairs, "kept_pairs")
    per_context = pairs.groupBy("v").agg(*[_kept_sum(c, of[c], of[d], pair_discount).alias(f"context_{c}") for c, d in classes])
    pairs = pairs.join(per_context, "v").join(words.select("w", "alone_t", "alone_o"), "w")
    pooled, pooled_context = F.col("kept_t") + F.col("kept_o"), F.col("context_t") + F.col("context_o")
    left = 1 - pooled_context / F.greatest(F.col("vt") + F.col("vo"), F.lit(1))
    after = {c: (1 - left) * (F.col(f"kept_{c}") + pair_discount * pooled / pooled_context) / (F.col(f"context_{c}") + pair_discount) + left * F.col(f"alone_{c}") for c in "to"}
    own_pairs = pairs.select("v", "w", (F.ln(after["t"]) - F.ln(after["o"])).alias("value"))
    return Model(_file(own_words, kept["n"], rest, "word_ratios"), _file(own_pairs, pairs.count(), np.nan, "pair_ratios"), Curve())


def _may_keep(t: str, o: str, times: Column, discount: float, ratio: float = RATIO) -> Column:
    """Whether either class keeps an expression with counts t and o, whose contexts are `times` as many in toxic texts; null if only one class has any."""
    mine = lambda a, b, q: F.col(a) - discount * F.greatest(F.coalesce(q, F.lit(1.0)), F.lit(1.0)) > F.greatest(ratio * F.col(b) * F.coalesce(q, F.lit(0.0)), F.lit(0.0))
    return mine(t, o, times) | mine(o, t, F.try_divide(F.lit(1.0), times))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = known_ids(labels)
    found, sums = expressions(docs, known.where(fold().isin(*FIT)))
    if not sums["nt"] or not sums["no"]:
        share = of_ids(docs, known).agg(F.avg("toxic")).first()[0] or 0.0
        nothing = Table(np.zeros(0, np.uint64), np.zeros(0), 0.0)
        return Model(nothing, Table(nothing.keys, nothing.values, np.nan), level_curve(share))
    own_word, own_pair, n = _own(found, sums, WORD_DISCOUNT, PAIR_DISCOUNT)
    model = combine(_collected(found, sums, own_word, own_pair, WORD_DISCOUNT, PAIR_DISCOUNT)) if n <= MODEL_ROWS else filed(found, sums)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text", model.slice_bytes):
            step = np.rint(np.clip(ratios(part["text"], model), -BOUND, BOUND) / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part["toxic"], pa.array(step)], ["toxic", "step"])

    tune = of_ids(docs, known.where(fold().isin(*TUNE))).select("text", "toxic").mapInArrow(measure, "toxic int, step long")
    tune = tune.groupBy("toxic", "step").agg(F.count("*").alias("n")).toPandas().sort_values(["toxic", "step"])
    y, n = tune["toxic"].to_numpy(float), tune["n"].to_numpy(float)
    # Without held-back rows of both classes, a ratio of 0 is even.
    if 0 < (y * n).sum() < n.sum():
        model.curve = fit_curve(tune["step"].to_numpy() * STEP, y, n)
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic likelier) and predicted for every row of docs (doc_id, text)."""
    model = fit(docs, labels)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text", model.slice_bytes):
            s = score(part["text"], model)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, score double, predicted int")
