"""Mixing sources to target weights by fitting budgets with subset sums.

Each source gets a target: its weight's share of all words, never above three times its own words; what that cuts off
goes to the others by weight. A source whose target is r times its words and more is taken r times whole. For the rest
of its budget, its documents are counted by exact length; a share of every length is taken outright, and a bounded
knapsack over the counts that are left fits the remaining words exactly or as closely as they allow. Which documents of
a length are taken is decided by a seeded hash of the id.

Empty texts have size 0 and are taken 0 words. A null source is a source of its own and comes last. Rows with equal ids
and sources are equal in the hash and are ranked by their order in it alone. Other columns never enter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 20_240
#: Words up to which the knapsack fits the rest of a budget.
SPAN = 1 << 15
#: Documents of a length that are ranked together, on average; longer lists are first cut by ranges of the hash.
RANKED = 256


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> dict[str | None, float]:
    """The words to take from each source, given (source, words)."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    cap = {s: float(most * n) for s, n in order}
    left, free, out = float(sum(n for _, n in order)), [s for s, _ in order], {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > cap[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        out |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, span: int = SPAN) -> np.ndarray:
    """How many documents of each length to take so that their words are as near to budget as can be; beyond `span` words, as near as the knapsack over the last of them can make it."""
    total = int((lengths * counts).sum())
    share = min(1.0, budget / total) if total and budget > span else 0.0
    take = np.minimum(np.floor(counts * share).astype(np.int64), counts)
    rest = budget - int((take * lengths).sum())
    for k in np.argsort(-lengths, kind="stable").tolist():  # longest first, until the knapsack can do it
        if rest <= span:
            break
        more = min(int(counts[k] - take[k]), max(0, rest - span // 2) // max(int(lengths[k]), 1))
        take[k] += more
        rest -= more * int(lengths[k])
    if rest <= 0:
        return take
    left = np.where(lengths > 0, counts - take, 0)
    if int((left * lengths).sum()) <= rest:
        return take + left
    # Taken shortest first, the document that passes the rest is this long; so sums within half of it are the nearest ones.
    passing = int(lengths[np.searchsorted(np.cumsum(left * lengths), rest, side="right")])
    top = rest + passing // 2
    # Bounded knapsack: bit w of `reach` says that w words can be made, `came` by which step first; counts are split into powers of two.
    mask, reach, steps, came = (1 << (top + 1)) - 1, 1, [], np.full(top + 1, -1, np.int32)
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        n = min(int(left[k]), top // length) if length else 0
        chunk = 1
        while n > 0 and not (reach >> rest) & 1:
            part = min(chunk, n)
            new = (reach << (part * length)) & mask & ~reach
            if new:
                reach |= new
                came[np.flatnonzero(np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little"))] = len(steps)
                steps.append((k, part))
            n, chunk = n - part, 2 * chunk
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    over = (above & -above).bit_length()
    goal = rest + over if over and over < rest - below else below
    while goal:  # what a sum is made from was there before its step, so no step comes twice
        k, part = steps[came[goal]]
        take[k] += part
        goal -= part * int(lengths[k])
    return take


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, *also: Column) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, and the columns `also`, for every row of docs (doc_id, text, source).

    The driver holds one row for each source, none for each document.
    """
    size = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    base = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("h"), F.struct(F.lit(0), *also).alias("also"))
    base = base.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    return _mix(base, weights)


def _mix(base: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    base = shared.written(base, "sizes")
    hist = base.groupBy("key", "size").agg(F.count("*").alias("n"), F.first("source").alias("source"))
    totals = [(r["source"], r["total"]) for r in hist.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("total")).collect()]
    goal = targets(totals, weights)
    goals = {"n" if s is None else "s" + s: (n, goal[s]) for s, n in totals}

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = goals[pdf["key"].iloc[0]]
        pdf = pdf.sort_values("size")
        words = int(round(target))
        epochs = min(words // total, MAX_EPOCHS) if total else 0
        lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        more = fit(lengths, counts, words - epochs * total) if epochs < MAX_EPOCHS else np.zeros(len(pdf), np.int64)
        return pdf.assign(epochs=epochs, more=np.where(lengths > 0, more, 0), source_size=total, target=target)

    plans = shared.written(hist.select("key", "size", "n").groupBy("key").applyInPandas(plan, "key string, size long, n long, epochs long, more long, source_size long, target double"), "plan")
    parts = F.ceil(F.col("n") / RANKED)
    unit = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    rows = base.join(plans, ["key", "size"]).withColumn("part", F.floor(unit * parts).cast("long"))
    # Lists of which only some are taken: whole ranges of the hash up to `last`, and the first `left` of range `at`.
    ranges = rows.where("more > 0 and more < n").groupBy("key", "size", "part", "more").agg(F.count("*").alias("here"))
    below = F.coalesce(F.sum("here").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside, across = F.expr("below + here <= more"), F.expr("below < more and below + here > more")
    cuts = ranges.withColumn("below", below).groupBy("key", "size").agg(F.max(F.when(inside, F.col("part"))).alias("last"), F.max(F.when(across, F.col("part"))).alias("at"), F.max(F.when(across, F.col("more") - F.col("below"))).alias("left"))
    rows = rows.join(cuts, ["key", "size"], "left")
    taken = ((F.col("epochs") + F.col("extra")) * F.col("size")).alias("taken")
    out = ["doc_id", "source", "size", "source_size", "target", taken, "also"]
    ranked = rows.where("part = at").withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("h", "doc_id")))
    ranked = ranked.withColumn("extra", F.expr("if(rank <= left, 1L, 0L)"))
    others = rows.where("at is null or part <> at").withColumn("extra", F.expr("case when more = n then 1L when more = 0 then 0L when part <= coalesce(last, -1) then 1L else 0L end"))
    return ranked.select(*out).unionByName(others.select(*out)).select("*", "also.*").drop("also", "col1")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of docs that the mix takes, with all their columns; a document taken several times stands there as often.

    Rows with equal id, source and text are taken together; where their other columns differ, one of them stands for all.
    """
    key = ["id", "source", "text_hash"]
    taken = mix(docs, weights, seed, F.xxhash64("text").alias("text_hash")).groupBy(F.col("doc_id").alias("id"), "source", "text_hash").agg(F.sum(F.expr("try_divide(taken, size)").cast("long")).alias("times"), F.count("*").alias("rows"))
    taken = shared.written(taken.where("times > 0").select(*[F.col(k).alias(f"t_{k}") for k in key], "times", "rows"), "taken")
    rows = docs.select(F.col("doc_id").alias("id"), "source", F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row"))
    same = F.col("id").eqNullSafe(F.col("t_id")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("text_hash") == F.col("t_text_hash"))
    out = rows.join(taken.where("rows = 1"), same)
    if not (several := taken.where("rows > 1")).isEmpty():
        out = out.unionByName(rows.join(several, same).dropDuplicates(key))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).select("row.*")
