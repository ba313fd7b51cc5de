"""Ranking metrics, summaries, percentiles, samples and set operations of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def ranking_metrics(items: DataFrame, ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Per item of items (id, ...): first_hit_rank, mrr, and hit, recall and precision at each k, from ranked (id, rank, doc_id) and gold (id, doc_id). Precision divides by k."""
    hits = ranked.join(gold, ["id", "doc_id"]).groupBy("id").agg(F.min("rank").alias("first_hit_rank"), *[F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in ks])
    total = gold.groupBy("id").agg(F.count("*").alias("n_gold"))
    rows = items.join(total, "id", "left").join(hits, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = [*[F.col(c) for c in items.columns], F.col("first_hit_rank"), F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        n = zero(F.col(f"n_{k}"))
        out += [(n > 0).cast("int").alias(f"hit_{k}"), F.coalesce(n / F.col("n_gold"), F.lit(0.0)).alias(f"recall_{k}"), (n / k).alias(f"precision_{k}")]
    return rows.select(*out)


def metric_means(metrics: DataFrame, *keys: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """Means over all rows, by the first key, and by all keys, in one pass of grouping sets."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("mrr", *[f"{m}_{k}" for m in ("hit", "recall", "precision") for k in ks])]
    sets = [[], [keys[0]], list(keys)]
    return metrics.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), *means)


def id_list(x: Column) -> Column:
    """The ids of a list with commas; null and blank have none."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def gold_texts(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, gold_id, text): the texts of the chunks (chunk_id, text) that items (id, chunk_ids with commas) name; ids without a chunk are left out."""
    named = items.select("id", F.explode(id_list(F.col("chunk_ids"))).alias("gold_id"))
    return named.join(chunks.select(F.col("chunk_id").alias("gold_id"), "text"), "gold_id").select("id", "gold_id", "text")


def coverage_ranks(gold: DataFrame, retrieved: DataFrame, share: float = 0.8) -> DataFrame:
    """(id, gold_id, coverage_rank) for each of gold (id, gold_id, tokens): the first rank at which the tokens of retrieved (id, rank, tokens) up to it hold `share` of its distinct tokens; null if none does, or it has none."""
    need = gold.select("id", "gold_id", F.explode(F.array_distinct("tokens")).alias("token"))
    total = need.groupBy("id", "gold_id").agg(F.count("*").alias("n"))
    first = retrieved.select("id", F.explode(F.array_distinct("tokens")).alias("token"), "rank").groupBy("id", "token").agg(F.min("rank").alias("rank"))
    ranks = need.join(first, ["id", "token"]).groupBy("id", "gold_id", "rank").agg(F.count("*").alias("here"))
    ranks = ranks.withColumn("upto", F.sum("here").over(Window.partitionBy("id", "gold_id").orderBy("rank")))
    met = ranks.join(total, ["id", "gold_id"]).where(F.col("upto") / F.col("n") >= share).groupBy("id", "gold_id").agg(F.min("rank").alias("coverage_rank"))
    return gold.select("id", "gold_id").distinct().join(met, ["id", "gold_id"], "left")


def coverage_scores(ranks: DataFrame, k: int = 5) -> DataFrame:
    """(id, hit, recall, reciprocal_rank) from coverage_ranks: whether any gold is covered by rank k, the share that is, and the reciprocal of the rank at which the first is; 0 without."""
    covered = F.coalesce(F.col("coverage_rank") <= k, F.lit(False))
    return ranks.groupBy("id").agg(F.max(covered.cast("int")).alias("hit"), F.avg(covered.cast("double")).alias("recall"), F.coalesce(1.0 / F.min("coverage_rank"), F.lit(0.0)).alias("reciprocal_rank"))


def coverage_rank(gold: DataFrame, retrieved: DataFrame, share: float = 0.8) -> DataFrame:
    """(id, coverage_rank): the least rank at which one of an item's golds (id, tokens) is covered; null if none is."""
    each = coverage_ranks(gold.select("id", "tokens", F.xxhash64("tokens").alias("gold_id")), retrieved, share)
    return each.groupBy("id").agg(F.min("coverage_rank").alias("coverage_rank"))


# Actions that count as refusals, of answers that are judged and of experiments.
JUDGED_REFUSALS = ("out_of_domain", "ambiguous", "no_info")
REFUSALS = (*JUDGED_REFUSALS, "needs_account_data")
STAGES = ("normalize", "vector", "keyword", "guardrail", "ttft", "generation")
FAITHFUL = 0.8


def correctly_refused(action: Column, actions: tuple[str, ...] = REFUSALS) -> Column:
    return F.coalesce(action.isin(*actions), F.lit(False))


def judge_means(scores: DataFrame, checks: tuple[str, ...], *keys: str) -> DataFrame:
    """n and the mean of each check by keys; nulls are left out, and a mean of none is null."""
    return scores.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in checks])


def refusal_counts(records: DataFrame, *keys: str, actions: tuple[str, ...] = JUDGED_REFUSALS) -> DataFrame:
    """n and correctly_refused by keys, of records (…, action) that should be refused."""
    return records.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(correctly_refused(F.col("action"), actions)).alias("correctly_refused"))


def experiment_summary(records: DataFrame, price_in: float | None = None, price_out: float | None = None) -> DataFrame:
    """One row a language of records (language, type, action, answered, hit, recall, reciprocal_rank, faithfulness, total, prompt, completion, context, and a column for each of STAGES).

    Items of type should_refuse count for refusals and latency alone. Means are to four places, percentiles (nearest rank) to one.
    """
    asked, refuse = F.col("type") != "should_refuse", F.col("type") == "should_refuse"
    answered = asked & F.coalesce(F.col("answered"), F.lit(False))
    mean = lambda c, test=None: F.round(F.avg(F.when(test, F.col(c)) if test is not None else F.col(c)), 4)
    faith = F.when(answered, F.col("faithfulness"))
    rows = records.groupBy("language").agg(
        F.count("*").alias("n_items"), *[mean(c, asked).alias(c) for c in ("hit", "recall", "reciprocal_rank")], F.round(F.avg(faith), 4).alias("faithfulness"),
        F.round(F.try_divide(F.count_if(faith < FAITHFUL), F.count(faith)), 4).alias("hallucination_rate"), F.format_string("%d/%d", F.count_if(answered), F.count_if(asked)).alias("answered"),
        F.format_string("%d/%d", F.count_if(refuse & correctly_refused(F.col("action"))), F.count_if(refuse)).alias("refused"), *[mean(c).alias(f"{c}_ms") for c in STAGES],
        mean("prompt").alias("prompt_tokens"), mean("completion").alias("completion_tokens"), mean("context", answered).alias("context_tokens"),
    )
    cost = F.round((F.col("prompt_tokens") * price_in + F.col("completion_tokens") * price_out) / 1e6, 6) if price_in is not None and price_out is not None else F.lit(None).cast("double")
    times = nearest_rank(records, "total", (50, 95), "language").select("language", F.round("p50", 1).alias("p50"), F.round("p95", 1).alias("p95"))
    return rows.withColumn("cost", cost).join(times, "language", "left")


def accuracy(rows: DataFrame, correct: Column, *keys: str) -> DataFrame:
    """n, n_correct and their share by keys; a null counts as wrong."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.coalesce(correct, F.lit(False))).alias("n_correct")).withColumn("accuracy", F.col("n_correct") / F.col("n"))


def throughput(items: Column, seconds: Column) -> Column:
    """Items a second to two places; null where no time passed."""
    return F.round(F.try_divide(items, seconds), 2)


def survival(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """answers (id, doc_id, strategy, answer) with survives: whether one chunk of chunks (doc_id, strategy, text) of its document holds the whole answer; where none does, it is broken."""
    held = answers.join(chunks.select("doc_id", "strategy", "text"), ["doc_id", "strategy"], "left")
    return held.groupBy("id", "strategy").agg(F.max(F.coalesce(F.contains("text", "answer"), F.lit(False))).alias("survives"))


def reused(wanted: DataFrame, known: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """wanted with `value` of the last of known with its key (by order), or its own where there is none."""
    last = known.groupBy(key).agg(F.max_by(value, order).alias("_known"))
    return wanted.join(last, key, "left").withColumn(value, F.coalesce("_known", value)).drop("_known")


def before_after(before: DataFrame, after: DataFrame, key: str, *values: str) -> DataFrame:
    """key, and each value before, after and their difference, of rows in both runs."""
    rows = before.select(key, *[F.col(v).alias(f"{v}_before") for v in values]).join(after.select(key, *[F.col(v).alias(f"{v}_after") for v in values]), key)
    return rows.select("*", *[(F.col(f"{v}_after") - F.col(f"{v}_before")).alias(f"{v}_change") for v in values])


def chosen(items: DataFrame, ids: list | None = None, limit: int | None = None, key: str = "id") -> DataFrame:
    """The items with these ids, then the first `limit` by key."""
    items = items.where(F.col(key).isin(*ids)) if ids else items
    return items.orderBy(key).limit(limit) if limit else items


def adjacent_sample(rows: DataFrame, n: int, seed: int, key: str, group: str) -> DataFrame:
    """n pairs of neighbours (by key) of each group, by seeded order of the first; `next` is the second's key."""
    paired = with_next(rows, group, key, {"next": key}).where("next is not null")
    return sample_each(paired, n, seed, key, group)


def nearest_rank(rows: DataFrame, value: str, percents: tuple[int, ...], *keys: str, accuracy: int = 10_000) -> DataFrame:
    """Percentiles of a column by keys: the value at index round-half-even(p / 100 * (n - 1)), nulls left out.

    Approximate percentiles, whose ranks are off by n / accuracy at most, tell between which two values a percentile lies. Rows
    below are counted, and only distinct values in between are put in order, so neither a key that most rows have nor values
    far out make one task's work. Keys with up to `accuracy` rows are ordered whole.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("_"), *keys).alias("k"), F.col(value).alias("v"))
    margin = 5 / accuracy
    around = [min(1.0, max(0.0, p / 100 + d)) for p in percents for d in (-margin, margin)]
    span = known.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", around, accuracy).alias("around"))
    whole = F.col("n") <= accuracy
    span = span.select("k", "n", F.array(*[
        F.struct(F.lit(p).alias("p"), (F.rint(F.lit(p) / 100 * (F.col("n") - 1)) + 1).alias("at"), F.when(whole, F.col("least")).otherwise(F.col("around")[2 * j]).alias("lo"), F.when(whole, F.col("most")).otherwise(F.col("around")[2 * j + 1]).alias("hi"))
        for j, p in enumerate(percents)
    ]).alias("ps"))
    placed = known.groupBy("k", "v").agg(F.count("*").alias("here")).join(span, "k")
    below = placed.groupBy("k", "n").agg(*[F.sum(F.when(F.col("v") < F.col("ps")[j]["lo"], F.col("here")).otherwise(0)).alias(f"b{j}") for j in range(len(percents))])
    below = below.select("k", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"b{j}").alias("below")) for j, p in enumerate(percents)])).alias("b")).select("k", "n", "b.*")
    inside = placed.select("k", "v", "here", F.explode(F.filter("ps", lambda x: (F.col("v") >= x["lo"]) & (F.col("v") <= x["hi"]))).alias("x")).select("k", "v", "here", "x.p", "x.at").join(below, ["k", "p"])
    upto = F.col("below") + F.sum("here").over(Window.partitionBy("k", "p").orderBy("v"))
    found = inside.withColumn("upto", upto).where("upto >= at")
    return found.groupBy("k").agg(F.max("n").alias("n"), *[F.min(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents]).select(*[f"k.{c}" for c in keys], "n", *[f"p{p}" for p in percents])


def with_next(rows: DataFrame, group: str, key: str, values: dict[str, str], block: int = 4096) -> DataFrame:
    """rows with columns that hold those of the next row of its group, by an integer key: values maps new names to old ones.

    Rows are put in order within blocks of keys; only each block's first row meets those of others, so a group that most rows have is shared by tasks.
    """
    rows = rows.withColumn("_block", F.floor(F.col(key) / block))
    inside = Window.partitionBy(group, "_block").orderBy(key)
    ahead = F.struct(*[F.col(old).alias(new) for new, old in values.items()])
    rows = rows.withColumn("_ahead", F.lead(ahead).over(inside))
    firsts = rows.groupBy(group, "_block").agg(F.min_by(ahead, key).alias("_first"))
    after = firsts.select(group, "_block", F.lead("_first").over(Window.partitionBy(group).orderBy("_block")).alias("_after"))
    same = rows.join(after.withColumnRenamed(group, "_group").withColumnRenamed("_block", "_of"), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_of")), "left")
    found = F.coalesce("_ahead", "_after")
    return same.select(*[c for c in rows.columns if c not in ("_block", "_ahead")], *[found[new].alias(new) for new in values])


def hash_order(key: Column, seed: int) -> Column:
    """A seeded order of rows that every engine with md5 repeats."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_each(rows: DataFrame, n: int, seed: int, key: str, *groups: str) -> DataFrame:
    """n rows of each group, by seeded order."""
    order = Window.partitionBy(*groups).orderBy(hash_order(F.col(key), seed), key)
    return rows.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n)


def last_each(rows: DataFrame, n: int, key: str, group: str) -> DataFrame:
    """The n rows of each group with the largest key; `back` counts from 0 for the last."""
    ranked = rows.withColumn("_back", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(key)))).where(F.col("_back") <= n)
    return ranked.withColumn("back", F.col("_back") - 1).drop("_back")


def round_robin(rows: DataFrame, n: int, seed: int, key: str, group: str) -> DataFrame:
    """n rows, one of each group in turn, groups in order of name; `pass` is the turn."""
    turns = sample_each(rows, n, seed, key, group).withColumnRenamed("pick", "pass")
    return turns.orderBy("pass", group).limit(n)


def weighted_draws(items: DataFrame, draws: DataFrame, seed: int, others: DataFrame | None = None, share: float = 0.15) -> DataFrame:
    """(draw, item_id): each of draws (draw) takes an item of items (item_id, place from 0) with weight 1 / (place + 1), with replacement. With others (item_id), a share of the draws takes one of them instead, each as likely.

    A range join of uniform numbers with cumulative weights, cut into 1000 steps to be an equi-join. Cumulative weights are sums within blocks of places and before them, so no list is put in order by one task.
    """
    steps, block = 1000, 4096
    weight = 1.0 / (F.col("place") + 1)
    blocks = items.groupBy(F.expr(f"place div {block}").alias("block")).agg(F.sum(weight).alias("w"))
    before = blocks.select("block", (F.sum("w").over(Window.orderBy("block")) - F.col("w")).alias("before"), F.sum("w").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = F.sum(weight).over(Window.partitionBy("block").orderBy("place"))
    upto = items.select("item_id", "place", F.expr(f"place div {block}").alias("block")).withColumn("inside", inside).join(before, "block")
    upto = upto.select("item_id", ((F.col("before") + F.col("inside") - weight) / F.col("total")).alias("lo"), ((F.col("before") + F.col("inside")) / F.col("total")).alias("hi"))
    bins = upto.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * steps).cast("int"), F.floor(F.col("hi") * steps).cast("int"))))
    uniform = lambda salt: F.conv(F.substring(hash_order(F.col("draw"), salt), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    mine = draws if others is None else draws.where(uniform(seed + 1) >= share)
    found = mine.withColumn("u", uniform(seed)).withColumn("bin", F.floor(F.col("u") * steps).cast("int")).join(bins, "bin").where("u >= lo and u < hi").select("draw", "item_id")
    if others is None:
        return found
    n = others.count()
    numbered = others.select("item_id", (F.row_number().over(Window.orderBy("item_id")) - 1).alias("at"))  # a fixed list of questions
    rest = draws.where(uniform(seed + 1) < share).withColumn("at", F.floor(uniform(seed) * n).cast("int")).join(F.broadcast(numbered), "at").select("draw", "item_id")
    return found.unionByName(rest)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of existing whose key new doesn't have."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def delete_where(table: DataFrame, attribute: str, value: object) -> tuple[DataFrame, int]:
    """The table without the rows whose attribute is value, and how many those are."""
    gone = F.col(attribute).eqNullSafe(F.lit(value))
    return table.where(~gone), table.where(gone).count()


def replace_document(existing: DataFrame, new: DataFrame, attribute: str) -> tuple[DataFrame, DataFrame]:
    """The table with all rows of new's attribute values replaced by new, and counts of deleted and inserted rows by value. New rows are made before old ones go."""
    values = new.select(attribute).distinct()
    deleted = existing.join(values, attribute, "left_semi").groupBy(attribute).agg(F.count("*").alias("deleted"))
    inserted = new.groupBy(attribute).agg(F.count("*").alias("inserted"))
    counts = inserted.join(deleted, attribute, "left").select(attribute, F.coalesce("deleted", F.lit(0)).alias("deleted"), "inserted")
    return existing.join(values, attribute, "left_anti").unionByName(new), counts


def cache_lookup(questions: DataFrame, cache: DataFrame, similarity: float = 0.93) -> DataFrame:
    """(question_id, entry_id, match_type): the first entry with the same key, else the most similar one from the threshold on, earliest on ties.

    questions and cache hold (id, key, vec); only questions without an exact match are compared by vector.
    """
    from .retrieval import vector_top

    exact = questions.select("id", "key").join(cache.groupBy("key").agg(F.min("id").alias("entry_id")), "key", "left").select("id", "entry_id")
    open_ = questions.join(exact.where("entry_id is null").select("id"), "id", "left_semi")
    near = vector_top(cache.select("id", "vec"), open_.select("id", "vec"), 1).where(F.col("score") >= similarity).select(F.col("query_id").alias("id"), F.col("vec_id").alias("near_id"))
    rows = exact.join(near, "id", "left")
    kind = F.when(F.col("entry_id").isNotNull(), "identical").when(F.col("near_id").isNotNull(), "similar").otherwise("none")
    return rows.select(F.col("id").alias("question_id"), F.coalesce("entry_id", "near_id").alias("entry_id"), kind.alias("match_type"))
