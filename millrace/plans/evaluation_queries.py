"""Queries of evaluation runs: metrics, percentiles, samples, joins of runs, and updates of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import questions as Q
from ..operators import retrieval as R
from ..sources.tables import spread, table
from ..streaming import updates
from .registry import query
from .retrieval_queries import _BM25

# Items are benchmark passages; a document is relevant that holds the passage. Language and type are made from the id.
_ITEM = "CASE item_id % 2 WHEN 0 THEN 'en' ELSE 'ar' END AS language, CASE item_id % 3 WHEN 0 THEN 'exact_value' WHEN 1 THEN 'simple' ELSE 'multi' END AS type"
_GOLD = "gold AS MATERIALIZED (SELECT item_id AS id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_METRICS = f"""{_BM25}, {_GOLD}, items AS (SELECT item_id AS id, {_ITEM} FROM benchmark),
    hits AS (SELECT id, rank FROM gold JOIN rk ON rk.query_id = gold.id AND rk.doc_id = gold.doc_id WHERE rank <= 10),
    mt AS MATERIALIZED (SELECT items.*, (SELECT count(*) FROM gold g WHERE g.id = items.id) AS n_gold, (SELECT min(rank) FROM hits h WHERE h.id = items.id) AS first_hit_rank,
        {", ".join(f"(SELECT count(*) FROM hits h WHERE h.id = items.id AND rank <= {k}) AS n_{k}" for k in E.KS)} FROM items),
    me AS MATERIALIZED (SELECT id, language, type, first_hit_rank, coalesce(1.0::DOUBLE / first_hit_rank, 0) AS mrr, {", ".join(f"(n_{k} > 0)::INT AS hit_{k}, coalesce(n_{k}::DOUBLE / nullif(n_gold, 0), 0) AS recall_{k}, n_{k} / {k}.0::DOUBLE AS precision_{k}" for k in E.KS)} FROM mt)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    items = bench.select(i.alias("id"), F.when(i % 2 == 0, "en").otherwise("ar").alias("language"), F.when(i % 3 == 0, "exact_value").when(i % 3 == 1, "simple").otherwise("multi").alias("type"))
    asked = bench.select(i.alias("query_id"), "text")
    ranked = R.bm25(docs, asked, 10).select(F.col("query_id").alias("id"), "rank", "doc_id")
    found = Q.containing(bench.select(i.alias("rule_id"), F.col("text").alias("part")), docs.withColumnRenamed("doc_id", "item_id"))
    gold = found.select(F.col("rule_id").alias("id"), F.col("item_id").alias("doc_id"))
    return E.ranking_metrics(items, ranked, gold)


_COLUMNS = ", ".join(["mrr", *[f"{m}_{k}" for m in ("hit", "recall", "precision") for k in E.KS]])
_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in _COLUMNS.split(", "))


@query(f"WITH {_METRICS} SELECT id, language, type, first_hit_rank, round(mrr, 6) AS mrr, {', '.join(f'hit_{k}, round(recall_{k}, 6) AS recall_{k}, round(precision_{k}, 6) AS precision_{k}' for k in E.KS)} FROM me")
def metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _metrics(spark, sf_dir)
    return rows.select(*[F.round(c, 6).alias(c) if c == "mrr" or c.startswith(("recall", "precision")) else F.col(c) for c in rows.columns])


@query(f"WITH {_METRICS} SELECT language, type, grouping_id(language, type)::INT AS level, count(*) AS n, {_MEANS} FROM me GROUP BY GROUPING SETS ((), (language), (language, type))")
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metric_means(_metrics(spark, sf_dir), "language", "type")


@query(f"WITH {_METRICS} SELECT id, round(mrr, 6) AS mrr FROM me ORDER BY me.mrr, id LIMIT 10")
def worst_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).orderBy("mrr", "id").limit(10).select("id", F.round("mrr", 6).alias("mrr"))


@query(f"WITH {_METRICS} SELECT language, type, round(avg(hit_5), 6) AS hit_5 FROM me GROUP BY language, type ORDER BY avg(hit_5), language, type LIMIT 1")
def weakest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _metrics(spark, sf_dir).groupBy("language", "type").agg(F.avg("hit_5").alias("hit_5"))
    return rows.orderBy("hit_5", "language", "type").limit(1).select("language", "type", F.round("hit_5", 6).alias("hit_5"))


@query(f"WITH {_METRICS} SELECT count(*) AS n_pairs, count_if(a.hit_5 <> b.hit_5) AS n_differ FROM me a JOIN me b ON b.id = a.id + 1 WHERE a.id % 2 = 0")
def pair_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring items as matched pairs: how many differ in hit at 5."""
    rows = _metrics(spark, sf_dir)
    pairs = rows.groupBy(F.floor(F.col("id") / 2).alias("pair")).agg(F.count("*").alias("n"), F.min("hit_5").alias("lo"), F.max("hit_5").alias("hi")).where("n = 2")
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("lo") != F.col("hi")).alias("n_differ"))


@query(f"""
    WITH {_BM25}, gt AS (SELECT item_id AS id, unnest(list_distinct({T.sql_tokens('text', False)})) AS token FROM benchmark), n AS (SELECT id, count(*) AS n FROM gt GROUP BY id),
    rt AS (SELECT query_id AS id, rank, unnest(list_distinct({T.sql_tokens('text', False)})) AS token FROM rk JOIN documents USING (doc_id) WHERE rank <= 10),
    f AS (SELECT id, token, min(rank) AS rank FROM rt JOIN gt USING (id, token) GROUP BY id, token), u AS (SELECT id, rank, sum(count(*)) OVER (PARTITION BY id ORDER BY rank) AS upto FROM f GROUP BY id, rank)
    SELECT item_id AS id, (SELECT min(rank) FROM u JOIN n USING (id) WHERE u.id = item_id AND upto / n.n >= 0.8) AS coverage_rank FROM benchmark
""")
def coverage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark")
    words = T.tokens(F.col("text"), False)
    found = R.bm25(docs, bench.select(F.col("item_id").alias("query_id"), "text"), 10).select(F.col("query_id").alias("id"), "rank", "doc_id")
    return E.coverage_rank(bench.select(F.col("item_id").alias("id"), words.alias("tokens")), found.join(docs, "doc_id").select("id", "rank", words.alias("tokens")))


@query("""
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(n) AS n, max(CASE WHEN k = round_even(0.5 * (n - 1), 0) + 1 THEN value END) AS p50, max(CASE WHEN k = round_even(0.95 * (n - 1), 0) + 1 THEN value END) AS p95 FROM r GROUP BY event_type
""")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.nearest_rank(table(spark, sf_dir, "events"), "value", (50, 95), "event_type")


@query("""
    SELECT lang, min(CASE WHEN quality = 1 THEN s END) AS min_pos, max(CASE WHEN quality = 0 THEN s END) AS max_neg, round(avg(CASE WHEN quality = 1 THEN s END), 6) AS avg_pos, round(avg(CASE WHEN quality = 0 THEN s END), 6) AS avg_neg,
        round((min(CASE WHEN quality = 1 THEN s END) + max(CASE WHEN quality = 0 THEN s END)) / 2, 6) AS midpoint, min(CASE WHEN quality = 1 THEN s END) > max(CASE WHEN quality = 0 THEN s END) AS clean
    FROM (SELECT lang, quality, (n_chars % 1000) / 1000.0::DOUBLE AS s FROM documents JOIN labels USING (doc_id)) GROUP BY lang
""")
def threshold_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") % 1000 / 1000.0).alias("s")).join(table(spark, sf_dir, "labels"), "doc_id")
    pos, neg = F.when(F.col("quality") == 1, F.col("s")), F.when(F.col("quality") == 0, F.col("s"))
    return rows.groupBy("lang").agg(F.min(pos).alias("min_pos"), F.max(neg).alias("max_neg"), F.round(F.avg(pos), 6).alias("avg_pos"), F.round(F.avg(neg), 6).alias("avg_neg"), F.round((F.min(pos) + F.max(neg)) / 2, 6).alias("midpoint"), (F.min(pos) > F.max(neg)).alias("clean"))


@query("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS pick FROM documents QUALIFY pick <= 10")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sample_each(table(spark, sf_dir, "documents").select("lang", "doc_id"), 10, 42, "doc_id", "lang")


@query("""
    WITH p AS (SELECT lang, doc_id, n_chars > 3000 AS exact FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang, exact ORDER BY md5('42:' || doc_id), doc_id) AS k FROM p),
    e AS (SELECT * FROM r WHERE exact AND k <= 3), n AS (SELECT lang, count(*) AS n FROM e GROUP BY lang) SELECT lang, doc_id, exact FROM e UNION ALL SELECT r.lang, doc_id, exact FROM r LEFT JOIN n USING (lang) WHERE NOT exact AND k <= 10 - coalesce(n, 0)
""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of each language: up to three long ones, and others for the rest."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", (F.col("n_chars") > 3000).alias("exact"))
    picks = E.sample_each(rows, 10, 42, "doc_id", "lang", "exact")
    exact = picks.where("exact and pick <= 3")
    filled = picks.where("not exact").join(exact.groupBy("lang").agg(F.count("*").alias("n")), "lang", "left").where("pick <= 10 - coalesce(n, 0)")
    return exact.select("lang", "doc_id", "exact").unionByName(filled.select("lang", "doc_id", "exact"))


@query("SELECT source, doc_id, pass FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS pass FROM documents) ORDER BY pass, source LIMIT 50")
def stratified_roundrobin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.round_robin(table(spark, sf_dir, "documents").select("source", "doc_id"), 50, 7, "doc_id", "source").select("source", "doc_id", "pass")


@query("""
    WITH i AS (SELECT item_id, row_number() OVER (ORDER BY md5('9:' || item_id), item_id) - 1 AS place FROM benchmark), t AS (SELECT sum(1.0::DOUBLE / (place + 1)) AS total FROM i),
    c AS (SELECT item_id, (sum(1.0::DOUBLE / (place + 1)) OVER (ORDER BY place) - 1.0::DOUBLE / (place + 1)) / total AS lo, sum(1.0::DOUBLE / (place + 1)) OVER (ORDER BY place) / total AS hi FROM i, t),
    d AS (SELECT conv_id * 1000 + turn AS draw, ('0x' || substr(md5('5:' || (conv_id * 1000 + turn)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM conversations)
    SELECT draw, item_id FROM d JOIN c ON u >= lo AND u < hi
""")
def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark")
    items = bench.select("item_id", (F.row_number().over(Window.orderBy(E.hash_order(F.col("item_id"), 9), "item_id")) - 1).alias("place"))
    draws = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("draw"))
    return E.weighted_draws(items, draws, 5)


@query("""
    WITH f AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY lang, source, doc_id % 10 ORDER BY doc_id) AS r, doc_id % 10 AS idx FROM documents)
    SELECT a.source AS topic, a.idx AS chunk_index, a.doc_id AS en_id, b.doc_id AS fr_id FROM f a JOIN f b ON a.source = b.source AND a.idx = b.idx WHERE a.lang = 'en' AND b.lang = 'fr' AND a.r = 1 AND b.r = 1
""")
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each language, topic and index, matched across two languages."""
    first = table(spark, sf_dir, "documents").groupBy("lang", F.col("source").alias("topic"), (F.col("doc_id") % 10).alias("chunk_index")).agg(F.min("doc_id").alias("id"))
    side = lambda x: first.where(F.col("lang") == x).select("topic", "chunk_index", F.col("id").alias(f"{x}_id"))
    return side("en").join(side("fr"), ["topic", "chunk_index"])


@query("SELECT conv_id, turn, next_turn FROM (SELECT conv_id, turn, role, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("turn").over(w).alias("next_turn"), F.lead("role").over(w).alias("next_role"))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "next_turn")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a run has not done yet: customers without orders."""
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def known_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(known, "c_custkey", "left_semi")


@query("WITH n AS (SELECT doc_id, 'new' AS source, n_chars FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT * FROM n UNION ALL SELECT doc_id + 1000000000, source, n_chars FROM n")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    changed = docs.where("doc_id % 3 = 0").withColumn("source", F.lit("new"))
    return E.upsert(docs, changed.unionByName(changed.withColumn("doc_id", F.col("doc_id") + 1000000000)), "doc_id")


@query("SELECT source, count(*) AS deleted, count_if(doc_id % 2 = 0) AS inserted FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 2 = 0) GROUP BY source")
def update_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return E.replace_document(docs, docs.where("doc_id % 2 = 0"), "source")[1]


@query("SELECT doc_id, source, n_chars FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 0 AND source IS NOT NULL) UNION ALL SELECT doc_id, source, -n_chars FROM documents WHERE doc_id % 2 = 0")
def update_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that update_document counts for, after its rows are replaced; n_chars of incoming rows is negated to tell them apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return E.replace_document(docs, docs.where("doc_id % 2 = 0").withColumn("n_chars", -F.col("n_chars")), "source")[0]


@query("SELECT source, count_if(lang = 'de') AS de, count_if(lang = 'en') AS en, count_if(lang = 'es') AS es, count_if(lang = 'fr') AS fr FROM documents GROUP BY source")
def crosstab_type_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1)))
    return rows.na.fill(0, ["de", "en", "es", "fr"])


@query("SELECT date_trunc('hour', ts) AS hour, event_type AS language, count(*) AS requests, sum(user_id % 100)::BIGINT AS prompt_tokens, sum(event_id % 50)::BIGINT AS completion_tokens FROM events GROUP BY ALL")
def token_log_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("language"), (F.col("user_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens"))
    return updates.hourly_usage(log).select(F.col("window.start").alias("hour"), "language", "requests", "prompt_tokens", "completion_tokens")


@query("""
    SELECT event_type AS language, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END), 4) AS hallucination_rate, format('{}/{}', count_if(user_id % 3 = 0), count(*)) AS answered,
        sum(event_id % 700)::BIGINT AS tokens, round(sum(event_id % 700) * 0.3 / 1000000.0, 6)::DOUBLE AS cost, sum(event_id % 700)::BIGINT // count(*) AS avg_tokens FROM events GROUP BY event_type
""")
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.sum(F.col("event_id") % 700)
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("language")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.avg(F.when(F.col("value") < 20, 1.0).otherwise(0.0)), 4).alias("hallucination_rate"),
        F.format_string("%d/%d", F.count_if(F.col("user_id") % 3 == 0), F.count("*")).alias("answered"), tokens.alias("tokens"), F.round(tokens * 0.3 / 1000000.0, 6).alias("cost"),
    )
    return rows.withColumn("avg_tokens", F.expr("tokens div n"))


@query("SELECT event_type AS match_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM events GROUP BY event_type")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("match_type"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("hit_rate"))


@query("""
    WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS size FROM documents)
    SELECT source, doc_id FROM (SELECT *, row_number() OVER (ORDER BY k DESC, source) AS r FROM n) WHERE r <= 30
""")
def trim_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty rows taken from whichever source is largest at the time, ties by name: by rank within the source, last first. Only the last thirty of a source can be among them."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    last = E.last_each(docs, 30, "doc_id", "source").join(docs.groupBy("source").agg(F.count("*").alias("n")), "source")
    return last.withColumn("k", F.col("n") - F.col("back")).orderBy(F.desc("k"), "source").limit(30).select("source", "doc_id")
