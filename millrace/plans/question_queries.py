"""Queries over questions, answers, requests and merged lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import logs
from ..functions import text as T
from ..operators import answers as A
from ..operators import evaluation as E
from ..operators import questions as Q
from ..operators import retrieval as R
from ..functions import guards as G
from ..functions import providers as P
from ..sources.tables import spread, table
from .registry import query
from .retrieval_queries import _BM25

_CHUNKS = "(SELECT doc_id, lang, replace(text, '.' || chr(10), '?' || chr(10)) || ' *' || doc_id || '#' AS text FROM documents)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sentences at line ends are questions, with a short code at the end."""
    text = F.concat(F.replace("text", F.lit(".\n"), F.lit("?\n")), F.lit(" *"), F.col("doc_id").cast("string"), F.lit("#"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", text.alias("text"))


_QA = f"SELECT doc_id, lang, text, {T.sql_strip(T.sql_lines('text') + '[1]')} AS q, {T.sql_strip('array_to_string(' + T.sql_lines('text') + '[2:], chr(10))')} AS a FROM {_CHUNKS}"
_EXACT = Q.EXACT_VALUE.replace("'", "''")


@query(f"SELECT doc_id, q AS question, md5(a) AS answer_digest, regexp_matches(text, '{_EXACT}') AS has_exact_value, regexp_matches(text, '{Q.EXACT_AMOUNT}') AS has_amount FROM ({_QA}) WHERE regexp_matches(q, '[?؟]$') AND length(q) > 8 AND a <> ''")
def extract_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.candidates(_chunks(spark, sf_dir)).select("doc_id", "question", F.md5("answer").alias("answer_digest"), "has_exact_value", "has_amount")


@query(f"""
    WITH c AS (SELECT doc_id, CASE lang WHEN 'es' THEN 'ar' ELSE lang END AS lang, CASE WHEN lang = 'es' AND doc_id % 2 = 0 THEN 'كيف ' ELSE '' END || q AS q FROM ({_QA}) WHERE regexp_matches(q, '[?؟]$')), p AS (SELECT *, lead(q) OVER (PARTITION BY lang ORDER BY doc_id) AS q2 FROM c)
    SELECT doc_id, CASE WHEN lang = 'en' THEN {T.sql_strip("regexp_replace(q, '[?؟]+$', '')")} || ', and ' || lower(left(q2, 1)) || substr(q2, 2) ELSE {T.sql_strip("regexp_replace(q, '[?؟]+$', '')")} || '، و' || q2 END AS combined,
        CASE WHEN lang <> 'ar' THEN 'so like, ' || lower(regexp_replace(q, '\\?+$', '')) || ' or what' WHEN contains(q, 'كيف') THEN replace(replace(q, 'كيف', 'kif'), '؟', '?') ELSE 'kif ' || q END AS informal FROM p WHERE q2 IS NOT NULL
""")
def rewrite_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring questions as one, and informal rewrites; Spanish stands for Arabic, which the tables lack."""
    lang = F.when(F.col("lang") == "es", "ar").otherwise(F.col("lang"))
    asked = F.concat(F.when((F.col("lang") == "es") & (F.col("doc_id") % 2 == 0), "كيف ").otherwise(""), Q.question(F.col("text")))
    rows = _chunks(spark, sf_dir).select("doc_id", lang.alias("lang"), asked.alias("q")).where("q is not null")
    rows = E.with_next(rows, "lang", "doc_id", {"q2": "q"}).where("q2 is not null")
    return rows.select("doc_id", Q.combined(F.col("q"), F.col("q2"), F.col("lang")).alias("combined"), Q.informal(F.col("q"), F.col("lang")).alias("informal"))


@query("SELECT item_id AS rule_id, min(doc_id) AS item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def first_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule_id"), F.col("text").alias("part"))
    return Q.first_containing(rules, spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("item_id"), "text"))


@query("""
    WITH c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS context, min(text) || ' {context}' AS q FROM conversations GROUP BY conv_id)
    SELECT conv_id, md5(replace(replace('Use: {context}' || chr(10) || 'Q: {question}', '{context}', context || ' {question}'), '{question}', q)) AS digest FROM c
""")
def fill_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts from whole conversations; the context holds a question mark-up, which is filled too, and the question a context one, which isn't."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"), F.min("text").alias("q"))
    context = F.concat(F.array_join("t.text", "\n\n"), F.lit(" {question}"))
    return rows.select("conv_id", F.md5(Q.prompt(F.lit("Use: {context}\nQ: {question}"), context, F.concat("q", F.lit(" {context}")))).alias("digest"))


@query("SELECT conv_id, turn, text AS answer, CASE WHEN turn % 2 = 0 THEN 'en' END AS language, CASE WHEN turn % 2 = 0 THEN turn END AS tokens FROM conversations")
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.to_json(F.struct(F.lit("en").alias("language"), F.col("turn").alias("tokens")))
    body = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(Q.MARKER), meta)).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.parsed_response(body, "language string, tokens bigint").alias("r"))
    return rows.select("conv_id", "turn", "r.answer", "r.metadata.language", "r.metadata.tokens")


@query("SELECT doc_id, replace(left(text, 100), chr(10), ' ') AS preview, length(text) > 2000 AS cut FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", Q.preview(F.col("text")).alias("preview"), (F.length("text") > 2000).alias("cut"))


@query()
def merge_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut at 40 characters and put together again where they go on."""
    cut = F.filter(F.split(F.regexp_replace("text", r"(.{30,40}?) ", "$1\n"), "\n"), lambda x: F.trim(x) != "")
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", Q.merge_wrapped(F.transform(cut, lambda x: F.trim(x))).alias("l"))
    return rows.select("doc_id", F.size("l").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


def _sql_splits(line: str) -> str:
    """Whether a line is a heading and its content."""
    words = lambda x: f"len(list_filter(regexp_split_to_array({x}, '{T.SPACE}+'), lambda w: w <> ''))"
    part = lambda pattern, k: T.sql_strip(f"regexp_extract({line}, '{pattern}', {k})")
    general = part(Q.GENERAL_HEADING, 1)
    tests = [f"({general} <> '' AND {words(general)} <= 6 AND NOT regexp_matches({general}, '[.?!:,;]$'))"]
    for start in Q.CONTENT_STARTS:
        pattern = rf"(?i)^(.{{3,60}}?)\s+({start}\b.+)$"
        tests.append(f"({part(pattern, 1)} <> '' AND {words(part(pattern, 1))} <= 8 AND {words(part(pattern, 2))} >= 3)")
    return "(" + " OR ".join(tests) + ")"


@query(f"SELECT doc_id, count(*) AS n_lines, count_if({_sql_splits('line')})::BIGINT AS n_split FROM (SELECT doc_id, 'Data offer ' || unnest({T.sql_lines('text')}) AS line FROM documents) GROUP BY doc_id")
def split_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    parts = lines.select("doc_id", "pos", Q.split_heading(F.concat(F.lit("Data offer "), F.col("line"))).alias("p"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.size("p") == 2).alias("n_split"))


@query()
def twin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as texts, and their reverses or themselves as twins."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("folder"), F.concat_ws("-", "conv_id", "turn").alias("stem"), "turn", "text")
    twins = rows.where("turn % 3 <> 2").select("folder", "stem", F.when(F.col("turn") % 3 == 0, F.reverse("text")).otherwise(F.col("text")).alias("text"))
    return Q.twin_check(rows.drop("turn"), twins).select("stem", F.round("ratio", 6).alias("ratio"), "status")


@query("SELECT user_id, event_id, k FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).alias("k"))
    return rows.where("k <= 5")


@query("SELECT event_id, CASE greatest(a, b, c) WHEN a THEN 'vector' WHEN b THEN 'keyword' ELSE 'generation' END AS slowest, greatest(a, b, c)::BIGINT AS ms FROM (SELECT event_id, event_id % 97 AS a, event_id % 89 AS b, event_id % 101 AS c FROM events)")
def slowest_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    a, b, c = i % 97, i % 89, i % 101
    most = F.greatest(a, b, c)
    return table(spark, sf_dir, "events").select("event_id", F.when(most == a, "vector").when(most == b, "keyword").otherwise("generation").alias("slowest"), most.alias("ms"))


@query("SELECT source, sum(n_chars)::BIGINT AS chars, round(count(*) * 100.0 / sum(n_chars), 6)::DOUBLE AS per_100 FROM documents GROUP BY source")
def token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per 100 characters; documents stand for tokens."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.round(F.count("*") * 100.0 / F.sum("n_chars"), 6).alias("per_100"))


@query(f"""
    WITH {_BM25}, a AS (SELECT item_id AS query_id, text AS question, CASE WHEN regexp_matches(text, '(?i)\\b({T.FUNCTION_WORDS})\\b') OR regexp_matches(text, '{T.DIGIT_AS_LETTER}') THEN true ELSE false END AS arabizi FROM benchmark),
    f AS (SELECT query_id, max(score / (score + 10)) AS confidence, list_sort(list(DISTINCT source)) AS sources FROM rk JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id),
    d AS (SELECT a.query_id, CASE WHEN length(trim(question)) = 0 OR length(trim(question)) > 1000 THEN 400 ELSE 200 END AS status, CASE WHEN arabizi THEN 'ar' ELSE 'en' END AS language, arabizi, confidence, sources,
        CASE WHEN length(trim(question)) = 0 OR length(trim(question)) > 1000 THEN 'invalid' WHEN a.query_id % 9 = 0 THEN 'out_of_domain' WHEN a.query_id % 7 = 0 THEN 'ambiguous' WHEN coalesce(confidence >= CASE WHEN arabizi THEN 0.05 ELSE 0.6 END, false) THEN 'answer_normally' ELSE 'no_info' END AS action
        FROM a LEFT JOIN f USING (query_id))
    SELECT query_id, status, language, action, CASE WHEN action <> 'invalid' THEN round(confidence, 6) END AS confidence, CASE WHEN action = 'answer_normally' THEN CASE WHEN confidence >= 0.65 THEN 'small' ELSE 'main' END END AS model,
        CASE WHEN action = 'answer_normally' THEN array_to_string(sources, ',') END AS sources FROM d
""")
def ask_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as questions: validation, language, search, decision and routing; BM25 squashed to 0..1 stands for similarity, ids for verdicts."""
    bench = table(spark, sf_dir, "benchmark")
    null = lambda t: F.lit(None).cast(t)
    asked = Q.requests(bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), null("string").alias("language"), null("int").alias("top_k"), null("string").alias("mode"), null("string").alias("embedding_backend")))
    i = F.col("item_id")
    verdicts = bench.where(i % 5 != 4).select(i.alias("query_id"), (i % 9 != 0).alias("in_domain"), F.lit(False).alias("needs_account_data"), (i % 7 == 0).alias("is_ambiguous"), F.lit("Which?").alias("clarifying_question"))
    verdicts = verdicts.unionByName(bench.where(i % 5 == 4).where((i % 9 == 0) | (i % 7 == 0)).select(i.alias("query_id"), (i % 9 != 0).alias("in_domain"), null("boolean").alias("needs_account_data"), (i % 7 == 0).alias("is_ambiguous"), F.lit("Which?").alias("clarifying_question")))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = R.bm25(docs, bench.select(i.alias("query_id"), "text"), 5)
    found = found.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("query_id", "rank", "source", (F.col("score") / (F.col("score") + 10)).alias("similarity"))
    out = Q.ask(asked, verdicts, found)
    return out.withColumns({"confidence": F.round("confidence", 6), "sources": F.array_join("sources", ",")})


@query(f"""
    WITH b AS (SELECT conv_id, turn, text || chr(10) || '{Q.MARKER}' || '{{"language":"en","turn":' || turn || ',"sources":["a","b"],"match_type":null}}' AS body FROM conversations) SELECT conv_id, turn, md5(body) AS digest FROM b
""")
def response_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.struct(F.lit("en").alias("language"), F.col("turn").alias("turn"), F.array(F.lit("a"), F.lit("b")).alias("sources"), F.lit(None).cast("string").alias("match_type"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(A.body(F.col("text"), meta)).alias("digest"))


@query(f"SELECT conv_id, turn, regexp_replace(lower({T.sql_strip('t')}), '{T.SPACE}+', ' ', 'g') AS key FROM (SELECT conv_id, turn, '  ' || replace(text, ' ', chr(9) || ' ') || chr(10) AS t FROM conversations)")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("\t ")), F.lit("\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", A.cache_key(said).alias("key"))


@query("""
    WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, text, role AS source FROM conversations)
    SELECT conv_id AS query_id, md5(string_agg('[Source ' || rank || ': ' || source || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS judged,
        string_agg(CASE WHEN rank <= 5 THEN '- ' || left(text, 220) END, chr(10) ORDER BY rank) AS preview, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM r GROUP BY conv_id
""")
def answer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as results: the context for a prompt, for a judge, and the preview for a classifier."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.row_number().over(w).alias("rank"), "text", F.col("role").alias("source"))
    return A.contexts(rows).select("query_id", F.md5("context").alias("context"), F.md5("judged").alias("judged"), "preview", F.array_join("sources", ",").alias("sources"))


@query("""
    SELECT event_id, '[ask] lang=' || event_type || CASE WHEN event_id % 3 > 0 THEN ' vector=' || (event_id % 97) || 'ms' ELSE '' END AS line, CASE WHEN user_id * 7 < 1000 THEN (user_id * 7) || ' ms' ELSE format('{:.1f} s', user_id * 7 / 1000.0::DOUBLE) END AS took,
        CASE WHEN length(event_type) > 4 THEN left(event_type, 4) || '…' ELSE event_type END AS short, '&lt;b&gt;' || event_type || ' &amp; co&lt;/b&gt;' AS html FROM events
""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    said = F.concat_ws(" ", logs.line("ask", lang=F.col("event_type")), F.nullif(logs.timings(vector=F.when(i % 3 > 0, i % 97)), F.lit("")))
    return table(spark, sf_dir, "events").select("event_id", said.alias("line"), logs.duration(F.col("user_id") * 7).alias("took"), logs.shortened(F.col("event_type"), 4).alias("short"), logs.escaped(F.concat(F.lit("<b>"), "event_type", F.lit(" & co</b>"))).alias("html"))


@query("""
    WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"in_domain": false}' WHEN 1 THEN 'So: {"is_ambiguous": true, "clarifying_question": "q"} there' WHEN 2 THEN 'none' END AS raw FROM documents)
    SELECT doc_id, doc_id % 4 <> 0 AS in_domain, doc_id % 4 = 1 AS is_ambiguous, CASE WHEN doc_id % 4 = 1 THEN 'q' ELSE '' END AS clarifying_question FROM r
""")
def verdict_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raw = F.when(i % 4 == 0, F.lit('{"in_domain": false}')).when(i % 4 == 1, F.lit('So: {"is_ambiguous": true, "clarifying_question": "q"} there')).when(i % 4 == 2, "none")
    found = G.salvaged(raw, "in_domain boolean, is_ambiguous boolean, clarifying_question string", {"in_domain": True, "is_ambiguous": False, "clarifying_question": ""})
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("v")).select("doc_id", "v.*")


@query()
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path from passages as questions to prompts and response bodies. Some are blank, vague or in the cache; vectors are hashed ones. Tests follow it by hand."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    index = R.build_index(docs)
    blocks = R.vector_blocks(R.index_embeddings(index))
    near = lambda q, k: R.vector_search(blocks, P.embed(q).select(F.col("query_id").alias("id"), F.col("embedding").alias("vec")), k).withColumnRenamed("vec_id", "doc_id")
    bench, i, null = table(spark, sf_dir, "benchmark"), F.col("item_id"), lambda t: F.lit(None).cast(t)
    asked = bench.select(i.alias("query_id"), F.when(i % 11 == 0, " ").when(i % 11 == 1, "??").otherwise(F.col("text")).alias("question"), null("string").alias("language"), null("int").alias("top_k"), null("string").alias("mode"), null("string").alias("embedding_backend"))
    asked = P.embed(asked.withColumn("said", F.coalesce("question", F.lit(""))), "said").withColumnRenamed("embedding", "vec").drop("said")
    known = P.embed(bench.where(i % 5 == 0).select(i.alias("id"), "text")).select("id", A.cache_key(F.col("text")).alias("key"), F.col("embedding").alias("vec"), F.concat(F.lit("Answer "), F.col("id").cast("string")).alias("answer"), F.array(F.lit("cache")).alias("sources"))
    verdicts = bench.select(i.alias("query_id"), (i % 9 != 0).alias("in_domain"), F.lit(False).alias("needs_account_data"), (i % 7 == 0).alias("is_ambiguous"), F.lit("Which one?").alias("clarifying_question"))
    templates = spark.createDataFrame([("en", "Use {context} for {question}"), ("ar", "{context} ؟ {question}")], "language string, template string")
    rows = A.ask(asked, known, near, lambda q, k: R.bm25_search(index, q, k), docs, verdicts, templates, similarity=0.9999)
    return rows.select("query_id", "status", "action", "match_type", "language", "model", F.md5("prompt").alias("prompt"), "text", F.md5("body").alias("body"))
