"""Queries over texts, lines and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import lines as L
from ..operators import questions as Q
from ..sources import corpus, html
from ..sources.tables import SQL_ARABIC, arabic, spread, table
from .registry import query

A = f"(SELECT doc_id, {SQL_ARABIC} AS text, lang, source FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _arabic_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("text", arabic(F.col("text")))


@query(f"SELECT doc_id, md5({T.sql_normalize('text')}) AS digest, length({T.sql_normalize('text')}) AS n_chars FROM {A}")
def normalize_arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arabic_docs(spark, sf_dir).select("doc_id", T.normalize_arabic(F.col("text")).alias("t"))
    return rows.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n_chars"))


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {T.sql_tokens('text')} AS t FROM {A})")
def tokenize_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arabic_docs(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT len(t) AS n_tokens, t[1] AS code, doc_id FROM (SELECT doc_id, {T.sql_tokens('code')} AS t FROM (SELECT doc_id, '*' || doc_id || '*١٢# dial' AS code FROM documents))")
def short_code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.concat(F.lit("*"), F.col("doc_id").cast("string"), F.lit("*١٢# dial"))).alias("t"))
    return rows.select(F.size("t").alias("n_tokens"), F.try_element_at("t", F.lit(1)).alias("code"), "doc_id")


_LINES = f"(SELECT doc_id, pos, {T.sql_normalize_line('line')} AS line FROM (SELECT doc_id, generate_subscripts({T.sql_lines('text')}, 1) - 1 AS pos, unnest({T.sql_lines('text')}) AS line FROM documents) WHERE {T.sql_normalize_line('line')} <> '')"
_JOINED = "SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM"


def _digest(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("lines") > 0).select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@query(f"{_JOINED} (SELECT *, lag({T.sql_key('line')}) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM {_LINES}) WHERE before IS DISTINCT FROM {T.sql_key('line')} GROUP BY doc_id")
def dedupe_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(L.without_consecutive(L.with_lines(_docs(spark, sf_dir))))


@query(f"{_JOINED} (SELECT *, length(line) <= 100 AS short, row_number() OVER (PARTITION BY doc_id, length(line) <= 100, {T.sql_key('line')} ORDER BY pos) AS n FROM {_LINES}) WHERE NOT short OR n = 1 GROUP BY doc_id")
def dedupe_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(L.without_repeated_short(L.with_lines(_docs(spark, sf_dir))))


@query(f"{_JOINED} (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS n FROM {_LINES}) WHERE n = 1 GROUP BY doc_id")
def dedupe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(L.first_of_each(L.with_lines(_docs(spark, sf_dir))))


@query(f"""
    WITH l AS (SELECT * FROM {_LINES} WHERE NOT {T.sql_boilerplate('line')}),
    c AS (SELECT * FROM (SELECT *, lag({T.sql_key('line')}) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l) WHERE before IS DISTINCT FROM {T.sql_key('line')}),
    s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, length(line) <= 100, {T.sql_key('line')} ORDER BY pos) AS n FROM c) WHERE length(line) > 100 OR n = 1),
    j AS (SELECT doc_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY pos) AS text FROM s GROUP BY doc_id)
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, md5(coalesce(text, '')) AS digest, CASE WHEN text IS NULL THEN 'rejected' ELSE 'ok' END AS status FROM documents d LEFT JOIN j USING (doc_id)
""".replace("FROM documents d LEFT JOIN j USING (doc_id)", "FROM (SELECT doc_id FROM documents) d LEFT JOIN j USING (doc_id)"))
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cleaned(_docs(spark, sf_dir)).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.md5("text").alias("digest"), "status")


_FIXED = "list_transform(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1 ELSE ceil((length(text) - 200) / 800.0)::BIGINT END), lambda i: substr(text, i * 800 + 1, 1000))"


@query(f"SELECT doc_id, i - 1 AS chunk_index, length(c) AS char_count, md5(c) AS digest FROM (SELECT doc_id, generate_subscripts({_FIXED}, 1) AS i, unnest({_FIXED}) AS c FROM documents) WHERE {T.sql_strip('c')} <> ''")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks(_docs(spark, sf_dir), "fixed").select("doc_id", "chunk_index", F.length("text").alias("char_count"), F.md5("text").alias("digest"))


_SENTENCES = f"list_filter(string_split(regexp_replace(text, '([.!?؟]){T.SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_PACKED = f"""list_reduce(list_transform({_SENTENCES}, lambda s: {{'done': []::VARCHAR[], 'open': s}}), lambda a, b:
    CASE WHEN a.open = '' OR length(a.open || ' ' || b.open) <= 1000 THEN {{'done': a.done, 'open': CASE WHEN a.open = '' THEN b.open ELSE a.open || ' ' || b.open END}}
    ELSE {{'done': list_append(a.done, a.open), 'open': b.open}} END, {{'done': []::VARCHAR[], 'open': ''}})"""


@query(f"""
    WITH p AS (SELECT doc_id, {_PACKED} AS p FROM documents), c AS (SELECT doc_id, CASE WHEN p.open = '' THEN p.done ELSE list_append(p.done, p.open) END AS c FROM p)
    SELECT doc_id, i - 1 AS chunk_index, length(t) AS char_count, md5(t) AS digest FROM (SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS t FROM c) WHERE {T.sql_strip('t')} <> ''
""")
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks(_docs(spark, sf_dir), "sentence").select("doc_id", "chunk_index", F.length("text").alias("char_count"), F.md5("text").alias("digest"))


_IMP, _CON, _YN = T.sql_list(C.IMPERATIVES), T.sql_list(C.CONNECTORS), T.sql_list(C.YES_NO)
_STRUCTURE = f"""
    WITH l AS (SELECT doc_id, pos, {T.sql_strip('line')} AS line FROM (SELECT doc_id, generate_subscripts({T.sql_lines('t')}, 1) AS pos, unnest({T.sql_lines('t')}) AS line FROM (SELECT doc_id, replace(text, '.' || chr(10), '?' || chr(10)) AS t FROM documents)) WHERE {T.sql_strip('line')} <> ''),
    c AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after, regexp_split_to_array(lower(line), ' +') AS words FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    f AS (SELECT *, ends_with(line, '?') OR coalesce(length(line) BETWEEN 3 AND 50 AND NOT regexp_matches(line, '[.?؟:,،]$') AND (before IS NULL OR (regexp_matches(before, '[.?؟]$') AND NOT ends_with(before, '?')))
            AND NOT list_has_any(list_transform(words[1:3], lambda w: trim(w, '().,')), [{_IMP}]) AND line NOT IN ({_YN}) AND NOT regexp_matches(line, '[,،]') AND words[1] NOT IN ({_CON})
            AND length(after) >= length(line) * 1.8 AND regexp_matches(after, '[.?؟)]$') AND len(words) < 5, false) AS split FROM c),
    g AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND split THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk_index FROM f)
    SELECT doc_id, chunk_index::INT AS chunk_index, length(string_agg(line, chr(10) ORDER BY pos)) AS char_count, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM g GROUP BY doc_id, chunk_index
"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sentences at line ends are questions, as the tables have none."""
    return _docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit(".\n"), F.lit("?\n")).alias("text"), F.lit("en").alias("language"))


@query(_STRUCTURE)
def chunk_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks(_questions(spark, sf_dir), "structure").select("doc_id", "chunk_index", F.length("text").alias("char_count"), F.md5("text").alias("digest"))


_SCRIPT = "replace(replace(translate(text, 'aeiou123', 'اةأإآ١٢۳'), 'Th', 'كيف '), '.' || chr(10), '؟' || chr(10))"


@query(f"""
    WITH l AS (SELECT doc_id, pos, {T.sql_strip('line')} AS line FROM (SELECT doc_id, generate_subscripts({T.sql_lines('t')}, 1) AS pos, unnest({T.sql_lines('t')}) AS line FROM (SELECT doc_id, {_SCRIPT} AS t FROM documents)) WHERE {T.sql_strip('line')} <> ''),
    c AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after, regexp_split_to_array(lower(line), ' +') AS words, regexp_matches(line, '[?؟]$') AND regexp_matches(line, '{C.ARABIC_QUESTION}') AS asks FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    f AS (SELECT *, asks OR coalesce(length(line) BETWEEN 3 AND 50 AND NOT regexp_matches(line, '[.?؟:,،]$') AND (before IS NULL OR (regexp_matches(before, '[.?؟]$') AND NOT (regexp_matches(before, '[?؟]$') AND regexp_matches(before, '{C.ARABIC_QUESTION}'))))
            AND NOT list_has_any(list_transform(words[1:3], lambda w: trim(w, '().,')), [{_IMP}]) AND line NOT IN ({_YN}) AND NOT regexp_matches(line, '[,،]')
            AND NOT CASE WHEN regexp_matches(line, '[{T.ARABIC}]') THEN regexp_matches(words[1], '{C.ARABIC_CONNECTORS}') AND length(words[1]) <= 8 ELSE words[1] IN ({_CON}) END
            AND length(after) >= length(line) * 1.8 AND regexp_matches(after, '[.?؟)]$') AND len(words) < 5, false) AS split FROM c),
    g AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND split THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk_index FROM f)
    SELECT doc_id, chunk_index::INT AS chunk_index, length(string_agg(line, chr(10) ORDER BY pos)) AS char_count, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM g GROUP BY doc_id, chunk_index
""")
def chunk_structure_arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in Arabic letters, some of whose lines are questions."""
    text = F.replace(F.replace(arabic(F.col("text")), F.lit("Th"), F.lit("كيف ")), F.lit(".\n"), F.lit("؟\n"))
    rows = _docs(spark, sf_dir).select("doc_id", text.alias("text"), F.lit("ar").alias("language"))
    return C.chunks(rows, "structure").select("doc_id", "chunk_index", F.length("text").alias("char_count"), F.md5("text").alias("digest"))


@query(f"""
    WITH s AS ({_STRUCTURE}), d AS (SELECT doc_id, lang FROM documents), f AS (SELECT doc_id, length(c) AS n FROM (SELECT doc_id, unnest({_FIXED}) AS c FROM documents) WHERE {T.sql_strip('c')} <> ''),
    a AS (SELECT 'fixed' AS strategy, doc_id, n FROM f UNION ALL SELECT 'structure', doc_id, char_count FROM s)
    SELECT strategy, lang, count(*) AS n_chunks, round(avg(n), 4) AS avg_chars, max(n) AS max_chars, round(avg(n / 4.0), 4) AS avg_tokens FROM a JOIN d USING (doc_id) GROUP BY strategy, lang
""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = C.chunks(_docs(spark, sf_dir), "fixed").select(F.lit("fixed").alias("strategy"), "doc_id", F.length("text").alias("n"))
    parts = fixed.unionByName(C.chunks(_questions(spark, sf_dir), "structure").select(F.lit("structure").alias("strategy"), "doc_id", F.length("text").alias("n")))
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return parts.join(langs, "doc_id").groupBy("strategy", "lang").agg(F.count("*").alias("n_chunks"), F.round(F.avg("n"), 4).alias("avg_chars"), F.max("n").alias("max_chars"), F.round(F.avg(F.col("n") / 4), 4).alias("avg_tokens"))


@query(f"SELECT lang, source, count(*) AS n, sum(CASE WHEN coalesce(a / nullif(a + l, 0), 0) >= 0.3 THEN 1 ELSE 0 END)::BIGINT AS n_ar FROM (SELECT lang, source, len(regexp_extract_all(text, '[{T.ARABIC}]')) AS a, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM {A}) GROUP BY lang, source")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arabic_docs(spark, sf_dir).select("lang", "source", T.language(F.col("text")).alias("found"))
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("found") == "ar").alias("n_ar"))


@query(rf"SELECT conv_id, turn, NOT regexp_matches(t, '{T.ARABIC_LETTER}') AND len(regexp_extract_all(t, '[A-Za-z]')) >= 3 AND (regexp_matches(t, '{T.DIGIT_AS_LETTER}') OR regexp_matches(t, '(?i)\b({T.FUNCTION_WORDS})\b')) AS is_arabizi FROM (SELECT conv_id, turn, replace(coalesce(text, ''), 'ein', '3ein') AS t FROM conversations)")
def detect_arabizi(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.replace(F.coalesce("text", F.lit("")), F.lit("ein"), F.lit("3ein"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_arabizi(said).alias("is_arabizi"))


@query("SELECT conv_id, turn, length(t) < 3 OR len(list_distinct(regexp_extract_all(t, '\\p{L}'))) <= 1 AS is_vague FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN left(text, 2) WHEN 1 THEN repeat(left(text, 1), 5) ELSE text END AS t FROM conversations)")
def too_vague(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, F.left("text", F.lit(2))).when(F.col("turn") % 3 == 1, F.repeat(F.left("text", F.lit(1)), F.lit(5))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_vague(text).alias("is_vague"))


@query("SELECT doc_id, substr(sha256('corpus/' || source || '/' || doc_id || '.html' || text), 1, 16) AS file_id, format('{}_{:03d}', doc_id, doc_id % 1500) AS chunk_id, ('0x' || substr(sha256(format('{}_{:03d}', doc_id, doc_id % 1500)), 1, 12))::BIGINT AS point_id FROM documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".html"))
    chunk = C.chunk_id(F.col("doc_id").cast("string"), F.col("doc_id") % 1500)
    return table(spark, sf_dir, "documents").select("doc_id", corpus.doc_id(path, F.encode("text", "UTF-8")).alias("file_id"), chunk.alias("chunk_id"), corpus.point_id(chunk).alias("point_id"))


def _sql_page_line(x: str) -> str:
    return T.sql_strip(rf"regexp_replace(replace(replace(replace(replace(replace({x}, chr(160), ' '), chr(8203), ''), chr(8204), ''), chr(8205), ''), chr(65279), ''), '[ \t]+', ' ', 'g')")


def _sql_page_key(x: str) -> str:
    return T.sql_strip(f"regexp_replace(regexp_replace(replace(lower({_sql_page_line(x)}), 'ß', 'ss'), '{T.SPACE}+', ' ', 'g'), '{L.LEADING_BULLETS}', '')")


_NOISE = f"""(line = '' OR regexp_matches(line, '{T.DECORATIVE}') OR regexp_matches(line, '{L.PAGE_NUMBERS[0]}') OR regexp_matches(line, '{L.PAGE_NUMBERS[1]}') OR low IN ({T.sql_list(L.PAGE_UI)}) OR regexp_matches(low, '{L.PAGE_UI_STARTS}')
    OR regexp_replace(low, '{T.SPACE}+', '', 'g') IN ({T.sql_list(L.LANGUAGE_CONTROLS)}) OR regexp_matches(line, '{L.BREADCRUMB}') OR low IN ({T.sql_list(L.CALLS_TO_ACTION)}))"""
#: Lines of blocks in which the words of some lines stand for page furniture, as the tables have none.
_FURNITURE = "replace(replace(replace(text, 'The ', '- '), 'and ', 'Home' || chr(10)), 'es ', '12.' || chr(10))"
_BLOCKS = f"""(SELECT * FROM (SELECT *, {T.sql_strip('lower(line)')} AS low FROM (SELECT doc_id, ((i - 1) // 32)::INT AS page, ((i - 1) // 8)::INT AS block, i AS pos, {_sql_page_line('l')} AS line
    FROM (SELECT doc_id, generate_subscripts({T.sql_lines('t')}, 1) AS i, unnest({T.sql_lines('t')}) AS l FROM (SELECT doc_id, {_FURNITURE} AS t FROM documents)))) WHERE NOT {_NOISE})"""
_NAV = f"""(SELECT doc_id, page, block, n_lines, n_lines >= 5 AND longest < 15 AND (nav >= 2 OR (short >= 0.85 * n_lines AND bullets >= 0.15 * n_lines) OR short >= 0.9 * n_lines) AS is_nav
    FROM (SELECT doc_id, page, block, count(*) AS n_lines, max(w) AS longest, count_if(low IN ({T.sql_list(L.NAV_LINES)})) AS nav, count_if(w <= 6) AS short, count_if(regexp_matches(line, '{L.BULLET}')) AS bullets
          FROM (SELECT *, len(list_filter(regexp_split_to_array(line, '{T.SPACE}+'), lambda x: x <> '')) AS w FROM {_BLOCKS}) GROUP BY doc_id, page, block))"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.replace(F.replace("text", F.lit("The "), F.lit("- ")), F.lit("and "), F.lit("Home\n")), F.lit("es "), F.lit("12.\n"))
    return L.paged(_docs(spark, sf_dir).select("doc_id", text.alias("text")))


@query(f"SELECT * FROM {_NAV}")
def nav_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.nav_blocks(L.with_clean_blocks(_pages(spark, sf_dir)))


_KEYS = f"(SELECT doc_id, page, block, {_sql_page_key('text')} AS block_key FROM (SELECT doc_id, page, block, string_agg(line, ' ' ORDER BY pos) AS text FROM {_BLOCKS} GROUP BY doc_id, page, block))"
_REPEATED = f"SELECT doc_id, block_key, count(DISTINCT page) AS n_pages FROM %s WHERE block_key <> '' AND len(string_split(block_key, ' ')) <= {L.MOST_WORDS} GROUP BY doc_id, block_key HAVING count(DISTINCT page) >= 2"


@query(_REPEATED % _KEYS)
def repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.repeated_blocks(L.with_clean_blocks(_pages(spark, sf_dir)))


@query(f"""
    WITH k AS MATERIALIZED (SELECT k.* FROM {_KEYS} k JOIN {_NAV} n USING (doc_id, page, block) WHERE NOT is_nav), r AS ({_REPEATED % 'k'}),
    l AS (SELECT b.* FROM {_BLOCKS} b JOIN k USING (doc_id, page, block) WHERE (doc_id, block_key) NOT IN (SELECT doc_id, block_key FROM r) AND low NOT IN ({T.sql_list(L.NAV_LINES)})),
    c AS (SELECT * FROM (SELECT *, lag(key) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM (SELECT *, {_sql_page_key('line')} AS key FROM l) WHERE key <> '') WHERE before IS DISTINCT FROM key)
    SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM c GROUP BY doc_id
""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line path of paged documents up to its removal of consecutive repeats."""
    return _digest(L.without_consecutive_page_lines(L.page_lines(_pages(spark, sf_dir))))


@query()
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole line path: headings split, wrapped lines merged. Tests compare it with plain Python."""
    rows = Q.page_texts(_pages(spark, sf_dir))
    return rows.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "status", "reject_reason")


@query()
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.extract_html(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return rows.select("page_id", F.length("text").alias("n_chars"), F.size(F.split("text", "\n")).alias("n_lines"), F.md5("text").alias("digest"), "status", "reject_reason")


@query("SELECT page_id, 'rejected' AS status, 'no boundary' AS reject_reason FROM pages WHERE NOT contains(lower(html), '<main') AND length(trim(html)) > 0")
def html_strict_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.extract_html(spread(table(spark, sf_dir, "pages").select("page_id", "html")), boundaries=("main",))
    return rows.where("status = 'rejected'").select("page_id", "status", "reject_reason")
