"""Questions and answers: extraction from chunks, rewrites, prompts, responses, merged and split lines, request batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import guards as G
from ..functions import text as T
from . import lines as L

# Patterns and word lists.
EXACT_VALUE = r"\*[0-9]+#|دينار|JOD|\b(?:fee|fees)\b|رسوم|limit|الحد\b|حد\s"
EXACT_AMOUNT = r"(?i)\*[0-9]+#|[0-9]+\s*(?:دينار|JD|جنيه|%|دقيقه|دقيقة|minute|GB|جيجا|ميجا|MB)"
CODE = r"\*[0-9]+(?:\*[0-9]+)*#"
DANGLING = ("and", "or", "with", "from", "to", "for", "of", "on", "in", "at", "by", "من", "في", "على", "إلى", "عن", "مع", "أو", "و")
CONTINUING = ("and", "or", "with", "from", "to", "for", "of", "on", "in", "after", "before", "while", "when", "that", "which", "the", "a", "an", "is", "are", "من", "في", "على", "إلى", "عن", "مع", "أو", "و")
CONTENT_STARTS = ("A secured", "With pay monthly offers", "To stay connected", "Once you", "You can", "You can benefit", "Reduced calling rates", "Because we", "Need help")
GENERAL_HEADING = r"^([A-Z0-9][A-Za-z0-9\s\-&]{2,45})\s+([A-Z][a-z0-9].{15,})$"
MARKER = "\n---METADATA---\n"


def question(text: Column) -> Column:
    """The first line if it ends in a question mark, else null."""
    first = T.strip(T.lines(text)[0])
    return F.when(first.rlike("[?؟]$"), first)


def answer(text: Column) -> Column:
    """All lines but the first."""
    lines = T.lines(text)
    return T.strip(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))


def candidates(chunks: DataFrame) -> DataFrame:
    """chunks (…, text) that are a question of more than 8 characters with an answer, with question, answer, has_exact_value and has_amount."""
    rows = chunks.withColumns({"question": question(F.col("text")), "answer": answer(F.col("text"))})
    rows = rows.where((F.length("question") > 8) & (F.col("answer") != ""))
    return rows.withColumns({"has_exact_value": F.col("text").rlike(EXACT_VALUE), "has_amount": F.col("text").rlike(EXACT_AMOUNT)})


def combined(first: Column, second: Column, language: Column) -> Column:
    """Two questions as one: the first without its mark, a joiner, and in English the second with a small first letter."""
    bare = T.strip(F.regexp_replace(first, "[?؟]+$", ""))
    small = F.concat(F.lower(F.left(second, F.lit(1))), F.substring(second, F.lit(2), F.length(second)))
    return F.when(language == "en", F.concat(bare, F.lit(", and "), small)).otherwise(F.concat(bare, F.lit("، و"), second))


def informal(text: Column, language: Column) -> Column:
    """A rewrite in informal English, or of Arabic with a Latin question word."""
    replaced = F.replace(F.replace(text, F.lit("كيف"), F.lit("kif")), F.lit("؟"), F.lit("?"))
    arabic = F.when(replaced == text, F.concat(F.lit("kif "), text)).otherwise(replaced)
    english = F.concat(F.lit("so like, "), F.lower(F.regexp_replace(text, r"\?+$", "")), F.lit(" or what"))
    return F.when(language == "ar", arabic).otherwise(english)


def containing(rules: DataFrame, items: DataFrame) -> DataFrame:
    """(rule_id, item_id) of all items (item_id, text) that hold the part of one of rules (rule_id, part).

    What holds a part holds its inner words whole, so items are found by the longest of these and then tested. Only parts
    of fewer than three words, which have no inner one, are sought in every item.
    """
    words = F.split("part", T.SPACE + "+")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    keyed = rules.select("rule_id", "part", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("w"))))["w"].alias("word"))
    held = items.select("item_id", "text", F.explode(F.array_distinct(F.split("text", T.SPACE + "+"))).alias("word"))
    found = held.join(keyed.where("word is not null"), "word").where(F.contains("text", "part")).select("rule_id", "item_id")
    bare = keyed.where("word is null").select("rule_id", "part")
    return found if bare.isEmpty() else found.unionByName(items.join(bare, F.contains("text", "part")).select("rule_id", "item_id"))


def first_containing(rules: DataFrame, items: DataFrame) -> DataFrame:
    """(rule_id, item_id): for each of rules (rule_id, part) the first of items (item_id, text) that holds its part; rules without one are left out."""
    return containing(rules, items).groupBy("rule_id").agg(F.min("item_id").alias("item_id"))


def prompt(template: Column, context: Column, asked: Column) -> Column:
    """The template with {context} filled first, then {question}, so a question mark-up inside the context is filled as well."""
    return F.replace(F.replace(template, F.lit("{context}"), context), F.lit("{question}"), asked)


def parsed_response(body: Column, schema: str) -> Column:
    """answer: what stands before the marker; metadata: the JSON after it, null without one."""
    at = F.instr(body, MARKER)
    before = F.left(body, at - 1)
    text = F.when(at > 0, F.when(before.endswith("\n"), F.left(before, F.length(before) - 1)).otherwise(before)).otherwise(body)  # a writer may leave a blank line
    after = F.when(at > 0, F.substring(body, at + len(MARKER), F.length(body)))
    return F.struct(text.alias("answer"), F.from_json(after, schema).alias("metadata"))


def preview(text: Column, n: int = 100) -> Column:
    return F.replace(F.left(text, F.lit(n)), F.lit("\n"), F.lit(" "))


def _words(x: Column) -> Column:
    return F.filter(F.split(x, T.SPACE + "+"), lambda w: w != "")


def split_heading(line: Column) -> Column:
    """One line, or a heading and the content that was merged to it. Patterns of single beginnings run only where a line holds one."""
    head, rest = F.regexp_extract(line, GENERAL_HEADING, 1), F.regexp_extract(line, GENERAL_HEADING, 2)
    general = T.once(T.strip(head), lambda h: F.when((h != "") & (F.size(_words(h)) <= 6) & ~h.rlike("[.?!:,;]$"), F.array(h, T.strip(rest))).otherwise(F.array(line)))
    out = general
    for start in reversed(CONTENT_STARTS):
        pattern = rf"(?i)^(.{{3,60}}?)\s+({start}\b.+)$"
        head, rest = T.strip(F.regexp_extract(line, pattern, 1)), T.strip(F.regexp_extract(line, pattern, 2))
        out = F.when((head != "") & (F.size(_words(head)) <= 8) & (F.size(_words(rest)) >= 3), F.array(head, rest)).otherwise(out)
    return F.when(line.rlike("(?i)" + "|".join(CONTENT_STARTS)), out).otherwise(general)


def _marks(line: Column) -> Column:
    """What merging asks of a line: found once for each, however long the lines get that it is merged into."""
    return T.once(_words(line), lambda words: F.struct(
        line.alias("line"), ((line == "") | line.rlike("^(?:[•◦▪▫●○■□]|- )") | line.rlike(CODE) | line.rlike("https?://")).alias("lone"), F.size(words).alias("n"),
        line.rlike("[.?!:]$").alias("closed"), line.rlike("[,;–-]$").alias("open"), F.lower(F.get(words, F.size(words) - 1)).isin(*DANGLING).alias("dangling"),
        (line.rlike(r"^\p{Ll}") | F.lower(F.get(words, F.lit(0))).isin(*CONTINUING)).alias("goes"),
    ))


def _continues(before: Column, line: Column) -> Column:
    """Whether a line goes on with the one before it, which may be merged already: a merged line holds no bullet, code or link, and ends as its last part."""
    short = (before["n"] <= 8) & (F.length(before["line"]) <= 60) & ~before["open"] & ~before["dangling"]
    return ~(before["lone"] | line["lone"] | before["closed"] | short) & (before["open"] | line["goes"])


def merge_wrapped(lines: Column) -> Column:
    """Lines of an array, wrapped ones put together: a fold, as what a line goes on with is what was merged so far."""
    kept = ("n", "closed", "open", "dangling")

    def step(acc: Column, x: Column) -> Column:
        before = acc["last"]
        both = F.struct(F.concat(F.rtrim(before["line"]), F.lit(" "), F.ltrim(x["line"])).alias("line"), F.lit(False).alias("lone"), (before["n"] + x["n"]).alias("n"), x["closed"].alias("closed"), x["open"].alias("open"), F.when(x["n"] > 0, x["dangling"]).otherwise(before["dangling"]).alias("dangling"))
        alone = F.struct(x["line"].alias("line"), x["lone"].alias("lone"), *[x[c].alias(c) for c in kept])
        done = F.when(acc["empty"], acc["done"]).otherwise(F.array_append(acc["done"], before["line"]))
        on = ~acc["empty"] & F.coalesce(_continues(before, x), F.lit(False))
        return F.when(on, F.struct(acc["done"].alias("done"), both.alias("last"), F.lit(False).alias("empty"))).otherwise(F.struct(done.alias("done"), alone.alias("last"), F.lit(False).alias("empty")))

    none = lambda kind: F.lit(None).cast(kind)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.struct(none("string").alias("line"), none("boolean").alias("lone"), none("int").alias("n"), *[none("boolean").alias(c) for c in kept[1:]]).alias("last"), F.lit(True).alias("empty"))
    whole = lambda xs: F.aggregate(xs, start, step, lambda a: F.when(a["empty"], a["done"]).otherwise(F.array_append(a["done"], a["last"]["line"])))
    return T.once(F.transform(lines, _marks), whole)


def page_texts(rows: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """rows (…, blocks) with text, status and reject_reason in place of their raw blocks of (page, block, text): the whole line path of a paged document.

    A document without a usable block, or of which nothing is left, is rejected. Names in `also` count as user-interface and navigation lines.
    """
    rows = L.page_lines(rows, also)
    rows = L.settled(rows.withColumn("lines", F.flatten(F.transform("lines", split_heading))), "lines")
    rows = L.without_consecutive_page_lines(rows)
    rows = L.settled(rows.withColumn("text", T.strip(F.array_join(merge_wrapped(F.col("lines")), "\n"))), "text")
    reason = F.when(~F.col("has_blocks"), "no usable text layer").when(F.col("text") == "", "no text")
    return rows.withColumns({"reject_reason": reason, "status": F.when(reason.isNull(), "ok").otherwise("rejected")}).drop("lines", "has_blocks")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's similarity; null without a twin."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def twin_check(pdfs: DataFrame, pages: DataFrame, least: float = 0.5) -> DataFrame:
    """pdfs (folder, stem, text) with ratio to the page of the same folder and stem and status; without a twin they pass."""
    rows = pdfs.join(pages.select("folder", "stem", F.col("text").alias("twin")), ["folder", "stem"], "left").withColumn("ratio", sequence_ratio("text", "twin"))
    return rows.drop("twin").withColumn("status", F.when(F.col("ratio") < least, "rejected").otherwise("ok"))


def requests(questions: DataFrame, top_k: int = 10) -> DataFrame:
    """Questions (question, language, top_k, mode, embedding_backend) with defaults filled in (0 and '' count as none), HTTP status, vagueness and Arabizi."""
    asked = F.trim(F.coalesce("question", F.lit("")))
    rows = questions.withColumn("question", asked)
    arabizi = T.is_arabizi(F.col("question"))
    language = F.coalesce(F.nullif("language", F.lit("")), F.when(arabizi, "ar").otherwise(T.language(F.col("question"))))
    return rows.withColumns({
        "status": G.status(F.col("question")), "is_vague": T.is_vague(F.col("question")), "is_arabizi": arabizi, "language": language, "top_k": F.coalesce(F.nullif("top_k", F.lit(0)), F.lit(top_k)),
        "mode": F.coalesce(F.nullif("mode", F.lit("")), F.lit("hybrid")), "embedding_backend": F.coalesce(F.nullif("embedding_backend", F.lit("")), F.lit(G.DEFAULT_BACKEND)),
    })


def ask(asked: DataFrame, verdicts: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, status, language, action, confidence, model and sources of requests (query_id, …) from `requests`.

    verdicts (query_id, in_domain, needs_account_data, is_ambiguous, clarifying_question) come from a classifier, ranked
    (query_id, rank, source, similarity) from a search; both may lack rows. Requests that end early get no search result.
    """
    found = ranked.groupBy("query_id").agg(F.max("similarity").alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"))
    rows = asked.join(verdicts, "query_id", "left").join(found, "query_id", "left")
    relevant = G.is_relevant(F.col("confidence"), F.col("embedding_backend"), F.col("language"), F.col("is_arabizi"))
    action = G.action(F.col("in_domain"), F.col("needs_account_data"), F.col("is_ambiguous"), F.col("clarifying_question"), relevant)
    action = F.when(F.col("status") == 400, "invalid").when(F.col("is_vague"), "too_vague").otherwise(action)
    answered = action == "answer_normally"
    return rows.select("query_id", "status", "language", action.alias("action"), F.when(~action.isin("invalid", "too_vague"), F.col("confidence")).alias("confidence"), F.when(answered, G.route(F.col("confidence"))).alias("model"), F.when(answered, F.col("sources")).alias("sources"))
