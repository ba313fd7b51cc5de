"""Decisions about questions and answers as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of similarity, by kind of embedding and language.
THRESHOLDS = {("local", "en"): 0.30, ("local", "ar"): 0.30, ("hosted", "en"): 0.60, ("hosted", "ar"): 0.55}
DEFAULT_BACKEND, ARABIZI_THRESHOLD, EASY, MAX_QUESTION = "hosted", 0.05, 0.65, 1000
REFUSALS = {
    ("no_info", "en"): "This is not in the documentation. Please check with a supervisor.", ("no_info", "ar"): "هذه المعلومة غير موجودة في التوثيق. يرجى مراجعة المشرف.",
    ("out_of_domain", "en"): "This question is outside the scope of the documentation.", ("out_of_domain", "ar"): "هذا السؤال خارج نطاق التوثيق.",
    ("needs_account_data", "en"): "This needs the customer's account. Please look it up in the system.", ("needs_account_data", "ar"): "هذا يتطلب حساب الزبون. يرجى مراجعة النظام.",
}


VAGUE = {"en": "Could you say a little more about what you need?", "ar": "هل يمكنك توضيح ما تحتاجه أكثر؟"}


def vague_text(language: Column) -> Column:
    """What asks for more of a question that says nothing."""
    return F.when(language == "ar", VAGUE["ar"]).otherwise(VAGUE["en"])


def _lookup(values: dict[tuple[str, str], object], a: Column, b: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*[(f"{k[0]}|{k[1]}", v) for k, v in values.items()])])
    return F.try_element_at(table, F.concat_ws("|", a, b))


def threshold(backend: Column, language: Column, arabizi: Column) -> Column:
    """Unknown backends count as the default one, unknown languages as English."""
    backend = F.when(backend.isin("local", "hosted"), backend).otherwise(DEFAULT_BACKEND)
    language = F.when(language.isin("en", "ar"), language).otherwise("en")
    return F.when(F.coalesce(arabizi, F.lit(False)), ARABIZI_THRESHOLD).otherwise(_lookup(THRESHOLDS, backend, language))


def is_relevant(score: Column, backend: Column, language: Column, arabizi: Column) -> Column:
    """Whether a score reaches its threshold; no score doesn't."""
    return F.coalesce(score >= threshold(backend, language, arabizi), F.lit(False))


def action(in_domain: Column, needs_account: Column, ambiguous: Column, clarification: Column, relevant: Column) -> Column:
    """The first that applies; verdicts that are missing count as in domain, no account, not ambiguous."""
    return (
        F.when(~F.coalesce(in_domain, F.lit(True)), "out_of_domain").when(F.coalesce(needs_account, F.lit(False)), "needs_account_data")
        .when(F.coalesce(ambiguous, F.lit(False)) & (F.coalesce(clarification, F.lit("")) != ""), "ambiguous").when(~relevant, "no_info").otherwise("answer_normally")
    )


def refusal(reason: Column, language: Column) -> Column:
    return F.coalesce(_lookup(REFUSALS, reason, language), _lookup(REFUSALS, reason, F.lit("en")))


def route(score: Column) -> Column:
    """The small model for a confident match; the main one otherwise, or without a score."""
    return F.when(score >= EASY, "small").otherwise("main")


def status(question: Column) -> Column:
    """200, or 400 for empty and too long questions."""
    n = F.length(F.trim(F.coalesce(question, F.lit(""))))
    return F.when((n == 0) | (n > MAX_QUESTION), 400).otherwise(200)


def salvage(raw: Column, schema: str) -> Column:
    """JSON from text: as it is, else from the first brace to the last."""
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(F.get_json_object(raw, "$").isNotNull(), raw).otherwise(inner), schema)


def salvaged(raw: Column, schema: str, defaults: dict[str, object]) -> Column:
    """JSON from text as `salvage` reads it, with a default for each field that is missing, or for all."""
    found = salvage(raw, schema)
    return F.struct(*[F.coalesce(found[k], F.lit(v)).alias(k) for k, v in defaults.items()])


def retry_after(message: Column, attempt: Column) -> Column:
    """Seconds to wait: those in the message and half a second, else by attempt."""
    wait = r"try again in (?:([0-9]+)m)?([0-9.]+)(ms|s)"
    part = lambda k: F.regexp_extract(message, wait, k)
    minutes = F.coalesce(F.nullif(part(1), F.lit("")).cast("double"), F.lit(0.0))
    seconds = F.nullif(part(2), F.lit("")).cast("double") / F.when(part(3) == "ms", 1000).otherwise(1)
    return F.coalesce(minutes * 60 + seconds + 0.5, 2.0 * (attempt + 1))
