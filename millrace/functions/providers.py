"""Columns that come from models elsewhere, and offline defaults for them.

A provider is a function from a DataFrame to the same rows with one column more. None here calls a network; a provider
that does belongs in a job of its own that writes a table.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import text as T

Provider = Callable[[DataFrame], DataFrame]

# Tokens for each 100 characters, and the name space of ids by URL.
TOKENS_PER_100 = {"en": 21.02, "ar": 38.67}
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"
DIGITS = "0123456789abcdef"


def normalized(vector: Column) -> Column:
    """A vector of length 1; one without length stays as it is."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(vector, lambda x: x / size)).otherwise(vector)


def hashed_counts(text: Column) -> Column:
    """Counts of tokens by the first hex digit of their MD5: of the string of these digits, what is missing without each."""
    digits = F.array_join(F.transform(T.tokens(text), lambda t: F.left(F.md5(t), F.lit(1))), "")
    return F.transform(F.array(digits), lambda s: F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(d), F.lit("")))).cast("double") for d in DIGITS]))[0]


def embed(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `embedding`, a stand-in for one of a model: hashed counts as a vector of length 1."""
    return df.withColumn("embedding", hashed_counts(F.col(text))).withColumn("embedding", normalized(F.col("embedding")))


def embedded(df: DataFrame, call: Callable[[list[str]], list[tuple[int, list[float]]]], dimension: int, text: str = "text", batch: int = 32) -> DataFrame:
    """df with `embedding` from call, which takes up to `batch` texts and gives (index, vector) of each, in any order. An answer that lacks a text, or has vectors of another length, is an error. A null text is an empty one."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            for lo in range(0, len(frame), batch):
                texts = [t or "" for t in frame[text].iloc[lo : lo + batch]]
                answer = sorted(call(texts), key=lambda a: a[0])
                if [k for k, _ in answer] != list(range(len(texts))) or any(len(v) != dimension for _, v in answer):
                    raise ValueError(f"the provider must give one vector of {dimension} numbers for each of {len(texts)} texts")
                vectors += [v for _, v in answer]
            yield frame.assign(embedding=vectors)

    return df.mapInPandas(add, StructType([*df.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


def retried(call: Callable[[], object], attempts: int = 5, wait: Callable[[float], None] = time.sleep) -> object:
    """What call gives, tried again after an error as long as its message asks for, else two seconds more each time; the last error is raised."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception as e:
            if attempt + 1 == attempts:
                raise
            found = re.search(r"try again in (?:([0-9]+)m)?([0-9.]+)(ms|s)", str(e))
            wait(int(found[1] or 0) * 60 + float(found[2]) / (1000 if found[3] == "ms" else 1) + 0.5 if found else 2.0 * (attempt + 1))


def transliterated(df: DataFrame) -> DataFrame:
    """Arabic and English rewrites of a question in Latin letters where there is no translator: itself."""
    return df.withColumns({"arabic": F.col("question"), "english": F.col("question")})


def unjudged(df: DataFrame, checks: tuple[str, ...] = ("faithfulness", "relevance", "completeness", "language_quality")) -> DataFrame:
    """Scores of an answer where there is no judge: null, which means pass over."""
    return df.withColumns({c: F.lit(None).cast("double") for c in checks})


def estimated_tokens(text: Column, language: Column) -> Column:
    """Tokens by the measured ratio for the language; English for others."""
    ratio = F.when(language == "ar", TOKENS_PER_100["ar"]).otherwise(TOKENS_PER_100["en"])
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) * ratio / 100).cast("int")


def default_verdict(df: DataFrame) -> DataFrame:
    """What a classifier's missing or unreadable verdict counts as."""
    return df.withColumns({"in_domain": F.lit(True), "needs_account_data": F.lit(False), "is_ambiguous": F.lit(False), "clarifying_question": F.lit("")})


def unchanged_query(df: DataFrame) -> DataFrame:
    """The rewrite of a query where there is none: itself."""
    return df.withColumn("rewritten", F.coalesce(F.nullif(F.trim("question"), F.lit("")), F.col("question")))


def display_score(df: DataFrame) -> Column:
    """Rerank score, else fused score, else score, of those that df has."""
    return F.coalesce(*[F.col(c) for c in ("rerank_score", "rrf_score", "score") if c in df.columns])


def uuid5(name: Column) -> Column:
    """The version 5 UUID of a name in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("string"), 10, 16))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def is_saved_page_boilerplate(line: Column, lines: tuple[str, ...], navigation: tuple[str, ...], parts: tuple[str, ...]) -> Column:
    """Lines of a saved page's frame: those of two sets of exact lines, in their case, and those that hold a part in lower case. The lists are the site's, so the caller's."""
    low, found = F.lower(line), line.isin(*lines, *navigation) if lines or navigation else F.lit(False)
    for p in parts:
        found = found | low.contains(p)
    return found
