"""Chunks of documents: fixed windows, packed sentences, and structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Words that decide what is a question or a heading.
ARABIC_QUESTION = "^(كيف|هل|مين|من|ما|ماذا|متى|أين|اين|وين|كم|شو|لماذا|ليش|ليه|بقدر|هل يمكن|يمكنني|هل يستطيع|هل تستطيع|ما هي|ما هو|ماذا يحدث|ماذا افعل|ماذا أفعل|من يستطيع|من يمكنه|اين استطيع|أين أستطيع|في اي|في أي)"
IMPERATIVES = ("اضغط", "ادخل", "اختر", "قم", "انشئ", "حمل", "سجل", "افتح", "ثم", "press", "click", "select", "enter", "open", "download", "create", "tap", "then", "choose", "go", "visit", "fill", "add", "confirm")
YES_NO = ("نعم", "لا", "Yes", "No", "yes", "no")
CONNECTORS = ("to", "for", "this", "that", "these", "those", "and", "or", "with", "the")
ARABIC_CONNECTORS = "^[لوفبك]"
SIZE, OVERLAP = 1000, 200


def fixed(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of `size` characters that share `overlap`; the last one reaches the end. Empty text has none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    n, step = F.length(text), size - overlap
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.substring(text, k * step + 1, F.lit(size)))


def sentences(text: Column, size: int = SIZE) -> Column:
    """Sentences packed in order while a chunk stays within `size` characters; a longer sentence is a chunk of its own."""
    parts = F.filter(F.split(text, rf"(?<=[.!?؟]){T.SPACE}+"), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        both = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        fits = (F.length(both) <= size) | (acc["open"] == "")
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(fits, both).otherwise(s).alias("open"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def is_question(line: Column, language: Column) -> Column:
    arabic = line.rlike("[?؟]$") & line.rlike(ARABIC_QUESTION)
    return F.when(language == "ar", arabic).otherwise(line.rlike(r"\?$"))


def is_heading(line: Column, before: Column, after: Column, language: Column) -> Column:
    """A short title line between a closed sentence and a real one."""
    words = F.split(F.lower(line), " +")
    n, first = F.length(line), F.split(F.lower(line), " +")[0]
    bare = F.transform(F.slice(words, 1, 3), lambda w: F.btrim(w, F.lit("().,")))
    arabic = line.rlike(f"[{T.ARABIC}]")
    linked = F.when(arabic, first.rlike(ARABIC_CONNECTORS) & (F.length(first) <= 8)).otherwise(first.isin(*CONNECTORS))
    closed = before.isNull() | (before.rlike("[.?؟]$") & ~is_question(before, language))
    real = (F.length(after) >= n * 1.8) & after.rlike("[.?؟)]$")
    ok = n.between(3, 50) & ~line.rlike("[.?؟:,،]$") & closed & ~F.arrays_overlap(bare, F.array(*map(F.lit, IMPERATIVES))) & ~line.isin(*YES_NO) & ~line.rlike("[,،]") & ~linked & real & (F.size(words) < 5)
    return F.coalesce(ok, F.lit(False))


def structure(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, text) of docs (doc_id, text, language): a new chunk begins at each question or heading. A document's lines stay in its row."""
    stripped = F.filter(F.transform(T.lines(F.col("text")), T.strip), lambda x: x != "")
    rows = docs.select("doc_id", "language", stripped.alias("lines")).where(F.size("lines") > 0)
    language = F.col("language")
    splits = lambda x, k: is_question(x, language) | is_heading(x, F.get("lines", k - 1), F.get("lines", k + 1), language)
    # The first line opens chunk 0 whether it splits or not.
    flags = F.transform("lines", lambda x, k: (k == 0) | splits(x, k))
    rows = rows.withColumn("starts", F.filter(F.transform(flags, lambda f, k: F.when(f, k)), lambda k: k.isNotNull()))
    text = lambda first, j: F.array_join(F.slice("lines", first + 1, F.coalesce(F.get("starts", j + 1), F.size("lines")) - first), "\n")
    return rows.select("doc_id", F.posexplode(F.transform("starts", text)).alias("chunk_index", "text"))


def chunks(docs: DataFrame, strategy: str, **options: int) -> DataFrame:
    """(doc_id, chunk_index, text) by strategy: fixed, sentence or structure. Blank chunks are dropped after they are numbered."""
    if strategy == "structure":
        return structure(docs)
    make = {"fixed": fixed, "sentence": sentences}.get(strategy)
    if not make:
        raise ValueError(f"unknown strategy: {strategy}")
    rows = docs.select("doc_id", F.posexplode(make(F.coalesce("text", F.lit("")), **options)).alias("chunk_index", "text"))
    return rows.where(T.strip(F.col("text")) != "")


def chunk_id(doc_id: Column, index: Column, variant: str = "") -> Column:
    """The document's id and the index in three digits at least."""
    return F.format_string("%s_" + variant + "%03d", doc_id, index)
