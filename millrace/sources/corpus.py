"""A folder of files as a table of documents, and tables as JSON lines."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .html import extract, raw_text

CHUNK = "chunk_id string, doc_id string, chunk_index int, text string, language string, topic string, source_file string, source_format string, strategy string, char_count int, token_count int"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def doc_id(path: Column, content: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of path and bytes."""
    return F.substring(F.sha2(F.concat(F.encode(path, "UTF-8"), content), 256), 1, 16)


def point_id(chunk_id: Column) -> Column:
    """A 48-bit number from the SHA-256 of an id."""
    return F.conv(F.substring(F.sha2(chunk_id, 256), 1, 12), 16, 10).cast("bigint")


def path_language(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.when(F.array_contains(parts, "ar"), "ar").when(F.array_contains(parts, "en"), "en").otherwise("unknown")


def path_format(path: Column) -> Column:
    """The suffix in lower case, without its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def path_topic(path: Column) -> Column:
    """The file's name without its suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def is_read(path: Column) -> Column:
    """Whether a file is one to read: neither hidden nor named empty or scanned."""
    name = F.element_at(F.split(path, "/"), -1)
    return ~(name.startswith(".") | F.lower(name).contains("empty") | F.lower(name).contains("scanned"))


@dataclass(frozen=True)
class SavedPage:
    """What marks lines of the frame in documents saved from a site: two sets of exact lines, and parts in lower case. They are the site's, so empty unless a caller gives them."""

    lines: tuple[str, ...] = ()
    navigation: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()

    def has(self, line: str) -> bool:
        return line in self.lines or line in self.navigation or any(p in line.lower() for p in self.parts)


def docx_lines(content: bytes) -> list[str]:
    """Non-empty paragraphs outside tables, then table rows with cells joined by a bar."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    said = lambda x: "".join(t.text or "" for t in x.iter(f"{_W}t")).strip()
    lines = [said(p) for p in body.findall(f"{_W}p")]
    for row in body.iter(f"{_W}tr"):
        lines.append(" | ".join(c for c in (said(x) for x in row.findall(f"{_W}tc")) if c))
    return [x for x in lines if x]


def docx_text(content: bytes, page: SavedPage = SavedPage()) -> str:
    """The lines of a document without its page's frame, none of them twice."""
    return "\n".join(dict.fromkeys(x for x in docx_lines(content) if not page.has(x)))


def _read_file(content: bytes, kind: str, page: SavedPage, clean: bool) -> tuple[str | None, str | None]:
    try:
        if not content:
            return None, "empty"
        if kind in ("html", "htm"):
            text = content.decode("utf-8", "replace")
            if clean:
                return extract(text, ("main",))
            text = raw_text(text)
        elif kind == "docx":
            text = docx_text(content, page) if clean else "\n".join(docx_lines(content))
        elif kind in ("txt", "md"):
            text = content.decode("utf-8", "replace")
        else:
            return None, f"unsupported format: {kind}"
        return (text, None) if text.strip() else (None, "no text")
    except Exception as e:  # one bad file is a rejected row
        return None, f"unreadable: {type(e).__name__}"


def read_corpus(spark: SparkSession, root: str, page: SavedPage = SavedPage(), clean: bool = True) -> DataFrame:
    """Documents of all files under root but hidden ones and those named empty or scanned; what can't be read is rejected with a reason.

    Lines that `page` marks go from documents of a word processor. With clean=False texts are as files hold them.
    """

    @F.pandas_udf("text string, reject_reason string")
    def read(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read_file(c, k, page, clean) for c, k in zip(content, kind)], columns=["text", "reject_reason"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^[a-z]+:/+(?=/)|^file:(?=/)", "")
    kept = files.where(is_read(F.col("path")))
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    relative = F.replace(path, F.lit(base), F.lit(""))
    kind = path_format(F.col("path"))
    rows = kept.select(relative.alias("source_file"), kind.alias("source_format"), "content").withColumn("r", read("content", "source_format"))
    text = F.coalesce("r.text", F.lit(""))
    text = F.when(F.lit(clean) & T.has_arabic(text), T.normalize_arabic(text)).otherwise(text)
    return rows.select(
        doc_id(F.col("source_file"), F.col("content")).alias("doc_id"), text.alias("text"), path_language(F.col("source_file")).alias("language"), path_topic(F.col("source_file")).alias("topic"),
        "source_file", "source_format", F.lit(None).cast("string").alias("section_heading"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ingestion_date"),
        F.when(F.col("r.reject_reason").isNull(), "ok").otherwise("rejected").alias("status"), F.col("r.reject_reason").alias("reject_reason"),
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)
