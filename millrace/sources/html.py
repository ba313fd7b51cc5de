"""Text of HTML pages: a tag-soup reader that drops technical and user-interface parts, as an Arrow UDF."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is removed.
REMOVED_TAGS = frozenset(("script", "style", "noscript", "iframe", "svg", "header", "footer", "nav", "form", "button", "input", "select", "textarea"))
REMOVED_CLASSES = frozenset((
    "ultimenu", "menu-level-0", "menu-level-1", "breadcrumbs", "breadcrumb", "views-exposed-form", "view-filters", "help-useful-faqs", "help-useful-links", "help-wrapper-content", "thank-you-message", "taxonomy-term--type-faqs-main-categories",
    "footer-social-wrapper", "payment-newsletter-wrapper", "footer-copyright-wrapper",
))
ENTITY_CLASS, BODY_CLASS = "eck-entity", "field--name-field-body"
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class _Node:
    __slots__ = ("tag", "kept", "bound", "entity", "parts", "has_body", "parent")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.kept = self.bound = self.entity = self.has_body = False


class _Reader(HTMLParser):
    """Text nodes inside the boundary, without removed elements and containers that lack a body."""

    def __init__(self, boundary: str):
        super().__init__(convert_charrefs=True)
        self.boundary, self.root, self.found = boundary, _Node("", None), False
        self.root.kept, self.open = True, [self.root]
        self.places: dict[str, list[int]] = {}  # where in `open` the elements of each tag name stand, so that an end tag finds its start at any depth

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        classes = set((dict(attrs).get("class") or "").split())
        above, node = self.open[-1], _Node(tag, self.open[-1])
        removed = tag in REMOVED_TAGS or bool(classes & REMOVED_CLASSES) or (tag == "a" and "nav-link" in classes)
        node.kept, node.bound = above.kept and not removed, above.bound
        if tag == self.boundary and not self.found:
            node.bound = self.found = True
            node.kept = True
        node.entity = ENTITY_CLASS in classes
        if BODY_CLASS in classes:
            for x in reversed(self.open):
                if x.has_body:
                    break  # and so has all above it
                x.has_body = True
        above.parts.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.places.get(tag):
            at = self.places[tag][-1]
            while len(self.open) > at:  # each element is closed once, whatever is left open
                self.places[self.open.pop().tag].pop()

    def handle_data(self, data: str) -> None:
        node = self.open[-1]
        if node.kept and node.bound and data.strip():
            node.parts.append(data.strip())

    def texts(self) -> Iterator[str]:
        stack: list = [self.root]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif not (x.entity and not x.has_body):
                stack.extend(reversed(x.parts))


class _RawReader(HTMLParser):
    """All text nodes outside scripts and styles."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def raw_text(html: str) -> str:
    """The text of a whole page, nothing removed but scripts and styles."""
    reader = _RawReader()
    reader.feed(html)
    reader.close()
    return "\n".join(reader.parts)


def extract(html: str | None, boundaries: tuple[str, ...]) -> tuple[str | None, str | None]:
    """(text, reject_reason): lines of text without repeats, inside the first boundary tag that the page has."""
    if not html or not html.strip():
        return None, "empty"
    for boundary in boundaries:
        reader = _Reader(boundary)
        reader.feed(html)
        reader.close()
        if reader.found:
            lines = list(dict.fromkeys(line for t in reader.texts() for part in t.splitlines() if (line := part.strip())))
            return ("\n".join(lines), None) if lines else (None, "no text")
    return None, "no boundary"


def extract_html(pages: DataFrame, html: str = "html", boundaries: tuple[str, ...] = ("main", "article", "body")) -> DataFrame:
    """pages with text, status (ok or rejected) and reject_reason; a page that can't be read is a row, never a failure."""

    @F.pandas_udf("text string, reject_reason string")
    def read(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(x, boundaries) for x in column], columns=["text", "reject_reason"])

    rows = pages.withColumn("_read", read(F.col(html)))
    return rows.select(*[F.col(c) for c in pages.columns], F.coalesce("_read.text", F.lit("")).alias("text"), F.when(F.col("_read.text").isNull(), "rejected").otherwise("ok").alias("status"), F.col("_read.reject_reason").alias("reject_reason"))
