"""From fetched bytes to pages of text."""

from __future__ import annotations

import html
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decoded(content: Column) -> Column:
    """UTF-8 text with replacement characters, without a byte order mark."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")


def format_of(head: Column, mime: Column) -> Column:
    """pdf, html, xml or text from the first characters and the content type; invalid_content for a PDF type without its signature."""
    low, kind = F.lower(F.substring(head, 1, 1000)), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(F.ltrim(head).startswith("%PDF-"), "pdf")
        .when(kind.contains("pdf"), "invalid_content")
        .when(kind.contains("html") | low.contains("<!doctype html") | low.contains("<html"), "html")
        .when(kind.contains("xml") | F.ltrim(low).startswith("<?xml"), "xml")
        .otherwise("text")
    )


ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^"'>])*+>"""
UNSEEN = rf"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript)\b{ATTRIBUTES}.*?(?:</\1\s*>|\z)"


@F.pandas_udf(T.StringType())
def unescaped(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts with all named and numbered character references of HTML decoded."""
    for series in texts:
        yield series.map(html.unescape, na_action="ignore")


def html_text(page: Column) -> Column:
    """Text of a page: no scripts, styles and comments, a line break before each block, all entities decoded.

    A script, style or comment that is not closed reaches to the end; ``>`` in a quoted attribute
    does not end a tag. Null stays null.
    """
    out = F.regexp_replace(page, UNSEEN, "")
    out = F.regexp_replace(out, rf"(?i)<(?:p|div|br|li|tr|h1|h2|h3)(?=[\s/>]){ATTRIBUTES}", "\n")
    out = F.regexp_replace(out, rf"(?s)<[!/?A-Za-z]{ATTRIBUTES}", "")
    return unescaped(out)


@F.pandas_udf(T.StringType())
def xml_text(documents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of front, body and back, one after the other, or of the whole tree, its parts joined by blanks; null if it cannot be parsed."""

    def one(raw):
        if raw is None or "<!ENTITY" in raw:
            return None
        try:
            root = ElementTree.fromstring(raw)
        except ElementTree.ParseError:
            return None
        parts = [e for e in root if e.tag.rpartition("}")[2] in ("front", "body", "back")]
        words = lambda e: " ".join(e.itertext())
        return "\n\n".join(map(words, parts)) if parts else words(root)

    for series in documents:
        yield series.map(one)


PDF_PAGES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("locator", "text", "warning")]))


@F.pandas_udf(PDF_PAGES)
def pdf_pages(files: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Pages of PDF files if a PDF library is at hand, else one row that says so; encrypted files are refused."""
    try:
        import fitz
    except ImportError:
        fitz = None

    def one(content):
        if content is None:
            return []
        if fitz is None:
            return [{"locator": "document", "text": None, "warning": "dependency_missing"}]
        with fitz.open(stream=content, filetype="pdf") as pdf:
            if pdf.needs_pass:
                return [{"locator": "document", "text": None, "warning": "encrypted"}]
            pages = [(i, p.get_text(sort=True)) for i, p in enumerate(pdf, 1)]
        return [{"locator": f"page:{i}", "text": t, "warning": None if t.strip() else "no_text"} for i, t in pages]

    for series in files:
        yield series.map(one)


def pages(blobs: DataFrame, mime: str = "mime", content: str = "content", key: str = "path") -> DataFrame:
    """(key, format, locator, text, warning): the pages of fetched files; invalid content has a warning and no text."""
    text = decoded(F.col(content))
    rows = blobs.select(F.col(key), F.col(content), text.alias("raw"), format_of(text, F.col(mime)).alias("format"))
    flat = rows.where("format <> 'pdf'").select(
        key,
        "format",
        F.lit("document").alias("locator"),
        F.when(F.col("format") == "html", html_text(F.col("raw"))).when(F.col("format") == "xml", xml_text("raw")).when(F.col("format") == "text", F.col("raw")).alias("text"),
        F.when(F.col("format") == "invalid_content", "invalid_content").alias("warning"),
    )
    paged = rows.where("format = 'pdf'").select(key, "format", F.explode(pdf_pages(content)).alias("p")).select(key, "format", "p.locator", "p.text", "p.warning")
    return flat.unionByName(paged)


def is_text(content: Column) -> Column:
    """Whether bytes are plain text: valid UTF-8, no NUL, no PDF."""
    return F.coalesce(F.is_valid_utf8(content.cast("string")) & (F.instr(content.cast("string"), "\u0000") == 0) & ~F.ltrim(content.cast("string")).startswith("%PDF-"), F.lit(False))


def split_evidence(blobs: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Evidence that is text (with its ``text``), and the rest with the reason why it is not indexed."""
    ok = is_text(F.col(content))
    reason = F.when(F.ltrim(F.make_valid_utf8(F.col(content).cast("string"))).startswith("%PDF-"), "pdf").otherwise("binary")
    return blobs.where(ok).withColumn("text", decoded(F.col(content))), blobs.where(~ok).withColumn("reason", reason)


def ingest_summary(all_pages: DataFrame, key: str) -> DataFrame:
    """(key, pages, characters, empty_pages): of a document with a bounded number of pages."""
    blank = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")) == 0
    return all_pages.groupBy(key).agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"), F.sort_array(F.collect_list(F.when(blank, F.col("locator")))).alias("empty_pages"))


def registrable(documents: DataFrame, scope: str, available: str, level: str) -> DataFrame:
    """Documents whose read scope names existing places and that were not only seen as metadata or abstract."""
    from veristrata.functions.text import locators

    named = locators(F.col(scope))
    ok = (F.size(named) > 0) & (F.size(F.array_except(named, F.col(available))) == 0)
    return documents.where(F.coalesce(ok, F.lit(False)) & ~F.coalesce(F.col(level).isin("metadata", "abstract", "ai_summary"), F.lit(False)))
