"""Web pages to readable documents."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

from chronoweave.functions import text as T

# Tags around which lines break, and tags whose content goes.
BLOCK_TAGS = frozenset("article caption dd div dt h1 h2 h3 h4 h5 h6 li p td th title tr".split())
SKIP_TAGS = frozenset("aside canvas footer form header iframe nav noscript script style svg".split())


class _Reader(HTMLParser):
    """Collects a page's text: a line break on either side of block tags, a space after each piece, nothing under skipped tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: list[str] = []
        self.open: list[str] = []
        self.hidden = 0

    def _edge(self, tag: str) -> None:
        if not self.hidden and tag in BLOCK_TAGS:
            self.out.append("\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in SKIP_TAGS
        self.open.append(tag)
        self._edge(tag)

    def handle_endtag(self, tag: str) -> None:
        self._edge(tag)
        self.hidden -= tag in SKIP_TAGS and self.hidden > 0
        del self.open[-1:]

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if piece and not self.hidden:
            if self.open[-1:] == ["title"]:
                self.title.append(piece)
            self.out += piece, " "


def read_page(html: str) -> tuple[str, str]:
    """(title, text) of a page, before white space is squeezed."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return " ".join(reader.title), "".join(reader.out)


@F.pandas_udf(StructType().add("title", StringType()).add("text", StringType()))
def _pages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([read_page(x) for x in b], columns=["title", "text"])


def closed_references(html: Column) -> Column:
    """html in which an & that begins no reference with a semicolon is text: a reference cut off, as &amp at the end of a title, stays as it is."""
    return F.regexp_replace(html, "&(?!#?[A-Za-z0-9]+;)", "&amp;")


def clean(pages: DataFrame, html: str = "html", fallback: str = "page_id", open_references: bool = True) -> DataFrame:
    """pages with title, text, content_hash and char_count instead of html.

    open_references: whether references without a semicolon are read, as browsers do.

    HTML needs a real tokenizer (scripts hold tags in strings), so parsing runs
    in Arrow batches; all else is Column operations.
    """
    page = _pages(F.col(html) if open_references else closed_references(F.col(html)))
    df = pages.withColumn("_p", page).drop(html)
    title = F.btrim(F.split_part(T.squeeze(F.col("_p.title")), F.lit(" | "), F.lit(1)), F.lit(T.SPACE))
    body = F.concat(F.btrim(F.concat(title, F.lit("\n\n"), T.squeeze(F.col("_p.text"))), F.lit(T.SPACE)), F.lit("\n"))
    df = df.withColumns({"title": F.coalesce(F.nullif(title, F.lit("")), F.col(fallback).cast("string")), "text": body}).drop("_p")
    return df.withColumns({"content_hash": F.sha2("text", 256), "char_count": F.length("text")})


CLEANERS = ("wikipedia", "generic_html")


def checked_cleaner(cleaner: Column) -> Column:
    """The cleaner's name; an error for one that is not known."""
    return F.when(cleaner.isin(*CLEANERS), cleaner).otherwise(F.raise_error(F.concat(F.lit("unknown cleaner: "), F.coalesce(cleaner, F.lit("null")))).cast("string"))


def ingest(manifest: DataFrame, known: DataFrame, cleaned: DataFrame, refresh: bool = False, limit: int | None = None) -> DataFrame:
    """Documents of a manifest's sources: known ones keep their text and take the manifest's metadata; the others are read anew.
    limit: only the manifest's first sources, by pos where it has one.

    manifest(source_id, ...), known and cleaned(source_id, title, text, content_hash, char_count).
    """
    body = ["title", "text", "content_hash", "char_count"]
    if limit is not None:
        manifest = manifest.orderBy("pos" if "pos" in manifest.columns else "source_id").limit(limit)
    if "cleaner" in manifest.columns:
        manifest = manifest.withColumn("cleaner", checked_cleaner(F.col("cleaner")))
    old = known.select("source_id", *body)
    kept = manifest.join(old, "source_id") if not refresh else manifest.join(old, "source_id").where("false")
    fresh = manifest.join(kept.select("source_id"), "source_id", "left_anti").join(cleaned.select("source_id", *body), "source_id")
    out = kept.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))
    return out.withColumn("document_id", F.concat(F.lit("doc_"), "source_id"))
