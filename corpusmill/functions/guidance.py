"""Guidance pages: headed sections of an HTML page, by its content container, else by its blocks, else as plain lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from corpusmill.functions.text import section_key, title_from_url

# Tags that are left out, that head a section and that hold its text; the class of the content container.
SKIPPED = {"script", "style", "noscript", "nav", "footer", "header"}
HEADINGS, BLOCKS = {"h1", "h2", "h3"}, {"p", "li", "dt", "dd"}
CONTAINER = "about-description"
# What in a tag's class, id, role or label says that it is no content.
NO_CONTENT = re.compile("nav|breadcrumb|footer|header|search|share|social|translate|language|google|print|sidebar|side-nav|nycgov", re.IGNORECASE)
# Lines of page furniture.
FURNITURE = {
    "311", "About", "Accessibility resources", "Careers", "Contact", "Contact NYC government", "Events", "Home", "Media", "Menu", "NYC", "Print", "Privacy policy",
    "Register to vote", "Search", "Search all NYC.gov websites", "Share", "Terms of use", "Text-Size", "Website feedback", "Your government", "nyc.gov home",
    "Affordable Housing", "Building and Land Development Services", "Code Enforcement", "Compliance", "Design Guidelines", "Do Business with HPD",
    "Expediting New Affordable Housing", "Guide for NYC Homeowners", "Home Repair and Preservation Financing", "Housing Quality / Safety", "Neighborhood Planning",
    "New Construction Financing", "Property Management", "Rental and Down Payment Assistance", "Section 8 / Rental Subsidy Programs", "Services and Information",
}
FURNITURE_STARTS = ("!function(", "function googleTranslateElementInit", "window.", "© City of New York")
#: Tags without an end.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A section of fewer characters says nothing.
LEAST_CHARS = 40


def clean_line(text: str) -> str:
    """A line with single spaces; empty if it is page furniture."""
    line = " ".join(text.split())
    return "" if line in FURNITURE or line.startswith(FURNITURE_STARTS) else line


class _Page(HTMLParser):
    """Blocks of a page: (tag, text, whether inside the content container), and the lines of its visible text.

    What is skipped is left out of the page's own blocks, but the container counts whole.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, skipped and contained from here on
        self.blocks: list[tuple[str, str, bool, bool]] = []
        self.lines: list[str] = []
        self.block: tuple[str, list[str], bool, bool] | None = None

    def _state(self) -> tuple[bool, bool]:
        return self.open[-1][1:] if self.open else (False, False)

    def _end_block(self) -> None:
        if self.block:
            tag, parts, skipped, contained = self.block
            if line := clean_line(" ".join(parts)):
                self.blocks.append((tag, line, skipped, contained))
        self.block = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "br" and self.block:
                self.block[1].append(" ")
            return
        skipped, contained = self._state()
        named = [v for n, v in attrs if n in ("class", "id", "role", "aria-label") and v]
        skips = tag in SKIPPED or any(map(NO_CONTENT.search, named))
        if skips and not skipped:
            self._end_block()
        contains = any(n == "class" and CONTAINER in (v or "").split() for n, v in attrs)
        self.open.append((tag, skipped or skips, contained or contains))
        if tag in HEADINGS or tag in BLOCKS or tag == "title":
            self._end_block()
            self.block = (tag, [], *self.open[-1][1:])

    def handle_endtag(self, tag: str) -> None:
        if self.block and self.block[0] == tag:
            self._end_block()
        places = [i for i, (t, _, _) in enumerate(self.open) if t == tag]
        if places:
            del self.open[places[-1] :]

    def handle_data(self, data: str) -> None:
        if self.block and data.strip():
            self.block[1].append(data)
        if not self._state()[0] and (line := clean_line(data)):
            self.lines.append(line)

    def close(self) -> None:
        super().close()
        self._end_block()


def _sections(blocks: list[tuple[str, str]], title: str) -> Iterator[tuple[str, str]]:
    """(title, text) of the headed parts with enough text, headings included; text before any heading has ``title``."""
    parts: list[list[str]] = []
    for tag, line in blocks:
        if tag in HEADINGS:
            parts.append([line])
        else:
            parts = parts or [[title]]
            parts[-1].append(line)
    for lines in parts:
        text = "\n".join(" ".join(x.split()) for x in lines if x.strip())
        if len(text) >= LEAST_CHARS:
            yield lines[0], text


def page_sections(html: str | None, title: str) -> list[tuple[str, str]]:
    """(title, text) of a page's sections: of its container if that has any, else of all its blocks, else the plain text."""
    return parsed_page(html, title)[0]


def parsed_page(html: str | None, title: str) -> tuple[list[tuple[str, str]], bool]:
    """The sections of a page, and whether they are its plain text only."""
    page = _Page()
    page.feed(html or "")
    page.close()
    inside = list(_sections([(t, x) for t, x, _, contained in page.blocks if contained and t != "title"], title))
    if inside:
        return inside, False
    seen = [(t, x) for t, x, skipped, _ in page.blocks if not skipped]
    named = next((x for t, x in seen if t == "title"), title)
    whole = list(_sections([(t, x) for t, x in seen if t != "title"], named))
    return (whole, False) if whole else ([(title, "\n".join(page.lines))] if page.lines else [], True)


SECTION = ArrayType(StructType([StructField("ordinal", IntegerType()), StructField("title", StringType()), StructField("text", StringType()), StructField("plain", BooleanType())]))


def guidance_sections(pages: DataFrame, url: str = "url", html: str = "html", title: Column | None = None, *keys: str) -> DataFrame:
    """A row for each section of a guidance page: keys, url, ordinal, section_key, title and text. A page without text gives none.

    ``title`` stands in for a heading; without one, the URL's last part does. The plain text of a page without blocks has
    the key ``overview``.
    """

    @F.pandas_udf(SECTION)
    def parse(bodies: pd.Series, titles: pd.Series) -> pd.Series:
        found = [parsed_page(b if isinstance(b, str) else None, t) for b, t in zip(bodies, titles, strict=True)]
        return pd.Series([[{"ordinal": i, "title": t, "text": x, "plain": plain} for i, (t, x) in enumerate(f)] for f, plain in found])

    name = title_from_url(F.col(url))
    fallback = name if title is None else F.coalesce(F.nullif(title, F.lit("")), name)
    rows = pages.select(*keys, url, F.inline(parse(F.col(html), fallback)))
    return rows.select(*keys, url, "ordinal", F.when(F.col("plain"), "overview").otherwise(section_key(F.col("title"), F.col("ordinal"))).alias("section_key"), "title", "text")
