"""Web pages as section units."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.segment import sections

_SKIPPED = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "template", "svg"}
_BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "br", "blockquote", "pre"}


class _Reader(HTMLParser):
    """Main content as Markdown; inside an article or main element only, where there is one."""

    def __init__(self, only: str | None):
        super().__init__(convert_charrefs=True)
        self.only, self.inside, self.skip, self.out = only, 0, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        if tag == self.only:
            self.inside += 1
        if re.fullmatch("h[1-6]", tag):
            self._add("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self._add("\n- ")
        elif tag in _BLOCKS:
            self._add("\n\n")

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        if re.fullmatch("h[1-6]", tag) or tag in _BLOCKS:
            self._add("\n\n")
        if tag == self.only:
            self.inside -= 1

    def handle_data(self, data):
        self._add(re.sub(r"\s+", " ", data))

    def _add(self, text: str):
        if not self.skip and (self.only is None or self.inside):
            self.out.append(text)


def markdown(html: str | None) -> str:
    """The main content of a page as Markdown; empty where scripts make the page."""
    page = html or ""
    only = next((t for t in ("article", "main") if re.search(rf"<{t}[\s>]", page, re.I)), None)
    r = _Reader(only)
    r.feed(page)
    r.close()
    lines = [line.strip() for line in "".join(r.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def units(pages: DataFrame) -> DataFrame:
    """``source, uid, locator, heading_path, text``; pages without content give no unit."""

    @F.pandas_udf("array<struct<heading_path: array<string>, text: string, first: int, last: int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: sections(markdown(h)))

    u = pages.select("source", F.posexplode(run("html")).alias("k", "s"))
    name = F.coalesce(F.try_element_at("s.heading_path", F.lit(-1)), F.lit(""))
    return u.select("source", F.concat(F.lit("U"), (F.col("k") + 1).cast("string")).alias("uid"), F.concat(F.col("source").cast("string"), F.lit("#heading="), name).alias("locator"), "s.heading_path", "s.text")


def summary(pages: DataFrame) -> DataFrame:
    """Title, host, short hash of the address and element counts, in SQL functions only."""
    return pages.select(
        "page_id", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)).alias("host"), F.substring(F.sha1("url"), 1, 8).alias("url_hash"),
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        F.regexp_count("html", F.lit("(?i)<h[1-6][ >]")).alias("n_headings"), F.regexp_count("html", F.lit("(?i)<p[ >]")).alias("n_paragraphs"),
    )
