"""HTML made safe: parsed, and built again from what is allowed."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tags of a report.
REPORT_TAGS = ("p", "h2", "h3", "ul", "ol", "li", "blockquote", "em", "strong", "a")
#: Tags whose content goes with them.
_WITH_CONTENT = {"script", "style", "iframe", "noscript", "template", "object", "svg", "math", "title"}
_VOID = {"br", "hr"}


class _Rebuilder(HTMLParser):
    """Writes allowed tags, safe links and text; everything else is left out."""

    def __init__(self, allowed: frozenset[str], schemes: frozenset[str], prefix: str | None):
        super().__init__(convert_charrefs=True)
        self.allowed, self.schemes, self.prefix = allowed, schemes, prefix
        self.out: list[str] = []
        self.within: list[str] = []  # open tags whose content goes
        self.open: list[str] = []

    def safe(self, link: str) -> bool:
        # Browsers drop blanks and control characters before they look for a scheme.
        bare = "".join(c for c in link if c > " " and c != "\x7f")
        if self.prefix is not None:
            # Two slashes, either way round, begin another host's name, and two dots leave the prefix.
            steps = unquote(bare).replace("\\", "/")
            return bare.startswith(self.prefix) and not steps.startswith("//") and ".." not in urlsplit(steps).path.split("/")
        try:
            scheme = urlsplit(bare).scheme.lower()
        except ValueError:
            return False
        return scheme in self.schemes if scheme or ":" in bare.split("/")[0] else True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _WITH_CONTENT:
            self.within.append(tag)
        elif not self.within and tag in self.allowed:
            link = next((v for k, v in attrs if k == "href" and v), None) if tag == "a" else None
            shown = f' href="{html.escape(link.strip())}"' if link and self.safe(link.strip()) else ""
            self.out.append(f"<{tag}{shown}>")
            if tag not in _VOID:
                self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.within:
            if tag in self.within:
                del self.within[self.within.index(tag) :]
        elif tag in self.open:
            while (last := self.open.pop()) != tag:
                self.out.append(f"</{last}>")
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.within:
            self.out.append(html.escape(data, quote=False))

    def finish(self) -> str:
        self.close()
        self.out += [f"</{tag}>" for tag in reversed(self.open)]
        return "".join(self.out)


def clean(text: str, allowed: tuple[str, ...] = REPORT_TAGS, schemes: tuple[str, ...] = ("http", "https", "mailto"), prefix: str | None = None) -> str:
    """One text of ``sanitised``."""
    parser = _Rebuilder(frozenset(allowed), frozenset(schemes), prefix)
    parser.feed(text)
    return parser.finish()


def sanitised(text: Column, allowed: tuple[str, ...] = REPORT_TAGS, schemes: tuple[str, ...] = ("http", "https", "mailto"), prefix: str | None = None) -> Column:
    """Allowed tags, links and text of an HTML column; null stays null.

    Attributes go, but for a link's target of one of the ``schemes`` (or without
    a scheme), as it reads once entities are decoded; with ``prefix`` only targets
    of the own host that begin with it stay. Scripts and the like go with their content, tags that
    aren't closed are closed, and a text's own ``<`` and ``&`` are escaped.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: clean(t, allowed, schemes, prefix), na_action="ignore")

    return run(text)


def rewritten_links(text: Column, targets: Column) -> Column:
    """``href="CHUNK:<id>"`` to the target that the map ``targets`` has for the id; unknown ones lose it."""
    #: Fixed value: the shape of a link to a chunk, whose id has 36 characters.
    shape = r"""(?i)href=(["'])CHUNK:([0-9a-f-]{36})\1"""
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit(shape), F.lit(2)))
    link = lambda i: F.coalesce(F.concat(F.lit('href="'), F.try_element_at(targets, i), F.lit('"')), F.lit(""))
    one = lambda quote, i: F.concat(F.lit(f"href={quote}CHUNK:"), i, F.lit(quote))
    plain = F.regexp_replace(text, "(?i)href=([\"'])chunk:", "href=$1CHUNK:")
    return F.aggregate(ids, plain, lambda s, i: F.replace(F.replace(s, one('"', i), link(i)), one("'", i), link(i)))
