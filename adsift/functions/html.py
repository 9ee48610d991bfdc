"""Visible text of a page's body."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import banks

ship(__name__)
ship("adsift.functions.banks")

# Tags whose subtrees are not read, split into raw-text tags and tags that may nest.
RAW_TAGS = ["script", "style", "noscript", "iframe"]
NESTING_TAGS = ["nav", "header", "footer", "aside", "svg", "canvas"]
# Entities that the expression below decodes; pages with others go to the parser.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·",
    "&amp;": "&",
}
NESTING_PASSES = 4
MIN_NODE_CHARS = 3
_BREAK = "\u0001"
# What may stand in a tag: quoted values may hold its end.
INSIDE_TAG = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""


class _BodyText(HTMLParser):
    """Collects trimmed text nodes outside skipped subtrees."""

    def __init__(self, has_body: bool):
        super().__init__(convert_charrefs=True)
        self.skipped = set(RAW_TAGS + NESTING_TAGS) | (set() if has_body else {"head", "title"})
        self.open: list[str] = []
        self.inside = not has_body
        self.nodes: list[str] = []
        self.parts: list[str] = []

    def flush(self):
        node = "".join(self.parts).strip()
        self.parts = []
        if len(node) > MIN_NODE_CHARS:
            self.nodes.append(node)

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag == "body":
            self.inside = True
        elif tag in self.skipped:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_endtag(self, tag):
        self.flush()
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_comment(self, data):
        self.flush()

    def handle_data(self, data):
        if self.inside and not self.open:
            self.parts.append(data)


@F.pandas_udf(T.StringType())
def _parse(pages: pd.Series) -> pd.Series:
    def one(page):
        if page is None:
            return None
        parser = _BodyText("<body" in page.lower())
        parser.feed(page)
        parser.close()
        parser.flush()
        return " ".join(" ".join(parser.nodes).split())[: banks.PAGE_TEXT_CHARS]

    return pages.map(one)


def page_text(df, html: str = "html", out: str = "text"):
    """Add the visible body text: text nodes longer than three characters, joined, collapsed, cut to 3000 characters.

    Regular expressions read almost every page inside the JVM. Pages they cannot read (skipped tags nested too deep or
    left open, rare or unended entities, odd quotes, no body tag) are the only ones handed to the Arrow-batched parser; the others reach it
    as nulls.
    """
    nesting = "|".join(NESTING_TAGS)
    # Comments and raw-text tags go in document order, before anything inside them is taken for a tag.
    body = F.regexp_replace(F.col(html), rf"(?is)<!--.*?-->|<({'|'.join(RAW_TAGS)})\b.*?</\1\s*>", _BREAK)
    no_body = ~body.rlike(r"(?i)<body\b")
    body = F.regexp_replace(body, rf"(?is)^.*?<body\b{INSIDE_TAG}>", "")
    inner = rf"(?i)<({nesting})\b(?:[^<]++|<(?!/?(?:{nesting})\b))*+</\1\s*>"
    df = df.withColumn("_body", body).withColumn("_no_body", no_body)
    for _ in range(NESTING_PASSES):
        df = df.withColumn("_body", F.regexp_replace("_body", inner, _BREAK))
    known = "|".join(e[1:-1] for e in ENTITIES)
    bare = F.regexp_replace("_body", rf"<[a-zA-Z/!?]{INSIDE_TAG}>", _BREAK)
    hard = (
        F.col("_body").rlike(rf"(?i)<(?:{nesting}|{'|'.join(RAW_TAGS)})\b")
        | F.col("_body").rlike(rf"&(?!(?:{known});)[#a-zA-Z]")
        | F.col("_no_body")
        | bare.rlike(r"<[a-zA-Z/!?]")
    )
    nodes = F.split(bare, _BREAK)

    def clean(node: Column) -> Column:
        for entity, char in ENTITIES.items():
            node = F.replace(node, F.lit(entity), F.lit(char))
        return F.regexp_replace(node, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")

    kept = F.filter(F.transform(nodes, clean), lambda n: F.length(n) > MIN_NODE_CHARS)
    quick = F.substring(F.regexp_replace(F.array_join(kept, " "), r"[\s\p{Z}]+", " "), 1, banks.PAGE_TEXT_CHARS)
    df = df.withColumn("_hard", F.coalesce(hard, F.lit(False)))
    df = df.withColumn("_parsed", _parse(F.when(F.col("_hard"), F.col(html))))
    return df.withColumn(out, F.when(F.col("_hard"), F.col("_parsed")).otherwise(quick)).drop(
        "_body", "_no_body", "_hard", "_parsed"
    )
