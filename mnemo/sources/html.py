"""HTML pages as normalised lines.

A page is cut at its markup by one regular expression. Elements of LINE_TAGS begin and end lines, table cells begin after
a blank, line ends of the source end lines too, and what stands in SILENT_TAGS is not read.

Defined cases: a null page has no lines and no text in cells. Unclosed elements reach to the page's end, stray end tags
count for nothing, and "<" that begins no markup is text.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: elements that end a line, table cells, and elements whose text is not read
LINE_TAGS = frozenset("p div br tr li h1 h2 h3 h4 h5 h6 table center title blockquote pre ul ol dl dt dd hr".split())
CELL_TAGS = frozenset("td th".split())
SILENT_TAGS = frozenset("script style head".split())

#: Raw text elements with their content, comments, declarations, and tags with their names.
_markup = re.compile(r"<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.DOTALL | re.IGNORECASE)


def lines_of(html: str | None) -> tuple[list[str], float]:
    """A page's lines, white space made single, and the share of its visible characters in table cells."""
    page = html or ""
    inside = dict.fromkeys(("head", "cell"), 0)
    out, sizes, at = [], {True: 0, False: 0}, 0

    def read(text: str) -> None:
        if text and not inside["head"]:
            text = unescape(text)
            sizes[inside["cell"] > 0] += sum(map(len, text.split()))
            out.append(text.replace("\xa0", " "))

    for m in _markup.finditer(page):
        read(page[at : m.start()])
        at, name, begins = m.end(), (m["name"] or "").lower(), not m["end"]
        for kind, tags in (("head", SILENT_TAGS), ("cell", CELL_TAGS)):
            if name in tags:
                inside[kind] = max(0, inside[kind] + (1 if begins else -1))
        if name in LINE_TAGS:
            out.append("\n")
        elif name in CELL_TAGS and begins:
            out.append(" ")
    read(page[at:])
    lines = (" ".join(line.split()) for line in "".join(out).splitlines())
    total = sum(sizes.values())
    return [line for line in lines if line], sizes[True] / total if total else 0.0


@F.pandas_udf(T.StructType([T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("table_share", T.DoubleType())]))
def page_lines(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lines_of(h) for h in html], columns=["lines", "table_share"])
