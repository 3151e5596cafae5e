"""Column functions on plain text and finished markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: every character a Unicode-aware blank test accepts.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same as a regex class, and its opposite.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_BLANK = "[^" + BLANK[1:]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an expensive value inside an expression.

    Neighbouring projections may be merged by the optimizer, which would copy
    ``value`` into every place that uses it, loops included. A one-element
    ``transform`` pins it to one evaluation per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_BLANK)


def tidy_markdown(md: Column) -> Column:
    """Seven clean-up steps; their order decides the result."""
    md = F.regexp_replace(md, r"\n\n\n+", "\n\n")
    md = F.array_join(F.transform(F.split(md, "\n"), rstrip), "\n")
    md = F.regexp_replace(md, rf"\[([^\]]*)\]\({BLANK}*\)", "$1")
    md = F.regexp_replace(md, rf"(?dm)^{BLANK}*-{BLANK}*$", "")
    md = F.regexp_replace(md, r"  +", " ")
    md = F.replace(md, F.lit("\n#"), F.lit("\n\n#"))
    return strip(md)


def prefix_title(md: Column, title: Column) -> Column:
    """Put the page title on top unless the text opens with a heading already."""
    return F.when(F.startswith(md, F.lit("#")), md).otherwise(
        F.concat(F.lit("# "), title, F.lit("\n\n"), md)
    )


def reported_title(md: Column) -> Column:
    """The first level-one heading line, or NULL."""
    line = F.regexp_extract(md, r"(?d)(?:^|\n)(# [^\n]*)", 1)
    return F.when(line != "", strip(F.substring(line, 3, 2**31 - 1)))


def page_document(url: Column, md: Column) -> Column:
    return F.concat(F.lit("<!-- Source: "), url, F.lit(" -->\n\n"), md)
