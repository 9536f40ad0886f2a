"""Markdown to plain text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions.clean import clean
from corpuslake.functions.strings import strip

# The patterns, in their order, that the results depend on.
FRONT_MATTER = r"(?Usmd)^[-+]{3,}\s*\n.*?\n[-+]{3,}\s*\n"
COMMENT = r"(?s)<!--.*?-->"
IMAGE = r"!\[([^\]]*)\]\([^)]*\)"
LINK = r"\[([^\]]+)\]\([^)]+\)"
TAG = r"<[^>]+>"
EMPHASIS = r"(?d)(\*{1,3}|_{1,3}|~~)(.+?)\1"
RULE_LINE = r"\A[-*_=]{3,}\z"
HEADING, QUOTE, BULLET = r"(?U)\A#{1,6}\s+", r"(?U)\A>\s?", r"(?U)\A[-*+]\s+"


def comments(c: Column) -> Column:
    return F.regexp_replace(c, COMMENT, "")


def tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, "")


def lines(c: Column) -> Column:
    """Lines stripped, rules dropped, and heading, quote and bullet marks taken off."""
    bare = F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: ~x.rlike(RULE_LINE))
    return F.array_join(F.transform(bare, lambda x: reduce(lambda y, p: F.regexp_replace(y, p, ""), (HEADING, QUOTE, BULLET), x)), "\n")


def strip_markdown(c: Column) -> Column:
    c = comments(F.regexp_replace(c, FRONT_MATTER, ""))
    c = F.regexp_replace(F.regexp_replace(c, IMAGE, "$1"), LINK, "$1")
    return clean(lines(F.regexp_replace(tags(c), EMPHASIS, "$2")), ocr=False)
