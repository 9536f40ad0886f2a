"""String helpers whose results equal Python's, where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip() takes off: Unicode white space and the separators 1C to 1F.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)\z", 1)


def extension(c: Column) -> Column:
    """Lower-cased suffix with its dot, '' if there is none (a leading dot begins a name, not a suffix)."""
    return F.lower(F.regexp_extract(basename(c), r"(?s)[^/](\.[^.]+)\z", 1))
