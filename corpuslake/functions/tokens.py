"""Tokens of mixed text: runs of letters and digits, and for Chinese characters every pair with its successor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"
#: A look-ahead captures the token at each place where one begins; what is consumed decides where the next begins.
TOKEN = rf"(?=([{CJK}]{{1,2}}|[\p{{L}}\p{{N}}]+))(?:[{CJK}]|[\p{{L}}\p{{N}}]+)"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), 1)
