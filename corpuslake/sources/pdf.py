"""PDF pages through a pluggable parser; everything after the parser is DataFrame operators.

No PDF library is part of the engine. A Parser gives a file's text lines with their place on the page; an
optional Ocr gives the text of a page that has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions.clean import clean
from corpuslake.operators import pages as ops
from corpuslake.operators.common import materialize


@dataclass(frozen=True)
class Line:
    page: int
    y: float
    height: float
    text: str


Parser = Callable[[bytes], Iterator[Line]]
Ocr = Callable[[bytes, int], str]


def no_ocr(content: bytes, page: int) -> str:
    return ""


def lines_of(files: DataFrame, parser: Parser, ocr: Ocr = no_ocr) -> DataFrame:
    """(doc, page, line, y, height, text, error) of every line; a page without text gives what ocr gives.

    A file that the parser or ocr fails on gives one row with the message in error and nulls for page, line and text.
    """

    def parsed(data: bytes) -> list[Line]:
        found = list(parser(data))
        filled = {x.page for x in found if x.text.strip()}
        return found + [Line(page, 0.0, 0.0, ocr(data, page)) for page in sorted({x.page for x in found} - filled)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows += [(path, x.page, i, float(x.y), float(x.height), x.text, None) for i, x in enumerate(parsed(bytes(content)))]
                except Exception as e:  # noqa: BLE001  one broken file doesn't stop the job
                    rows.append((path, None, None, None, None, None, str(e) or type(e).__name__))
            out = pd.DataFrame(rows, columns=["doc", "page", "line", "y", "height", "text", "error"], dtype=object)
            yield out.astype({"page": "Int32", "line": "Int32", "y": "Float64", "height": "Float64"})

    return files.select("path", "content").mapInPandas(run, "doc string, page int, line int, y double, height double, text string, error string")


def page_texts(lines: DataFrame) -> DataFrame:
    """(doc, page, text) without headers and footers, with split tables merged, numbered from 1."""
    whole = lines.filter("error IS NULL").drop("error")
    kept = ops.remove_headers_footers(whole, ops.headers_footers(whole))
    return ops.merge_tables(ops.page_text(kept))


def with_text(files: DataFrame, parser: Parser, ocr: Ocr = no_ocr) -> DataFrame:
    """files with the whole cleaned text and, where parsing failed, its message in load_error; files are parsed once."""
    lines = materialize(lines_of(files, parser, ocr), "lines")
    whole = ops.whole_text(page_texts(lines)).select(F.col("doc").alias("path"), clean(F.col("text")).alias("text"))
    failed = lines.filter("error IS NOT NULL").select(F.col("doc").alias("path"), F.col("error").alias("load_error"))
    return files.join(whole, "path", "left").join(failed, "path", "left")
