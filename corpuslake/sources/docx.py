"""DOCX text with the standard library: paragraphs, then all tables as pipe rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RULE = "---"


def _text(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def clean_paragraph(text: str) -> str:
    """Lines with runs of spaces made one, stripped, empty ones dropped."""
    lines = (re.sub(r"[ \t]+", " ", line).strip() for line in text.split("\n"))
    return "\n".join(x for x in lines if x)


def table_rows(rows: list[list[str]]) -> list[str]:
    """Rows of cells joined by pipes, empty rows dropped, with a rule after the first of several."""
    filled = [" | ".join(cells) for cells in ([re.sub(r"\s+", " ", c).strip() for c in r] for r in rows) if any(cells)]
    return [filled[0], RULE, *filled[1:]] if len(filled) > 1 else filled


def _blocks(body: ElementTree.Element) -> Iterator[str]:
    for p in body.findall(f"{W}p"):
        if text := clean_paragraph(_text(p)):
            yield text
    for t in body.findall(f"{W}tbl"):
        yield from table_rows([["\n".join(_text(p) for p in c.findall(f"{W}p")) for c in r.findall(f"{W}tc")] for r in t.findall(f"{W}tr")])


def parse(data: bytes | None) -> str:
    """The text of a file; '' if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    return "\n".join(_blocks(body)) if body is not None else ""


def text_of(content: Column) -> Column:
    def run(column):
        import pandas as pd

        return pd.Series([parse(None if d is None else bytes(d)) for d in column], dtype=object)

    return F.pandas_udf(run, "string")(content)
