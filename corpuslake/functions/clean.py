"""Text cleaning: named rules from Column to Column, applied in a fixed order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions.strings import strip

Rule = Callable[[Column], Column]

# Patterns, placeholders and the correction list that the results depend on.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{2028}-\x{202f}\x{feff}]"
URL = r"(?U)(?:https?://|ftp://|www\.)[^\s\x1c-\x1f]+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
LONG_NUMBER = r"(?U)(?<![\p{L}\p{N}_])\d{15,}(?![\p{L}\p{N}_])"
URL_MARK, EMAIL_MARK, NUMBER_MARK = "[链接]", "[邮箱]", "[ID]"
OCR_WORDS = [
    ("己经", "已经"),
    ("巳经", "已经"),
    ("末来", "未来"),
    ("未末", "未来"),
    ("大阳", "太阳"),
    ("太阴", "太阳"),
    ("干万", "千万"),
    ("白勺", "白的"),
    ("因力", "因为"),
    ("下牛", "下午"),
    ("下年", "下午"),
    ("木文", "本文"),
    ("昨大", "昨天"),
    ("．", "。"),
]
OCR_PATTERNS = [(r"(?U)(\d)l([a-z])", "$1I$2"), (r"一{2,}", "——")]


def sub(pattern: str, to: str) -> Rule:
    return lambda c: F.regexp_replace(c, pattern, to)


def bound(c: Column, f: Rule) -> Column:
    """f(c) with c computed once, however often f names it: a lambda's variable holds its value."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def quotes(c: Column) -> Column:
    """The first straight quote opens, every later one closes."""

    def turned(x: Column) -> Column:
        at = F.instr(x, '"')
        rest = F.replace(F.substring(x, at + 1, F.length(x)), F.lit('"'), F.lit("”"))
        return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.lit("“"), rest)).otherwise(x)

    return bound(c, turned)


def ocr_words(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), OCR_WORDS, c)


def ocr_patterns(c: Column) -> Column:
    return reduce(lambda x, pair: F.regexp_replace(x, *pair), OCR_PATTERNS, c)


BASIC: list[tuple[str, Rule]] = [
    ("control_chars", sub(CONTROL, "")),
    ("zero_width", sub(ZERO_WIDTH, "")),
    ("wide_space", lambda c: F.replace(c, F.lit("　"), F.lit(" "))),
    ("urls", sub(URL, URL_MARK)),
    ("emails", sub(EMAIL, EMAIL_MARK)),
    ("long_numbers", sub(LONG_NUMBER, NUMBER_MARK)),
    ("spaces", sub(" {2,}", " ")),
    ("newlines", sub("\n{3,}", "\n\n")),
    ("line_ends", sub(r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)", "")),
    ("quotes", quotes),
]
OCR: list[tuple[str, Rule]] = [("ocr_words", ocr_words), ("ocr_patterns", ocr_patterns)]


class TextCleaner:
    """An ordered list of rules; users append their own."""

    def __init__(self, ocr: bool = True):
        self.rules = [*BASIC, *(OCR if ocr else [])]

    def add_rule(self, name: str, rule: Rule) -> TextCleaner:
        self.rules.append((name, rule))
        return self

    def __call__(self, c: Column) -> Column:
        """The cleaned text; '' for null and blank texts."""
        cleaned = bound(reduce(lambda x, named: named[1](x), self.rules, c), strip)
        return F.when(c.isNull() | (strip(c) == ""), F.lit("")).otherwise(cleaned)

    def deltas(self, c: Column) -> list[Column]:
        """For each rule, by how many characters it shortens the text as it finds it.

        One pass: the text is folded through the rules, each computed once, and the lengths are noted on the way.
        """
        state = F.struct(c.alias("text"), F.array(F.length(c)).alias("lengths"))

        def applied(rule: Rule) -> Rule:
            return lambda s: F.struct(rule(s["text"]).alias("text"), s["lengths"].alias("lengths"))

        def noted(s: Column) -> Column:
            return F.struct(s["text"].alias("text"), F.concat(s["lengths"], F.array(F.length(s["text"]))).alias("lengths"))

        for _, rule in self.rules:
            state = bound(bound(state, applied(rule)), noted)
        lengths = state["lengths"]
        return [(F.get(lengths, F.lit(i)) - F.get(lengths, F.lit(i + 1))).alias(name) for i, (name, _) in enumerate(self.rules)]


def clean(c: Column, ocr: bool = True) -> Column:
    return TextCleaner(ocr)(c)


def rule(name: str) -> Rule:
    return dict([*BASIC, *OCR])[name]
