"""Pages of documents: offsets, chunk positions, repeated headers and footers, tables split over pages."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpuslake.functions.strings import is_blank, strip
from corpuslake.operators.common import materialize, wide
from corpuslake.operators.occurrences import first_occurrences, mark

# The band of a page that headers or footers lie in, how often they repeat, and columns that make a table.
BAND, REPEATS, TABLE_COLUMNS = 0.15, 3, 2
GLUE = 2
#: Characters of documents that are looked into together, on average.
GROUP_CHARS = 4 << 20
#: First characters of a chunk that it is looked for by, if its whole text isn't found.
HEAD = 50
#: Characters of a document whose pages and places are put in order together.
PLACES = 1 << 20


def _spans(pages: DataFrame) -> DataFrame:
    """(doc, page, start, size, text_hash) of pages (doc, page, text); only lengths and hashes of the texts are sorted."""
    sized = pages.select("doc", "page", F.length("text").cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))
    w = Window.partitionBy("doc").orderBy("page", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("start", F.coalesce(F.sum(F.col("size") + GLUE).over(w), F.lit(0).cast("long")))


def page_offsets(pages: DataFrame) -> DataFrame:
    """(doc, page, start, end) of pages (doc, page, text) in the text that joins them with a blank line."""
    return _spans(pages).select("doc", "page", F.col("start").cast("int").alias("start"), (F.col("start") + F.col("size")).cast("int").alias("end"))


def chunk_pages(chunks: DataFrame, texts: DataFrame, offsets: DataFrame) -> DataFrame:
    """chunks (doc, chunk_index, document) with page_start and page_end.

    A chunk's place is its first occurrence in the text, else that of its first 50 characters, else 0. It starts on
    the first page whose span, with the glue behind it, holds the place, and ends on the last page that begins
    before its end; 1 where there is none.
    """
    spans = offsets.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "page", "end"))).alias("spans"))  # the pages of one document
    whole = texts.select("doc", "text").join(spans, "doc", "left")
    rows = chunks.select(*(F.col(c).alias(c) for c in ("doc", "chunk_index", "document")))  # told apart from texts of the same origin
    spark = rows.sparkSession
    size = offsets.agg(F.coalesce(F.sum(F.col("end").cast("long") - F.col("start")), F.lit(0))).first()[0]
    group = F.pmod(F.xxhash64("doc"), F.lit(max(size // GROUP_CHARS, wide(spark)))).alias("_group")  # small documents share a call

    def look(mine: pd.DataFrame, documents: pd.DataFrame) -> pd.DataFrame:
        """Each document's text is looked into by its own chunks only, once for equal ones, and its pages by bisection of their begins."""
        mine, documents = (x.assign(doc=x["doc"].astype(object).where(x["doc"].notna(), None)) for x in (mine, documents))  # null equals null
        texts = {d: (t or "", [] if held is None else [(x["start"], x["page"], x["end"]) for x in held]) for d, t, held in zip(documents["doc"], documents["text"], documents["spans"])}
        mine = mine[mine["doc"].isin(texts.keys())].drop(columns="_group")
        begins = {d: [x[0] for x in held] for d, (_, held) in texts.items()}
        found: dict[tuple, tuple[int, int]] = {}

        def pages_of(doc, chunk: str) -> tuple[int, int]:
            text, held = texts[doc]
            pos = text.find(chunk)
            pos = pos if pos >= 0 else max(text.find(chunk[:HEAD]), 0)
            reach = bisect_right(begins[doc], pos)
            on = held[reach - 1] if reach else None  # spans with their glue don't overlap
            before = bisect_left(begins[doc], pos + len(chunk))
            return on[1] if on and pos < on[2] + GLUE else 1, held[before - 1][1] if before else 1

        first, last = [], []
        for key in zip(mine["doc"], (c or "" for c in mine["document"])):
            if key not in found:
                found[key] = pages_of(*key)
            first.append(found[key][0])
            last.append(found[key][1])
        return mine.assign(page_start=first, page_end=last).astype({"page_start": "int32", "page_end": "int32"})

    schema = StructType([*rows.schema.fields, StructField("page_start", IntegerType()), StructField("page_end", IntegerType())])
    left, right = (df.select("*", group).repartition(wide(spark), "_group").groupBy("_group") for df in (rows, whole))
    return left.cogroup(right).applyInPandas(look, schema)


def chunks_on_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """What chunk_pages gives for the text that joins pages (doc, page, text), of which no task holds a whole document's.

    Chunks are found by `first_occurrences`, once for equal ones; only those that aren't found are looked for by their first
    characters. A chunk without text (null) is on page 1.
    """
    spans = materialize(_spans(pages), "spans")
    limits = spans.groupBy("doc").agg(F.coalesce(F.max(F.col("start") + F.coalesce("size", F.lit(0))), F.lit(0)).alias("size"))
    texts = _placed_texts(pages, spans)
    rows = chunks.select(*(F.col(c).alias(c) for c in ("doc", "chunk_index", "document")), mark(F.col("document")).alias("mark"))
    found = first_occurrences(texts, limits, rows.select("doc", F.col("document").alias("text"), "mark"))
    lost = found.filter((F.col("at").isNull()) & (F.col("size") > HEAD)).select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"))
    if not lost.isEmpty():
        lost = materialize(lost, "lost")
        heads = rows.join(lost, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left_semi")
        heads = heads.select("doc", F.substring("document", 1, HEAD).alias("text"), F.col("mark").alias("whole")).withColumn("mark", mark(F.col("text")))
        begun = first_occurrences(texts, limits, heads).select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), F.col("at").alias("_at"))
        of = heads.select("doc", "whole", "mark").distinct().join(begun, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")))
        of = of.select(F.col("doc").alias("_doc"), F.col("whole").alias("_mark"), "_at")
        found = found.join(of, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left").withColumn("at", F.coalesce("at", "_at")).drop("_doc", "_mark", "_at")
    empty = rows.filter("document = ''").select("doc", "mark", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("at")).distinct()
    on = _pages_at(found.withColumn("at", F.coalesce("at", F.lit(0).cast("long"))).unionByName(empty), spans, limits)
    known = limits.select(F.col("doc").alias("_known"))
    rows = rows.join(known, F.col("doc").eqNullSafe(F.col("_known")), "left_semi")
    on = on.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "page_start", "page_end")
    page = lambda c: F.coalesce(F.col(c), F.lit(1)).cast("int").alias(c)
    return rows.join(on, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left").select("doc", "chunk_index", "document", page("page_start"), page("page_end"))


def _placed_texts(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, start, text): the pages' texts at their positions, the glue with the page behind it; equal rows one after another."""
    same = ["doc", "page", "size", "text_hash"]
    texts = pages.select("doc", "page", "text").filter("text IS NOT NULL").withColumn("size", F.length("text").cast("long")).withColumn("text_hash", F.xxhash64("text"))
    starts = spans.filter("size IS NOT NULL").groupBy(*same).agg(F.min("start").alias("start"), F.count("*").alias("n"))
    if not starts.filter("n > 1").isEmpty():
        texts = texts.dropDuplicates(same)
    starts = starts.select(*(F.col(c).alias(f"_{c}") for c in same), "start", "n").hint("shuffle_hash")
    meet = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same))
    start = F.col("start") + F.col("_i") * (F.col("size") + GLUE)
    each = texts.join(starts, meet).select("doc", "start", "size", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_i")).select("doc", start.alias("start"), "text")
    glued = F.when(F.col("start") == 0, F.col("text")).otherwise(F.concat(F.lit("\n" * GLUE), F.col("text")))
    return each.select("doc", F.greatest(F.col("start") - GLUE, F.lit(0).cast("long")).alias("start"), glued.alias("text"))


def _pages_at(places: DataFrame, spans: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc, mark, page_start, page_end) of places (doc, mark, size, at); null where there is none.

    The pages that lie in or reach into a stretch of a document are in order there, and each place takes the last one before it.
    """
    end = F.col("start") + F.coalesce("size", F.lit(0))
    stretches = F.sequence(F.floor(F.col("start") / PLACES), F.floor((end + GLUE - 1) / PLACES))
    begun = spans.select("doc", F.explode(F.transform(stretches, lambda x: x.cast("long"))).alias("_part"), F.col("start").alias("x"), F.struct("page", (F.col("start") + F.col("size")).alias("end")).alias("held"))
    limit = limits.select(F.col("doc").alias("_doc"), F.col("size").alias("_limit"))
    both = F.array(F.struct(F.lit(False).alias("last"), F.col("at").alias("x")), F.struct(F.lit(True).alias("last"), (F.col("at") + F.col("size") - 1).alias("x")))
    asked = places.join(limit, F.col("doc").eqNullSafe(F.col("_doc"))).select("doc", "mark", "_limit", F.explode(both).alias("_b")).select("doc", "mark", "_b.last", F.least("_b.x", "_limit").alias("x"))
    asked = asked.withColumn("_part", F.floor(F.col("x") / PLACES).cast("long"))
    w = Window.partitionBy("doc", "_part").orderBy("x", F.col("mark").isNotNull(), "held").rowsBetween(Window.unboundedPreceding, 0)
    row = begun.unionByName(asked, allowMissingColumns=True)
    row = row.withColumn("_any", F.last("held", True).over(w)).withColumn("_filled", F.last(F.when(F.col("held.end").isNotNull(), F.col("held")), True).over(w)).filter("mark IS NOT NULL")
    first = F.when(~F.col("last") & (F.col("x") < F.col("_filled.end") + GLUE), F.col("_filled.page"))
    return row.groupBy("doc", "mark").agg(F.max(first).alias("page_start"), F.max(F.when(F.col("last"), F.col("_any.page"))).alias("page_end"))


def page_text(lines: DataFrame) -> DataFrame:
    """(doc, page, text): the lines (doc, page, y, text) that aren't blank, from top to bottom."""
    kept = lines.filter(~is_blank(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("y", "text")))  # the lines of one page
    return kept.groupBy("doc", "page").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def headers_footers(lines: DataFrame) -> DataFrame:
    """(doc, zone, text, n) of line texts that lie REPEATS times or more in the top or bottom band of a document's pages."""
    text = strip(F.col("text"))
    zone = F.when(F.col("y") < F.col("height") * BAND, "header").when(F.col("y") > F.col("height") * (1 - BAND), "footer")
    marked = lines.select("doc", "page", zone.alias("zone"), text.alias("text")).filter("zone IS NOT NULL AND text <> ''")
    enough = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= REPEATS).select("doc")
    return marked.groupBy("doc", "zone", "text").agg(F.count("*").alias("n")).filter(F.col("n") >= REPEATS).join(enough, "doc", "left_semi")


def remove_headers_footers(lines: DataFrame, found: DataFrame) -> DataFrame:
    """lines (doc, page, line, text) without those whose stripped text is a header or footer of their document."""
    bare = found.select("doc", F.col("text").alias("_bare")).distinct()
    return lines.withColumn("_bare", strip(F.col("text"))).join(bare, ["doc", "_bare"], "left_anti").drop("_bare")


def column_count(line: Column) -> Column:
    """Columns of a table row by tabs, by pipes, or by double spaces; null for a line that is no table row."""
    filled = lambda sep: F.size(F.filter(F.split(line, sep, -1), lambda p: ~is_blank(p)))
    by_spaces = filled("  ")
    return F.when(F.instr(line, "\t") > 0, F.size(F.split(line, "\t", -1))).when((F.instr(line, " | ") > 0) | line.startswith("|"), filled(r"\|")).when(by_spaces >= TABLE_COLUMNS, by_spaces)


def _edge(text: Column, last: bool) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~is_blank(x))
    return F.when(F.size(lines) > 0, F.element_at(lines, -1 if last else 1))


def continues_table(before: Column, after: Column) -> Column:
    """Whether the last filled line before and the first one after are table rows of equally many columns."""
    a, b = column_count(_edge(before, True)), column_count(_edge(after, False))
    return F.coalesce(a == b, F.lit(False))


def merge_tables(pages: DataFrame) -> DataFrame:
    """(doc, page, text): pages whose first table row continues the text before are appended to it; page numbers anew from 1.

    What is gathered ends with the page before, so each page is compared with that one's last filled line; a page without
    any line continues nothing and isn't continued. Runs of pages that belong together are islands of a running sum.
    """
    order = Window.partitionBy("doc").orderBy("page", "text")
    first, last = column_count(_edge(F.col("text"), False)), column_count(_edge(F.col("text"), True))
    counted = pages.select("doc", "page", "text", first.alias("_first"), last.alias("_last"))
    starts = F.when(F.lag("_last").over(order) == F.col("_first"), 0).otherwise(1)
    runs = counted.withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))  # the pages of one table
    joined = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    return runs.groupBy("doc", F.col("_run").alias("page")).agg(F.when(F.count("*") == 1, F.min("text")).otherwise(joined).alias("text"))


def whole_text(pages: DataFrame) -> DataFrame:
    """(doc, text): pages joined with a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def load_and_chunk(pages: DataFrame, chunker: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chunks of the pages' joined text with the pages they lie on; chunker takes and gives rows with doc."""
    texts = whole_text(pages)
    return chunk_pages(chunker(texts).select("doc", "chunk_index", "document"), texts, page_offsets(pages))
