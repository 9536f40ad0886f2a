"""Queries on what is written and read back: files, stores, sessions, datasets, a written index; and on pages of lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake import schemas
from corpuslake.operators import bm25, chunk, hybrid, pages, store, vector
from corpuslake.operators.common import shared_dir
from corpuslake.plans import retrieval
from corpuslake.plans.texts import BODY, LINES_SQL, PARTS_SQL, _sql_clean, documents, lines, table
from corpuslake.sources import datasets, files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/corpuslake/{label}-{uuid.uuid4().hex}"


@query(f"SELECT md5(f) AS doc_id, 'text' AS file_type, octet_length(encode(f)) AS file_size, {_sql_clean('f')} AS text FROM (SELECT text || chr(10) AS f FROM benchmark)")
def files_loaded(spark, sf_dir):
    """Every benchmark text as a file: scanned, validated, described and loaded."""
    folder = _folder(spark, "texts")
    table(spark, sf_dir, "benchmark").select("text").write.option("maxRecordsPerFile", 1).text(folder)
    found = files.metadata(files.validated(files.scan(spark, folder)))
    return files.load(found).select("doc_id", "file_type", "file_size", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS document, source, doc_id % 3 > 0 AS is_active FROM documents")
def store_scan(spark, sf_dir):
    """Chunks added in two batches and scanned."""
    folder = _folder(spark, "chunks")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("document"), "source", (F.col("doc_id") % 3 > 0).alias("is_active"))
    for part in ("doc_id % 2 = 0", "doc_id % 2 <> 0"):
        store.add(rows.filter(part), folder)
    return store.scan(spark, folder).select("doc_id", "document", "source", "is_active")


@query("SELECT CAST(conv_id AS VARCHAR) AS name, count(*) AS messages, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_content FROM conversations GROUP BY conv_id")
def sessions_saved(spark, sf_dir):
    """Conversations as session files, written and read back."""
    kind = spark.createDataFrame([], schemas.SESSIONS).schema["messages"].dataType.elementType["sources"].dataType
    message = F.struct("turn", "role", F.col("text").alias("content"), F.lit(None).cast(kind).alias("sources"))
    told = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("name")).agg(F.array_sort(F.collect_list(message)).alias("m"))
    folder = _folder(spark, "sessions")
    datasets.save_sessions(told.select("name", F.transform("m", lambda x: x.dropFields("turn")).alias("messages"), F.lit("2020").alias("created_at")), folder)
    last = F.element_at("messages", -1)
    return datasets.load_sessions(spark, folder).select("name", F.size("messages").cast("long").alias("messages"), last["role"].alias("last_role"), last["content"].alias("last_content"))


@query("SELECT text AS question, string_split(text, ' ')[1] AS first_text, 2 AS n FROM benchmark")
def dataset_loaded(spark, sf_dir):
    """Questions written as JSON and loaded as an evaluation dataset."""
    folder = _folder(spark, "dataset")
    rows = table(spark, sf_dir, "benchmark").select(F.col("text").alias("question"), F.array(F.split("text", " ")[0], F.lit("x")).alias("relevant_texts"))
    rows.write.option("maxRecordsPerFile", 1).json(folder)
    return datasets.load_dataset(spark, folder).select("question", F.col("relevant_texts")[0].alias("first_text"), F.size("relevant_texts").alias("n"))


@query(retrieval.ORACLES["hybrid_topk"])
def hybrid_retriever(spark, sf_dir):
    """Hybrid search by a retriever whose index was written and is re-read."""
    found = hybrid.HybridRetriever(retrieval._store(spark, sf_dir), _folder(spark, "index")).search(retrieval._asked(spark, sf_dir), dedup=False)
    return found.select("query_id", "doc", "source", "score", "rank")


@query(retrieval.ORACLES["bm25_topk"])
def bm25_blocks(spark, sf_dir):
    """bm25_topk by an index that was written in two batches: blocks whose bounds can't reach the last score aren't scored."""
    folder = _folder(spark, "index")
    docs = table(spark, sf_dir, "documents")
    late = F.col("doc_id") % 2 == 1
    bm25.build_index(docs.filter(~late), "doc_id", "text", written=True).write(folder)
    bm25.build_index(docs.filter(late), "doc_id", "text", written=True).append(folder)
    return bm25.search(bm25.Index.read(spark, folder), retrieval._items(spark, sf_dir), 20)


@query(retrieval.ORACLES["vector_topk"])
def vector_cells(spark, sf_dir):
    """vector_topk from a store that was written by cells."""
    folder = _folder(spark, "cells")
    vector.Cells.write(retrieval._vectors(spark, sf_dir), folder)
    return vector.nearest_by_cells(vector.Cells.read(spark, folder), retrieval._asked(spark, sf_dir), 10)


@query(rf"SELECT doc, page, string_agg(text, chr(10) ORDER BY y, text) AS text FROM {LINES_SQL} WHERE regexp_matches(text, '\S') GROUP BY doc, page")
def page_texts(spark, sf_dir):
    return pages.page_text(lines(spark, sf_dir))


@query(rf"""WITH l AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM {LINES_SQL}),
h AS (SELECT doc, t FROM l WHERE t <> '' AND (y < height * 0.15 OR y > height * 0.85) GROUP BY doc, t, y < height * 0.15 HAVING count(*) >= 3 AND doc IN (SELECT doc FROM l GROUP BY doc HAVING count(DISTINCT page) >= 3))
SELECT doc, page, y, text FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc = l.doc AND h.t = l.t)""")
def headers_removed(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return pages.remove_headers_footers(rows, pages.headers_footers(rows)).select("doc", "page", "y", "text")


@query(f"""WITH {PARTS_SQL} SELECT doc_id AS doc, CAST(chunk_index AS INTEGER) AS chunk_index, string_agg(body, chr(10) || chr(10) ORDER BY i) AS document, CAST(min(i) + 1 AS INTEGER) AS page_start, CAST(max(i) + 1 AS INTEGER) AS page_end
FROM parts GROUP BY doc_id, chunk_index""")
def pages_chunked(spark, sf_dir):
    """Three pages for each document, of long and short paragraphs."""
    body = F.array(*(F.struct(F.lit(i + 1).alias("page"), F.expr(b).alias("text")) for i, b in enumerate(BODY)))
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.inline(body))
    return pages.load_and_chunk(rows, lambda texts: chunk.chunk_by_size(texts, size=512, overlap=0)).select("doc", "chunk_index", "document", "page_start", "page_end")


# without a heading a paragraph that is too long is parted at sentence ends, and its sentences are joined with spaces
_SENTENCES = "concat(" + ", ".join(f"{b}, '。'" for b in BODY) + ")"


@query(f"""WITH {PARTS_SQL} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CASE WHEN n_large > 1 THEN string_agg(body || '。', ' ' ORDER BY i) ELSE string_agg(body || '。', '' ORDER BY i) END AS document, '' AS chapter
FROM parts GROUP BY doc_id, chunk_index, n_large""")
def chunks_headingless(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.expr(_SENTENCES).alias("text"))
    return chunk.chunk_by_heading(rows, size=512, overlap=0).select("doc_id", "chunk_index", "document", "chapter")
